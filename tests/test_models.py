import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import logit_metrics, newton_logit, rows
from riskloom.operators import encoding, regression, scorecard, selection


def portfolio(n, seed):
    g = np.random.default_rng(seed)
    a = g.choice(["p", "q", "r"], n, p=[0.5, 0.3, 0.2])
    b = g.choice([1, 2], n)
    c = g.choice(["u", "v", "w#1", "x&y"], n, p=[0.4, 0.3, 0.2, 0.1])
    noise = g.choice(["m", "n"], n)
    score = -1 + (a == "q") * 0.9 + (a == "r") * 1.6 + (b == 2) * 0.5 + (c == "v") * 0.7
    y = (g.random(n) < 1 / (1 + np.exp(-score))).astype(int)
    return pd.DataFrame({"a": a, "b": b, "c": c, "bruit": noise, "y": y})


@pytest.fixture(scope="module")
def data():
    return portfolio(900, 1), portfolio(600, 2)


@pytest.fixture(scope="module")
def tables(spark, data):
    return tuple(spark.createDataFrame(f.values.tolist(), "a string, b int, c string, bruit string, y int").cache() for f in data)


@pytest.fixture(scope="module")
def encoded(tables):
    train, test = tables
    learned = encoding.get_dummies(train, "y")
    return learned, encoding.get_test_dummies(test, learned.categ, keep=["y"])


def order_of(frame, name):
    rate = frame.groupby(frame[name].astype(str)).y.mean()
    return sorted(rate.index, key=lambda k: (rate[k], k))


def design(frame, categ, variables):
    """Dummies as the encoder names them, levels with '#' or '&' left out."""
    names = [
        (v, level) for v in variables for level in categ[v][1:] if "#" not in level and "&" not in level
    ]
    return np.column_stack([(frame[v].astype(str) == level).astype(float) for v, level in names]), names


def test_encoding(encoded, data):
    learned, test = encoded
    for name in ("a", "b", "c", "bruit"):
        assert learned.categ[name] == order_of(data[0], name)
    expected = ["y"] + [f"{v}&{level}" for v in learned.categ for level in learned.categ[v][1:]]
    assert learned.frame.columns == expected == test.columns
    sums = learned.frame.agg(*[F.sum(f"`{c}`").alias(c) for c in expected]).first()
    for v in learned.categ:
        for level in learned.categ[v][1:]:
            assert sums[f"{v}&{level}"] == (data[0][v].astype(str) == level).sum()


def test_missing_values_become_a_level(spark):
    df = spark.createDataFrame([("a", 1), (None, 0), ("b", 1), ("a", 0)], "v string, y int")
    learned = encoding.get_dummies(df, "y")
    assert learned.categ["v"] == ["MISSING", "a", "b"]


def test_level_mismatch(spark, encoded):
    learned, _ = encoded
    other = spark.createDataFrame([("p", 1, "u", "m"), ("z", 2, "v", "n")], "a string, b int, c string, bruit string")
    with pytest.raises(ValueError, match="levels differ"):
        encoding.get_test_dummies(other, learned.categ)
    zero = encoding.get_test_dummies(other, learned.categ, on_mismatch="zero", keep=["a"])
    z = zero.where("a = 'z'").first().asDict()
    assert all(v == 0 for k, v in z.items() if k.startswith("a&"))


def test_dummy_columns_need_the_whole_prefix():
    names = ["age&1", "age_emploi&1", "age&x#y", "age&x&y", "age&2"]
    assert encoding.dummy_columns(names, ["age"]) == ["age&1", "age&2"]
    assert encoding.dummy_columns(names, []) == []


def test_fit_and_metrics(spark, encoded, data):
    learned, test = encoded
    features = encoding.dummy_columns(learned.frame.columns, ["a", "b", "c"])
    fit = regression.fit_logit_and_metrics(learned.frame, test, "y", features)
    (xtr, names), (xte, _) = (design(f, learned.categ, ["a", "b", "c"]) for f in data)
    assert features == [f"{v}&{level}" for v, level in names]
    beta, errors = newton_logit(xtr, data[0].y.to_numpy(dtype=float))
    assert [fit.intercept, *fit.coefficients] == pytest.approx(list(beta), abs=1e-5)
    assert fit.std_errors == pytest.approx(list(errors[1:]), rel=1e-4)
    expected = logit_metrics(xtr, data[0].y.to_numpy(dtype=float), xte, data[1].y.to_numpy(dtype=float))
    assert set(fit.metrics) == set(expected)
    for name, value in expected.items():
        assert fit.metrics[name] == pytest.approx(value, abs=1e-5), name
    table = rows(fit.coefficient_table(spark), "variable", "level")
    assert {(r["variable"], r["level"]) for r in table} == set(names)
    assert all(0 <= r["pvalue"] <= 1 for r in table) and fit.converged


def test_scored_table(encoded):
    learned, test = encoded
    features = encoding.dummy_columns(learned.frame.columns, ["a", "b"])
    fit = regression.fit_logit_and_metrics(learned.frame, test, "y", features)
    for row in regression.score(fit, test, "p").limit(20).collect():
        z = fit.intercept + sum(c * row[f] for f, c in zip(fit.features, fit.coefficients))
        assert row["p"] == pytest.approx(1 / (1 + np.exp(-z)))


def test_start_vars_stay_when_nothing_is_accepted(encoded):
    learned, test = encoded
    start = ["a", "b", "c"]
    kept = selection.stepwise_selection_categorical(learned.frame, test, "y", start, criterion="gini", start_vars=start)
    assert kept.history.count() == 0


def test_no_features_is_refused(encoded):
    learned, test = encoded
    with pytest.raises(ValueError, match="no feature"):
        regression.fit_logit_and_metrics(learned.frame, test, "y", [])


def test_separated_level_has_no_pvalue_or_a_huge_error(spark):
    df = spark.createDataFrame([(1, 1)] * 30 + [(0, 0)] * 20 + [(0, 1)] * 20, "`v&s` int, y int")
    fit = regression.fit_logit_and_metrics(df, df, "y", ["v&s"])
    assert fit.coefficients[0] > 5
    assert fit.std_errors[0] is None or fit.std_errors[0] > 10


# --- stepwise -----------------------------------------------------------------------------------


def brute_stepwise(data, categ, variables, direction, criterion, max_vars=None, t_in=0.0005, t_out=0.0, start=()):
    ytr, yte = (f.y.to_numpy(dtype=float) for f in data)
    low = criterion in ("aic", "bic")
    key = {"gini": "gini_test"}.get(criterion, criterion)

    def score(names):
        xtr, xte = (design(f, categ, names)[0] for f in data)
        value = logit_metrics(xtr, ytr, xte, yte)[key]
        return value if low else -value

    chosen, left = list(start), [v for v in variables if v not in start]
    best, steps = None, []
    while True:
        added = dropped = None
        if left:
            s, v = min(((score([*chosen, v]), v) for v in left), key=lambda t: (t[0], left.index(t[1])))
            if best is None or (s < best if low else s - best < -t_in):
                chosen.append(v)
                left.remove(v)
                best, added = s, v
                steps.append(("add", v, tuple(chosen), s))
                if max_vars and len(chosen) >= max_vars:
                    break
        if direction == "both" and len(chosen) > 2:
            s, v = min(((score([c for c in chosen if c != v]), v) for v in chosen), key=lambda t: (t[0], chosen.index(t[1])))
            if s < best if low else s - best < t_out:
                chosen.remove(v)
                left.append(v)
                best, dropped = s, v
                steps.append(("remove", v, tuple(chosen), s))
        if (added is None and dropped is None) or (added and added == dropped) or (max_vars and len(chosen) >= max_vars):
            break
    return steps


@pytest.mark.parametrize(
    "options",
    [
        {"criterion": "bic"},
        {"criterion": "aic", "direction": "forward"},
        {"criterion": "gini", "threshold_in": -1.0, "threshold_out": -1.0},
        {"criterion": "auc_pr", "max_vars": 2},
        {"criterion": "rp", "start_vars": ("bruit",)},
        {"criterion": "bic", "start_vars": ("bruit", "b")},
    ],
    ids=lambda o: "-".join(map(str, o.values())),
)
def test_stepwise_against_brute_force(encoded, data, options):
    learned, test = encoded
    variables = ["bruit", "b", "a", "c"]
    got = selection.stepwise_selection_categorical(learned.frame, test, "y", variables, **options)
    expected = brute_stepwise(
        data,
        learned.categ,
        variables,
        options.get("direction", "both"),
        options["criterion"],
        options.get("max_vars"),
        options.get("threshold_in", 0.0005),
        options.get("threshold_out", 0.0),
        options.get("start_vars", ()),
    )
    history = rows(got.history, "step")
    assert [(h["action"], h["variable"], tuple(h["selected_vars"])) for h in history] == [s[:3] for s in expected]
    assert [h["best_score"] for h in history] == pytest.approx([s[3] for s in expected], abs=1e-4)
    assert got.best_vars == expected[-1][2]
    assert got.best_model.features == encoding.dummy_columns(learned.frame.columns, got.best_vars)


def test_stepwise_arguments(encoded):
    learned, test = encoded
    with pytest.raises(ValueError, match="direction"):
        selection.stepwise_selection_categorical(learned.frame, test, "y", ["a"], direction="back")
    with pytest.raises(ValueError, match="criterion"):
        selection.stepwise_selection_categorical(learned.frame, test, "y", ["a"], criterion="r2")


def test_evolution_table(spark):
    history = spark.createDataFrame(
        [(1, 0.2, 0.1, 0.3, 2.0, 100.0), (2, 0.3, 0.15, 0.4, 3.0, 80.0), (3, 0.3, 0.12, 0.4, 3.0, 90.0)],
        "step int, gini_train double, gini_test double, auc_pr double, rp double, bic double",
    )
    got = rows(selection.gini_evolution(history), "step")
    assert [r["bic_scaled"] for r in got] == pytest.approx([1.0, 0.0, 0.5])
    assert got[0]["gini_test_pct_gain"] is None
    assert [r["gini_test_pct_gain"] for r in got[1:]] == pytest.approx([50.0, -20.0])
    flat = selection.gini_evolution(history.withColumn("bic", F.lit(5.0)))
    assert {r["bic_scaled"] for r in flat.collect()} == {0.0}


# --- scorecard ----------------------------------------------------------------------------------


def test_scorecard(spark, tables, data):
    coefficients = spark.createDataFrame(
        [("a", "q", 0.8, 0.01), ("a", "r", 1.5, 0.0), ("b", "2", 0.5, 0.2)],
        "variable string, level string, coef double, pvalue double",
    )
    got = rows(scorecard.summarize_model(tables[0], "y", coefficients), "variable", "taux_cible")
    train = data[0]
    scale = 1.5 + 0.5
    known = {("a", "q"): 0.8, ("a", "r"): 1.5, ("b", "2"): 0.5}
    tops = {"a": 1.5, "b": 0.5}
    for name in ("a", "b"):
        part = [r for r in got if r["variable"] == name]
        rate = train.groupby(train[name].astype(str)).y.mean().sort_values() * 100
        assert [r["level"] for r in part] == list(rate.index)
        points = [1000 * (tops[name] - known.get((name, k), 0.0)) / scale for k in rate.index]
        assert [r["taux_cible"] for r in part] == pytest.approx(list(rate))
        assert [r["points_1000"] for r in part] == pytest.approx(points)
        assert {round(r["contribution"], 9) for r in part} == {round(max(points) / 10, 9)}
        gaps = [(b / a - 1) * 100 for a, b in zip(rate, rate[1:])]
        assert [r["ecart_relatif"] for r in part[:-1]] == pytest.approx(gaps)
        assert part[-1]["ecart_relatif"] is None
    assert sum(r["taux_pop"] for r in got) == pytest.approx(200)
    # the level with the largest coefficient scores nothing
    assert min(r["points_1000"] for r in got) == pytest.approx(0)


def test_scorecard_with_only_negative_coefficients(spark, tables):
    coefficients = spark.createDataFrame(
        [("a", "q", -0.8, None), ("a", "r", -0.5, None)], "variable string, level string, coef double, pvalue double"
    )
    got = {r["level"]: r for r in scorecard.summarize_model(tables[0], "y", coefficients).collect()}
    # base 0 above the maximum -0.5, over a negative scale
    assert got["p"]["points_1000"] == pytest.approx(1000 * (-0.5 - 0) / -0.5)
    assert got["q"]["points_1000"] == pytest.approx(1000 * 0.3 / -0.5)
    assert got["p"]["contribution"] == pytest.approx(100)
