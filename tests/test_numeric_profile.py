import math

import numpy as np
import pandas as pd
import pytest

from helpers import average_precision, np_round, pair_wins, rows, sample_frame, to_spark, woe_frame
from riskloom.operators import binning, charts, ranks
from riskloom.plans.quantitative import analyse_quantitative, bin_woe_table


@pytest.fixture(scope="module")
def frame():
    return sample_frame(seed=3)


@pytest.fixture(scope="module")
def table(spark, frame):
    return to_spark(spark, frame).cache()


def test_quantiles(table, frame):
    probs = [0, 0.01, 0.1, 1 / 3, 0.5, 0.9, 1]
    got = ranks.histogram_quantiles(ranks.value_histogram(table, "x", "y"), {"n": probs, "n1": probs})
    assert got["n"] == pytest.approx(list(frame.x.quantile(probs)))
    assert got["n1"] == pytest.approx(list(frame.x[frame.y == 1].quantile(probs)))


def test_quantiles_with_a_value_holding_a_third_of_the_rows(spark):
    values = [7.0] * 1000 + [float(i) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.001, 0.3, 0.31, 0.33, 0.5, 0.999]
    assert ranks.exact_quantiles(df, "x", probs) == pytest.approx(list(np.quantile(values, probs)))


def test_summary(table, frame):
    got = ranks.numeric_summary(table, "x").first().asDict()
    x = frame.x.dropna()
    expected = {
        "count": len(frame),
        "missing": frame.x.isna().sum(),
        "missing_%": np_round(frame.x.isna().mean() * 100, 2),
        "mean": x.mean(),
        "median": x.median(),
        "std": x.std(),
        "min": x.min(),
        "max": x.max(),
        "skewness": x.skew(),
        "kurtosis": x.kurtosis(),
    } | {f"Q{int(q * 100)}": x.quantile(q) for q in ranks.SUMMARY_QUANTILES}
    assert list(got) == list(expected)
    for name, value in expected.items():
        assert got[name] == pytest.approx(np_round(value, 4), abs=1e-9), name


@pytest.mark.parametrize("values", [[], [2.0], [2.0, 3.0, 9.0], [5.0] * 6, [None, float("nan")], [0.1] * 7])
def test_summary_of_small_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = ranks.numeric_summary(df, "x").first()
    x = pd.Series(values, dtype=float).dropna()
    for name, value in {"mean": x.mean(), "std": x.std(), "skewness": x.skew(), "kurtosis": x.kurtosis(), "Q25": x.quantile(0.25)}.items():
        if pd.isna(value):
            assert got[name] is None, name
        else:
            assert got[name] == pytest.approx(np_round(value, 4)), name


def brute_tests(x0, x1):
    u = pair_wins(x0, x1)
    n0, n1 = len(x0), len(x1)
    n = n0 + n1
    t = pd.Series(np.concatenate([x0, x1])).value_counts().to_numpy(dtype=float)
    s = math.sqrt(n0 * n1 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    z = (max(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / s
    return u, min(1.0, math.erfc(z / math.sqrt(2))), 1 - u / (n0 * n1)


def test_class_tests(table, frame):
    got = ranks.class_tests(table, "x", "y").first()
    x0, x1 = (frame.x[(frame.y == c) & frame.x.notna()] for c in (0, 1))
    u, p, auc = brute_tests(x0.to_numpy(), x1.to_numpy())
    assert (got.mann_whitney_U, got.auc) == (pytest.approx(u), pytest.approx(auc))
    assert got.mann_whitney_pvalue == pytest.approx(p)
    assert got.auc_ajuste == pytest.approx(max(auc, 1 - auc))
    assert got.moyenne_defaut == pytest.approx(x1.mean()) and got.mediane_non_defaut == pytest.approx(x0.median())
    assert (got.effectif_non_defaut, got.effectif_defaut) == (len(x0), len(x1))


def test_score_metrics(table, frame):
    got = ranks.score_metrics(table, "x", "y").first()
    known = frame.dropna(subset=["x", "y"])
    auc = pair_wins(known.x[known.y == 1], known.x[known.y == 0]) / ((known.y == 1).sum() * (known.y == 0).sum())
    ap = average_precision(known.y, known.x)
    assert (got.auc, got.gini) == (pytest.approx(auc), pytest.approx(2 * auc - 1))
    assert (got.auc_pr, got.rp) == (pytest.approx(ap), pytest.approx(ap / known.y.mean()))
    mirrored = ranks.score_metrics(table.withColumn("x", -table.x), "x", "y").first()
    assert mirrored.auc == pytest.approx(1 - auc)


def test_constant_column_is_no_evidence(spark):
    df = spark.createDataFrame([(5.0, 0), (5.0, 1), (5.0, 1)], "x double, y int")
    got = ranks.class_tests(df, "x", "y").first()
    assert (got.mann_whitney_U, got.mann_whitney_pvalue, got.auc) == (1.0, 1.0, 0.5)


def test_one_class_has_no_rank_tests(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, y int")
    got = ranks.class_tests(df, "x", "y").first()
    assert got.mann_whitney_U is None and got.auc is None and got.effectif_defaut == 0
    assert ranks.score_metrics(df, "x", "y").first().auc is None


# --- binning ----------------------------------------------------------------------------------


def test_threshold_bins_match_cut(table, frame):
    seuils = [10, 20, 40, 1000]
    bins = binning.threshold_bins(seuils)
    assert [b.tranche for b in bins] == ["≤ 10", "]10, 20]", "]20, 40]", "]40, 1000]", "> 1000"]
    cut = pd.cut(frame.x, [-np.inf, *seuils, np.inf], labels=False, include_lowest=True)
    got = {r["id"]: r["bin_id"] for r in binning.with_bins(table, "x", bins).collect()}
    assert all(got[i] == (None if pd.isna(b) else b) for i, b in zip(frame.id, cut))


def test_repeated_thresholds_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        binning.threshold_bins([1, 2, 2])


@pytest.mark.parametrize("scale", [1.0, 1e-4, 0.0123, 1e6])
@pytest.mark.parametrize("n", [2, 5, 20])
def test_quantile_bins_match_qcut(spark, frame, scale, n):
    x = (frame.x.dropna() * scale).reset_index(drop=True)
    expected = pd.qcut(x, n, duplicates="drop")
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    bins = binning.quantile_bins(binning.quantile_edges(df, "x", n))
    assert [b.tranche for b in bins] == [str(c) for c in expected.cat.categories]
    got = {r["id"]: r["bin_id"] for r in binning.with_bins(df, "x", bins).collect()}
    assert [got[i] for i in range(len(x))] == list(expected.cat.codes)


def test_quantile_bins_with_ties_and_constant(spark):
    x = pd.Series([1.0] * 50 + [2.0] * 30 + [3.0, 4.0, 5.0] * 5)
    df = spark.createDataFrame([(v,) for v in x], "x double")
    bins = binning.quantile_bins(binning.quantile_edges(df, "x", 10))
    assert [b.tranche for b in bins] == [str(c) for c in pd.qcut(x, 10, duplicates="drop").cat.categories]
    assert [b.tranche for b in binning.quantile_bins([5.0, 5.0])] == ["nan"]


def test_bin_woe_keeps_empty_threshold_bins(table, frame):
    got = rows(bin_woe_table(table, "x", "y", seuils=[10, 20, 9999]), "bin_id")
    known = frame.dropna(subset=["x", "y"])
    cut = pd.cut(known.x, [-np.inf, 10, 20, 9999, np.inf], labels=False)
    counts = known.groupby(cut).y.agg(effectif="count", nb_defaut="sum").reindex(range(4), fill_value=0)
    expected = woe_frame(counts)
    assert [r["effectif"] for r in got] == list(expected.effectif)
    assert [r["WoE"] for r in got] == pytest.approx(list(expected.WoE))
    assert [r["IV_tranche"] for r in got] == pytest.approx(list(expected.IV))
    assert got[3]["taux_defaut_%"] is None and got[3]["WoE"] == 0.0


def test_profile_by_quantiles(table, frame):
    tables = analyse_quantitative(table, "x", "y", "mois", n_tranches=4)
    known = frame.dropna(subset=["x", "y"]).copy()
    known["b"] = pd.qcut(known.x, 4)
    expected = woe_frame(known.groupby("b", observed=True).y.agg(effectif="count", nb_defaut="sum"))
    got = rows(tables["bivarie"], "bin_id")
    assert [r["tranche"] for r in got] == [str(b) for b in expected.index]
    assert [r["WoE"] for r in got] == pytest.approx(list(expected.WoE))
    assert tables["iv"].first().iv_total == pytest.approx(expected.IV.sum())
    low, high = tables["winsorisation"].first()
    assert (low, high) == (pytest.approx(frame.x.quantile(0.01)), pytest.approx(frame.x.quantile(0.99)))
    # months: edges are taken again on the rows that have one
    dated = known.dropna(subset=["mois"]).copy()
    dated["b"] = pd.qcut(dated.x, 4)
    monthly = dated.groupby(["mois", "b"], observed=True).y.agg(["count", "sum"])
    got = {(r["mois"], r["tranche"]): (r["effectif"], r["nb_defaut"]) for r in tables["temporel"].collect()}
    assert got == {(m, str(b)): (n, d) for (m, b), (n, d) in monthly.iterrows()}
    share = dated.groupby(["mois", "b"], observed=False).size().unstack(fill_value=0)
    share = share.div(share.sum(axis=1), axis=0).clip(lower=1e-10)
    psi = ((share.iloc[-1] - share.iloc[0]) * np.log(share.iloc[-1] / share.iloc[0])).sum()
    assert tables["psi"].first().psi == pytest.approx(psi)


def test_profile_by_thresholds_keeps_every_month_and_bin(table, frame):
    tables = analyse_quantitative(table, "x", "y", "mois", seuils=[15, 9999])
    got = tables["temporel"].collect()
    assert len(got) == frame.mois.nunique() * 3
    assert all(r["effectif"] == 0 and r["taux_defaut_%"] is None for r in got if r["bin_id"] == 2)
    no_month = analyse_quantitative(table, "x", "y", seuils=[15])
    assert "psi" not in no_month


def test_digitise(spark):
    values = [None, float("nan"), -1.0, 10.0, 10.5, 20.0, 99.0]
    df = spark.createDataFrame([(v, None if v is None else str(v)) for v in values], "x double, c string")
    got = binning.transform_dataframe(df, {"x": [10.0, 20.0]}).collect()
    expected = np.digitize(values[2:], [10.0, 20.0])
    assert [r.x for r in got] == [-1, -1, *expected]
    assert got[0].c == "MISSING"
    empty = df.select(binning.transform_numeric_column(df, "x", [])).collect()
    assert [r[0] for r in empty] == [-1, -1, 0, 0, 0, 0, 0]
    with pytest.raises(ValueError, match="sorted"):
        binning.transform_numeric_column(df, "x", [2.0, 1.0])


def test_winsorise(table, frame):
    got = {r["id"]: r["x"] for r in binning.winsorise(table, "x").collect()}
    expected = frame.x.clip(frame.x.quantile(0.01), frame.x.quantile(0.99))
    for i, v in zip(frame.id, expected):
        assert math.isnan(got[i]) if pd.isna(v) else got[i] == pytest.approx(v)


# --- charts -----------------------------------------------------------------------------------


def test_density_histogram(table, frame):
    got = rows(charts.density_histogram(table, "x"), "bin_id")
    x = frame.x.dropna()
    x = x.clip(x.quantile(0.01), x.quantile(0.99))
    counts, edges = np.histogram(x, bins=50)
    assert [r["effectif"] for r in got] == list(counts)
    assert [r["lo"] for r in got] == pytest.approx(list(edges[:-1]))
    assert sum(r["densite"] * (r["hi"] - r["lo"]) for r in got) == pytest.approx(1)


def test_density_histogram_of_a_constant(spark):
    got = charts.density_histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x").collect()
    assert sum(r["effectif"] for r in got) == 4


def test_density_curve(table, frame):
    got = rows(charts.density_curve(table, "x"), "point_id")
    x = frame.x.dropna()
    x = x.clip(x.quantile(0.01), x.quantile(0.99)).to_numpy()
    h = x.std(ddof=1) * len(x) ** -0.2
    spread = x.max() - x.min()
    grid = np.linspace(x.min() - 0.5 * spread, x.max() + 0.5 * spread, 1000)
    density = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["x"] for r in got] == pytest.approx(list(grid))
    assert [r["densite"] for r in got] == pytest.approx(list(density), rel=1e-9)


def test_density_curve_is_exact_far_from_the_values(spark):
    # two groups many bandwidths apart, with repeated values
    x = np.concatenate([np.linspace(0, 1, 300), np.full(150, 40.0), np.linspace(40, 41, 50)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = rows(charts.density_curve(df, "x", limits=(0.0, 1.0), points=200), "point_id")
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(-20.5, 61.5, 200)
    density = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert [r["densite"] for r in got] == pytest.approx(list(density), rel=1e-9, abs=1e-15)
    assert min(r["densite"] for r in got) >= 0


def test_density_curve_of_a_constant_and_of_nothing(spark):
    got = rows(charts.density_curve(spark.createDataFrame([(3.0,)] * 4 + [(None,)], "x double"), "x"), "point_id")
    assert (got[0]["x"], got[-1]["x"]) == (pytest.approx(2.0), pytest.approx(4.0))
    assert sum(r["densite"] for r in got) * 2 / 999 == pytest.approx(1)
    assert max(got, key=lambda r: r["densite"])["x"] == pytest.approx(3.0, abs=2 / 999)
    empty = charts.density_curve(spark.createDataFrame([(None,)], "x double"), "x")
    assert empty.columns == ["point_id", "x", "densite"] and empty.count() == 0


def test_box_statistics(table, frame):
    got = rows(charts.box_statistics(table, "x", "y"), "classe")
    for c, r in enumerate(got):
        x = frame.x[(frame.y == c) & frame.x.notna()]
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r["q1"], r["q3"]) == (pytest.approx(q1), pytest.approx(q3))
        assert (r["moustache_basse"], r["moustache_haute"]) == (inside.min(), inside.max())
        assert (r["effectif"], r["nb_extremes"]) == (len(x), len(x) - len(inside))


def test_stacked_shares(spark):
    df = spark.createDataFrame([("1", "a", 3), ("1", "b", 1), ("2", "b", 5)], "m string, v string, effectif long")
    got = rows(charts.stacked_shares(df, "m", "v"), "m", "v")
    assert [(r["part_%"], r["base_%"]) for r in got] == [(75.0, 0.0), (25.0, 75.0), (100.0, 0.0)]


def test_rate_pivots_drop_all_null_columns(spark):
    df = spark.createDataFrame(
        [("1", "a", 10.0), ("2", "a", None), ("1", "b", 30.0), ("2", "c", None)], "m string, v string, `taux_defaut_%` double"
    )
    assert [r.asDict() for r in charts.rate_by_month(df, "m", "v").collect()] == [{"m": "1", "a": 10.0, "b": 30.0}]
    assert [r.asDict() for r in charts.heat_map(df, "m", "v").orderBy("v").collect()] == [
        {"v": "a", "1": 10.0},
        {"v": "b", "1": 30.0},
    ]
    cells = rows(charts.heat_map_cells(df, "m", "v"), "v")
    assert [(r["v"], r["texte"]) for r in cells] == [("a", "black"), ("b", "white")]
