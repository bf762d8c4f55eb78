import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import np_round, rows, sample_frame, to_spark, woe_frame
from riskloom.operators import drift, levels, woe
from riskloom.operators.ordering import running_totals
from riskloom.plans.categorical import analyse_categorielle


@pytest.fixture(scope="module")
def frame():
    return sample_frame()


@pytest.fixture(scope="module")
def table(spark, frame):
    return to_spark(spark, frame).cache()


def test_frequencies(table, frame):
    got = rows(levels.frequency_table(table, "niveau"), "niveau")
    counts = frame.niveau.value_counts()
    share = np_round(counts / len(frame) * 100, 2)
    cumulated = dict(zip(counts.index, np_round(np.cumsum(share), 2)))
    assert len(got) == len(counts)
    for r in got:
        assert r["effectif"] == counts[r["niveau"]]
        assert r["frequence_cum_%"] == pytest.approx(cumulated[r["niveau"]], abs=1e-9)


def test_entropy(table, frame, spark):
    got = levels.entropy_table(table, "niveau").first()
    p = frame.niveau.value_counts(normalize=True).to_numpy()
    h = -(p * np.log2(p)).sum()
    assert (got.n_total, got.n_missing, got.n_modalites) == (len(frame), frame.niveau.isna().sum(), 4)
    assert got.entropie == pytest.approx(h) and got.entropie_norm == pytest.approx(h / 2)
    one = levels.entropy_table(spark.createDataFrame([("a",), ("a",)], "v string"), "v").first()
    assert (one.entropie, one.entropie_norm) == (0.0, 0.0)


def test_missing_rates_count_nan_and_null(table, frame):
    got = {r["variable"]: r for r in rows(levels.missing_rates(table), "variable")}
    for name in frame.columns:
        assert got[name]["n_missing"] == frame[name].isna().sum()


def test_target_and_monthly(table, frame):
    expected = frame.groupby("niveau").y.agg(["count", "sum"])
    for r in levels.target_table(table, "niveau", "y").collect():
        n, d = expected.loc[r["niveau"]]
        assert (r["effectif"], r["nb_defaut"], r["taux_defaut_%"]) == (n, d, np_round(d / n * 100, 2))
    monthly = frame.groupby(["mois", "niveau"]).y.agg(["count", "sum"])
    got = levels.monthly_table(table, "niveau", "y", "mois").collect()
    assert {(r["mois"], r["niveau"]): (r["effectif"], r["nb_defaut"]) for r in got} == {
        k: tuple(v) for k, v in monthly.astype(int).iterrows()
    }


def test_level_without_any_target(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", None)], "v string, y int")
    b = rows(levels.target_table(df, "v", "y"), "v")[1]
    assert (b["effectif"], b["nb_defaut"], b["taux_defaut_%"]) == (0, 0, None)


def test_monthly_shares_fill_the_grid(spark):
    df = spark.createDataFrame([("1", "a", 3), ("1", "b", 1), ("2", "a", 5)], "m string, v string, effectif long")
    got = rows(levels.monthly_shares(df, "m", "v"), "m", "v")
    assert [(r["n"], r["part_%"]) for r in got] == [(3, 75.0), (1, 25.0), (5, 100.0), (0, 0.0)]


def test_woe(table, frame):
    counts = frame.groupby("niveau").y.agg(effectif="count", nb_defaut="sum")
    expected = woe_frame(counts)
    got = woe.woe_table(table, "niveau", "y").collect()
    for r in got:
        assert r["WoE"] == pytest.approx(expected.WoE[r["niveau"]], abs=1e-9)
        assert r["IV_modalite"] == pytest.approx(expected.IV[r["niveau"]], abs=1e-9)
    assert sum(r["dist_defaut"] for r in got) == pytest.approx(1)
    assert woe.information_value(table, "niveau", "y").first().iv_total == pytest.approx(expected.IV.sum(), abs=1e-9)


def test_many_variables_equal_one_by_one(table):
    by_variable = woe.woe_by_variable(table, ["niveau", "mois"], "y").collect()
    for name in ("niveau", "mois"):
        alone = {str(r[name]): r for r in woe.woe_table(table, name, "y").collect()}
        together = {r["level"]: r for r in by_variable if r["variable"] == name}
        assert set(alone) == set(together)
        for level, r in alone.items():
            for field in ("effectif", "nb_defaut", "taux_defaut_%", "WoE", "IV_modalite"):
                assert together[level][field] == r[field]
    ivs = {r["variable"]: r["iv_total"] for r in woe.iv_by_variable(table, ["niveau", "mois"], "y").collect()}
    assert ivs["niveau"] == woe.information_value(table, "niveau", "y").first().iv_total


def test_woe_of_a_level_without_defaults(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 0)], "v string, y int")
    a = rows(woe.woe_table(df, "v", "y"), "v")[0]
    assert a["WoE"] == pytest.approx(np_round(np.log((2 / 3) / 1e-10), 4))


def test_iv_without_any_default(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "v string, y int")
    assert woe.information_value(df, "v", "y").first().iv_total == 0.0


def brute_psi(frame, level):
    known = frame.dropna(subset=["mois", level])
    grid = known.pivot_table(index="mois", columns=level, values="y", aggfunc="count", fill_value=0)
    share = grid.div(grid.sum(axis=1), axis=0).clip(lower=1e-10)
    a, b = share.iloc[-1], share.iloc[0]
    return float(((a - b) * np.log(a / b)).sum())


def test_psi(table, frame):
    got = drift.psi_table(table, "niveau", "y", "mois").first()
    assert got.psi == pytest.approx(brute_psi(frame, "niveau"))
    assert (got.periode_ref, got.periode_act) == ("2024-01", "2024-04")


def test_psi_of_equal_months_is_zero_and_of_one_month_missing(spark):
    same = spark.createDataFrame([(m, v, 1) for m in "12" for v in "ab"], "m string, v string, y int")
    assert drift.psi_table(same, "v", "y", "m").first().psi == pytest.approx(0)
    one = drift.psi_table(same.where("m = '1'"), "v", "y", "m").first()
    assert (one.psi, one.interpretation) == (None, "Non calculable (une seule période)")


def test_psi_counts_months_whose_level_is_missing(spark):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 0), ("2", None, 1)], "m string, v string, y int")
    got = drift.psi_table(df, "v", "y", "m").first()
    assert (got.psi, got.interpretation) == (0.0, "Stable")


def test_modality_order(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("b", 0), ("c", None), (None, 1), ("d", 1)], "v string, y int"
    )
    assert levels.modality_order(df, ["v"], "y").first().v == ["b", "c", "d", "a"]
    assert levels.modality_order(df, ["v"], "y", "decroissant").first().v == ["a", "d", "b", "c"]
    assert levels.modality_order(df.where("v is null"), ["v"], "y").first().v == []


def test_risk_order(table, frame):
    got = rows(levels.risk_order(table, ["niveau", "mois"], "y"), "variable", "rang")
    for name in ("niveau", "mois"):
        rate = frame.assign(k=frame[name].fillna("MISSING")).groupby("k").y.mean().sort_values(kind="stable")
        assert [r["level"] for r in got if r["variable"] == name] == list(rate.index)
        assert [r["rang"] for r in got if r["variable"] == name] == list(range(len(rate)))


def test_running_totals(spark):
    g = np.random.default_rng(1)
    data = pd.DataFrame({"k": g.permutation(500), "n": g.integers(0, 9, 500), "t": g.integers(0, 4, 500)})
    df = spark.createDataFrame(data.values.tolist(), "k long, n long, t long").repartition(7)
    order = [F.col("t").desc(), F.col("k").asc()]
    got = running_totals(df, order, ["n"], totals=True).toPandas()
    data = data.sort_values(["t", "k"], ascending=[False, True])
    expected = dict(zip(data.k, data.n.cumsum() - data.n))
    assert len(got) == 500 and all(expected[k] == b for k, b in zip(got.k, got.n_before))
    assert set(got.n_all) == {data.n.sum()}


def test_profile(table, frame):
    tables = analyse_categorielle(table, "niveau", "y", "mois")
    assert set(tables) == {"univarie", "synthese", "bivarie", "tests", "temporel", "psi"}
    assert sum(r["effectif"] for r in tables["bivarie"].collect()) == len(frame.dropna(subset=["niveau", "y"]))
    assert tables["psi"].first().psi == pytest.approx(brute_psi(frame, "niveau"))
    iv = woe.information_value(table, "niveau", "y").first().iv_total
    assert tables["tests"].first().iv_total == pytest.approx(iv)
    assert "psi" not in analyse_categorielle(table, "niveau", "y")
