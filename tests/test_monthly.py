"""Months of many variables, their store, and wide tables in blocks."""

import math

import pytest

from helpers import rows, sample_frame, to_spark
from riskloom.operators import charts, drift, levels, monthly, woe


@pytest.fixture(scope="module")
def sample(spark):
    frame = sample_frame(600, seed=4)
    frame["zone"] = [None if i % 11 == 0 else f"z{i % 7}" for i in range(len(frame))]
    return to_spark(spark, frame).cache()


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


def equal_rows(ours, theirs):
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a.keys() == b.keys()
        assert all(same(a[k], b[k]) for k in a), (a, b)


def test_profile_equals_single_variables(sample):
    tables = monthly.monthly_profile(sample, ["niveau", "zone"], "y", "mois")
    found = {r["variable"]: r for r in rows(tables["psi"], "variable")}
    assert set(found) == {"niveau", "zone"}
    for name in found:
        alone = rows(drift.psi_table(sample, name, "y", "mois"), "psi")[0]
        assert all(same(found[name][k], alone[k]) for k in alone)

        single = levels.monthly_table(sample, name, "y", "mois")
        ours = tables["taux"].where(f"variable = '{name}'").drop("variable").withColumnRenamed("level", name)
        equal_rows(rows(ours, "mois", name), rows(single, "mois", name))
        ours = tables["parts"].where(f"variable = '{name}'").drop("variable").withColumnRenamed("level", name)
        equal_rows(rows(ours, "mois", name), rows(levels.monthly_shares(single, "mois", name), "mois", name))


def test_cells_are_one_aggregate(sample):
    plan = monthly.month_cells(sample, ["niveau", "zone"], "y", "mois")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Join" not in plan


def test_store_equals_full_run(spark, sample, tmp_path):
    place = str(tmp_path / "store")
    full = rows(monthly.month_cells(sample, ["niveau", "zone"], "y", "mois"), *monthly.KEYS)
    for part in (0, 1, 2, 1):
        delivery = sample.where(f"id % 3 = {part}")
        monthly.store_batch(monthly.month_cells(delivery, ["niveau", "zone"], "y", "mois"), place, f"d{part}")
    equal_rows(rows(monthly.stored_cells(spark, place), *monthly.KEYS), full)
    with pytest.raises(ValueError):
        monthly.store_batch(sample, place, "../d")


def test_one_month_no_month_and_no_level(spark):
    schema = "v string, w string, m string, y int"
    data = [("a", None, "2024-01", 1), ("b", None, "2024-01", None), ("a", None, None, 0)]
    tables = monthly.monthly_profile(spark.createDataFrame(data, schema), ["v", "w"], "y", "m")
    psi = {r["variable"]: r for r in rows(tables["psi"], "variable")}
    assert psi["v"]["psi"] is None and psi["v"]["periode_ref"] == psi["v"]["periode_act"] == "2024-01"
    assert psi["w"]["psi"] is None and psi["w"]["periode_ref"] is None
    assert [(r["level"], r["n"], r["part_%"]) for r in rows(tables["parts"], "level")] == [("a", 1, 100.0), ("b", 0, 0.0)]
    empty = monthly.monthly_profile(spark.createDataFrame([], schema), ["v", "w"], "y", "m")
    assert all(not table.collect() for table in empty.values())


def test_blocks_hold_every_rate(sample):
    single = levels.monthly_table(sample, "zone", "y", "mois")
    names, blocks = charts.rate_blocks(single, "mois", "zone", 3)
    place = {(r["block"], r["place"]): r["zone"] for r in names.collect()}
    assert [place[k] for k in sorted(place)] == [f"z{i}" for i in range(7)]
    assert sorted(place) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]
    got = {(r["mois"], place[r["block"], i]): v for r in blocks.collect() for i, v in enumerate(r["cells"]) if v is not None}
    assert got == {(r["mois"], r["zone"]): r["taux_defaut_%"] for r in single.collect() if r["taux_defaut_%"] is not None}


def test_blocks_of_many_levels(spark):
    """50,000 columns, far beyond what a pivot takes."""
    wide = spark.range(100_000).selectExpr("id % 50000 AS v", "id % 2 AS m", "cast(id % 101 as double) AS `taux_defaut_%`")
    names, blocks = charts.rate_blocks(wide.dropDuplicates(["v", "m"]), "m", "v")
    assert names.count() == 50_000
    found = blocks.selectExpr("m", "block", "size(cells) AS n", "size(filter(cells, c -> c IS NOT NULL)) AS held").collect()
    assert len(found) == 2 * 49 and sum(r["held"] for r in found) == 50_000
    assert max(r["n"] for r in found) == charts.BLOCK_WIDTH
    none = charts.rate_blocks(wide.where("false"), "m", "v")
    assert [t.count() for t in none] == [0, 0]


def test_totals_by_variable_need_no_join(sample):
    plan = woe.woe_by_variable(sample, ["niveau", "zone"], "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
