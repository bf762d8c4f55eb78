import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from riskloom.operators import binning, cleaning, folds, graph
from riskloom.sources import bundle, shared, synth, trees


def test_imputation_frame(spark):
    df = spark.createDataFrame(
        [(1, None, "x", 10), (None, 2, "y", 20), (3, None, None, 30), (4, 5, "z", 40)], "a int, b int, c string, d int"
    )
    got = df.transform(cleaning.impute_missing_values, ["a", "b"], 0).transform(
        cleaning.impute_missing_values, ["c"], "inconnu"
    )
    assert [tuple(r) for r in got.orderBy("d").collect()] == [
        (1, 0, "x", 10),
        (0, 2, "y", 20),
        (3, 0, "inconnu", 30),
        (4, 5, "z", 40),
    ]
    assert got.schema["a"].dataType == df.schema["a"].dataType


def test_imputation_widens_whole_numbers(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert [r.a for r in cleaning.impute_missing_values(df, ["a"], 0.5).collect()] == [1.0, 0.5]
    assert [r.a for r in cleaning.impute_missing_values(df, ["a"], 2**40).collect()] == [1, 2**40]
    assert cleaning.impute_missing_values(df, ["a"], 3).schema["a"].dataType == df.schema["a"].dataType


def test_imputation_leaves_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    got = [r.x for r in cleaning.impute_missing_values(df, ["x"], 1.0).collect()]
    assert np.isnan(got[0]) and got[1] == 1.0


def test_complete_and_present_rows(spark):
    df = spark.createDataFrame([(1.0, "a", 1), (float("nan"), "b", 2), (None, "c", 3), (4.0, None, 4)], "x double, v string, k int")
    assert [r.k for r in cleaning.where_present(df, "x").collect()] == [1, 4]
    assert cleaning.complete_rows(df, ["x", "v"]).collect() == [(1.0, "a")]


def test_thresholds_from_tree_dumps(spark, tmp_path):
    dumps = [
        {"split": "age", "split_condition": 30.5, "children": [{"split": "age", "split_condition": 99}]},
        {"split": "age", "split_condition": 21},
        {"split": "age", "split_condition": 30.5},
        {"split": "ville", "split_condition": 1, "categories": [1, 2]},
        {"split": "ville", "split_condition": 1, "categories": None},
        {"leaf": 0.3},
        {"split": "revenu", "split_condition": None},
        {"split": "revenu", "split_condition": -4e3},
    ]
    texts = [json.dumps(d) for d in dumps]
    found = binning.extract_thresholds(trees.trees_from_strings(spark, texts))
    assert binning.thresholds_map(found) == {"age": [21.0, 30.5], "revenu": [-4000.0]}
    (tmp_path / "dump.txt").write_text("\n".join(texts))
    from_files = binning.extract_thresholds(trees.trees_from_files(spark, str(tmp_path)))
    assert binning.thresholds_map(from_files) == {"age": [21.0, 30.5], "revenu": [-4000.0]}


def test_bin_description(spark):
    frame = binning.thresholds_frame(spark, {"age": [21.0, 30.5], "vide": []})
    got = rows(binning.build_bin_description(frame), "feature", "bin_id")
    inf = float("inf")
    assert [(r["feature"], r["bin_id"], r["lo"], r["hi"], r["is_missing"]) for r in got] == [
        ("age", -1, None, None, True),
        ("age", 0, -inf, 21.0, False),
        ("age", 1, 21.0, 30.5, False),
        ("age", 2, 30.5, inf, False),
        ("vide", -1, None, None, True),
        ("vide", 0, -inf, inf, False),
    ]


@pytest.mark.parametrize("slices", [1, 64])
def test_folds_are_balanced_and_repeatable(spark, slices):
    df = spark.range(1001).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    dealt = folds.stratified_folds(df, "y", ["id"], k=3, seed=7, slices=slices)
    sizes = {(r["fold"], r["y"]): r["count"] for r in dealt.groupBy("fold", "y").count().collect()}
    for y, total in ((0, 900), (1, 101)):
        counts = [sizes[(f, y)] for f in range(3)]
        assert sum(counts) == total and max(counts) - min(counts) <= 1
    first = {r.id: r.fold for r in dealt.collect()}
    again = folds.stratified_folds(df.repartition(5), "y", ["id"], k=3, seed=7, slices=slices)
    assert {r.id: r.fold for r in again.collect()} == first
    other = folds.stratified_folds(df, "y", ["id"], k=3, seed=8, slices=slices)
    assert {r.id: r.fold for r in other.collect()} != first


def test_fold_of_each_row_follows_the_stated_order(spark):
    data = [(a, b, None if a % 7 == 0 else a % 2) for a in range(60) for b in ("x", None)]
    df = spark.createDataFrame(data, "a long, b string, y int")
    for slices in (None, 9):
        got = {(r.a, r.b): r.fold for r in folds.stratified_folds(df, "y", ["a", "b"], k=4, seed=5, slices=slices).collect()}
        for y in (None, 0, 1):
            mine = [(a, b) for a, b, c in data if c is y]
            mine.sort(key=lambda r: hashlib.md5(f"5|{r[0]}|{r[1] or ''}".encode()).hexdigest())
            assert [got[r] for r in mine] == [k % 4 for k in range(len(mine))]


def test_folds_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, y int")
    dealt = folds.stratified_folds(empty, "y", ["id"])
    assert dealt.columns == ["id", "y", "fold"] and dealt.count() == 0


def test_search_settings_stay_in_their_ranges():
    drawn = folds.draw_settings(200, seed=1)
    assert drawn == folds.draw_settings(200, seed=1) != folds.draw_settings(200, seed=2)
    for name, (kind, low, high) in folds.SEARCH_SPACE.items():
        values = [d[name] for d in drawn]
        assert low <= min(values) and max(values) <= high
        assert kind != "int" or all(isinstance(v, int) for v in values)


def test_boosted_tree_search_ranks_settings(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 20).cast("double").alias("x"), F.rand(3).alias("z"),
        ((F.col("id") % 20 > 12) | (F.rand(4) < 0.1)).cast("int").alias("y"),
    )
    space = {"maxDepth": ("int", 1, 2), "maxIter": ("int", 2, 3)}
    got = rows(folds.boosted_tree_search(df, ["x", "z"], "y", ["id"], n_trials=2, k=2, space=space), "rang")
    assert [r["rang"] for r in got] == [1, 2]
    assert got[0]["auc_cv"] >= got[1]["auc_cv"] > 0.7


def test_graph(spark):
    clusters = graph.clusters_frame(spark, {"a": ["b", "c"], "b": ["d", "x", "a"], "e": []})
    nodes = {r["id"]: r["type"] for r in graph.graph_nodes(clusters).collect()}
    assert nodes == {"a": "representant", "b": "representant", "e": "representant", "c": "correlee", "d": "correlee", "x": "correlee"}
    edges = {(r["a"], r["b"]): r for r in graph.graph_edges(clusters).collect()}
    assert {k: r["rang"] for k, r in edges.items()} == {("a", "b"): 3, ("a", "c"): 2, ("b", "d"): 1, ("b", "x"): 2}
    assert edges[("a", "c")]["poids"] == 0.5 and edges[("a", "b")]["largeur"] == 1.0


def test_synthetic_portfolios(spark):
    df = synth.categorical_portfolio(spark, 20_000, seed=5).cache()
    share = {r["type_contrat"]: r["n"] / 20_000 for r in df.groupBy("type_contrat").agg(F.count("*").alias("n")).collect()}
    assert share == pytest.approx({"CDI": 0.6, "CDD": 0.3, "Freelance": 0.1}, abs=0.02)
    rate = {r[0]: r[1] for r in df.groupBy("type_contrat").agg(F.avg("defaut")).collect()}
    assert rate == pytest.approx({"CDI": 0.05, "CDD": 0.12, "Freelance": 0.18}, abs=0.03)
    months = sorted(r[0] for r in df.select("mois_octroi").distinct().collect())
    assert months == [f"2024-{m:02d}" for m in range(1, 13)]
    num = synth.numeric_portfolio(spark, 20_000, seed=5)
    logs = num.agg(F.avg(F.ln("revenu")), F.stddev(F.ln("revenu"))).first()
    assert tuple(logs) == pytest.approx((7.5, 0.8), abs=0.03)


def test_bundle_round_trip(spark, tmp_path):
    tables = {"un": spark.range(3), "deux": spark.createDataFrame([(1.5,)], "`frequence_%` double")}
    bundle.write_bundle(tables, str(tmp_path / "b"))
    back = bundle.read_bundle(spark, str(tmp_path / "b"), tables)
    assert back["un"].count() == 3 and back["deux"].first()[0] == 1.5


def test_shared_tables_use_the_session_folder(spark):
    before = shared.shared_folder(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or before == named.rstrip("/")
    written = shared.write_shared(spark.range(5))
    assert written.count() == 5 and written.inputFiles()[0].startswith(("file:", "/"))
