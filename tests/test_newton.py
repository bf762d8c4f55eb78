"""Sparse encoding and Newton fits on level codes against dense numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import encoding, newton, sparse

VARIABLES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    data = [(r.choice("uvwx"), r.choice(["p", "q", None]), r.randint(1, 2), float(r.random())) for _ in range(900)]
    out = [(k, a, b, c, int(x < 0.2 + 0.2 * (a == "w") + 0.15 * (b is None) + 0.1 * (c == 2))) for k, (a, b, c, x) in enumerate(data)]
    return spark.createDataFrame(out, "id int, a string, b string, c int, y int")


def test_codes_equal_the_wide_columns(rows):
    order = sparse.level_order(rows, VARIABLES, "y")
    wide = encoding.get_dummies(rows, "y", VARIABLES, keep=["id"])
    assert sparse.dictionary(order, VARIABLES) == wide.categ
    names = {r.colonne: r.nom for r in sparse.column_names(order).collect()}
    assert sorted(names) == list(range(1, len(names) + 1))
    dense = {r.id: {c for c in wide.frame.columns if c != "id" and r[c] == 1} for r in wide.frame.collect()}
    encoded = sparse.encode_levels(rows, order, VARIABLES, keep=["id"]).collect()
    assert {r.id: {names[c] for c in r.colonnes} for r in encoded} == dense
    assert all(r.colonnes == sorted(r.colonnes) for r in encoded)
    vectors = sparse.as_vectors(sparse.encode_levels(rows, order, VARIABLES, keep=["id"]), len(names)).collect()
    assert all((v.features.indices + 1).tolist() == v.colonnes for v in vectors)


def test_unknown_levels(spark, rows):
    order = sparse.level_order(rows, ["a", "b"], "y")
    other = spark.createDataFrame([("new", "p", 0), ("u", "q", 1)], "a string, b string, y int")
    with pytest.raises(ValueError, match="5 levels differ"):
        sparse.encode_levels(other, order, ["a", "b"])
    zero = sparse.encode_levels(other, order, ["a", "b"], keep=["y"], on_mismatch="zero").orderBy("y").collect()
    assert zero[0].a is None and zero[1].a is not None
    assert sparse.encode_levels(other.where("false"), order, ["a", "b"], on_mismatch="zero").count() == 0


def dense_fit(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        h = x.T @ ((p * (1 - p))[:, None] * x)
        beta += np.linalg.solve(h, x.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_fit_equals_the_dense_one(rows):
    fit = newton.fit_by_levels(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), "y", VARIABLES)
    train = rows.where("id % 3 > 0").fillna("MISSING", ["b"]).collect()
    cells = [[1.0] + [float(str(r[n.split("&")[0]]) == n.split("&")[1]) for n in fit.features] for r in train]
    beta, errors = dense_fit(np.array(cells), np.array([r.y for r in train]))
    assert fit.converged and [fit.intercept, *fit.coefficients] == pytest.approx(list(beta), abs=1e-8)
    assert fit.std_errors == pytest.approx(list(errors[1:]), rel=1e-8)


def test_repeated_and_separated_columns(spark):
    """A copy of a variable leaves the likelihood as it is; a level without defaults runs away but ends."""
    rows = [(k % 3, k % 3, k % 2, *(n * w for n in (5 + k, 9 - k) for w in (1, 2))) for k in range(6)]
    patterns = spark.createDataFrame(rows, "a int, b int, c int, train_0 long, test_0 long, train_1 long, test_1 long")
    names = {"a": ["a&1", "a&2"], "b": ["b&1", "b&2"], "c": ["c&1"]}
    one, both = newton.fit_candidates(patterns, names, [("a", "c"), ("a", "b", "c")], wald=True)
    assert both.metrics["brier_train"] == pytest.approx(one.metrics["brier_train"], abs=1e-9)
    assert None in both.std_errors and None not in one.std_errors
    apart = patterns.withColumn("train_1", F.when(F.col("a") == 2, 0).otherwise(F.col("train_1")))
    fit = newton.fit_candidates(apart, names, [("a",)])[0]
    assert fit.coefficients[1] < -10 and np.isfinite(fit.metrics["bic"])
