import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import numeric
from riskloom.functions.checks import require
from riskloom.functions.pvalues import chi2_tail, gamma_survival, normal_two_sided_tail


def test_round_even_matches_numpy(spark):
    values = [0.125, 0.375, 2.675, -0.125, 1.005, 33.335, -0.0, 12.345]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(numeric.round_even(F.col("v"), 2)).collect()]
    assert got == list(np.round(values, 2) + 0.0)
    assert not any(math.copysign(1, g) < 0 and g == 0 for g in got)


def test_ratio_and_floor_keep_null(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 2)], "a int, b int")
    got = [r[0] for r in df.select(numeric.floor_share(numeric.ratio(F.col("a"), F.col("b")))).collect()]
    assert got == [None, None, 0.5]
    zero = spark.createDataFrame([(0.0,)], "s double").select(numeric.floor_share(F.col("s"))).first()[0]
    assert zero == 1e-10


@pytest.mark.parametrize("cuts", [[], [3.0], [1.0, 2.0, 5.0, 5.5], list(range(0, 40, 3))])
def test_cuts_passed(spark, cuts):
    values = [-1.0, 0.0, 1.0, 2.0, 3.0, 4.9, 5.0, 5.5, 6.0, 100.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    both = df.select(
        numeric.cuts_passed(F.col("v"), cuts, True), numeric.cuts_passed(F.col("v"), cuts, False)
    ).collect()
    assert [r[0] for r in both] == list(np.digitize(values, cuts))
    assert [r[1] for r in both] == list(np.searchsorted(cuts, values, side="left"))


def test_class_labels(spark):
    df = spark.createDataFrame([(v,) for v in (0.019, 0.02, 0.1, 0.3, 0.5)], "v double")
    got = [tuple(r) for r in df.select(numeric.iv_class(F.col("v")), numeric.psi_class(F.col("v"))).collect()]
    assert got == [
        ("Non prédictif", "Stable"),
        ("Faiblement prédictif", "Stable"),
        ("Moyennement prédictif", "Dérive légère"),
        ("Fortement prédictif", "Dérive significative"),
        ("Suspicieusement prédictif (vérifier)", "Dérive significative"),
    ]


def test_chi2_tail_against_finite_forms():
    for x in (0.01, 0.5, 3.84, 10.0, 60.0):
        h = x / 2
        assert chi2_tail(x, 2) == pytest.approx(math.exp(-h), rel=1e-12)
        assert chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(h)), rel=1e-11)
        ten = math.exp(-h) * sum(h**i / math.factorial(i) for i in range(5))
        assert chi2_tail(x, 10) == pytest.approx(ten, rel=1e-11)
    assert chi2_tail(5.0, 0) == 1.0
    # large degrees of freedom: close to the normal limit, no underflow to zero
    assert chi2_tail(100_000.0, 100_000) == pytest.approx(0.5, abs=1e-3)
    assert gamma_survival(2.0, 0.0) == 1.0


def test_normal_tail():
    assert normal_two_sided_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_unknown_column_is_refused_when_building(spark):
    with pytest.raises(ValueError, match="not in the table"):
        require(spark.range(1), "absent")
