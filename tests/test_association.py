import numpy as np
import pandas as pd
import pytest

from helpers import chi2_table, rows, sample_frame, to_spark
from riskloom.functions.pvalues import chi2_tail
from riskloom.operators import association


def expand(spark, counts):
    records = [(f"r{i}", f"c{j}") for i, row in enumerate(counts) for j, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(records, "a string, b string")


@pytest.mark.parametrize(
    "counts",
    [
        [[10, 4], [3, 9]],
        [[5, 5], [5, 5]],
        [[7, 0], [0, 3]],
        [[10, 2, 3], [4, 0, 9]],
        [[1, 2, 3], [4, 5, 6], [7, 8, 0], [0, 1, 1]],
        [[4, 6, 1]],
        [[4], [9]],
    ],
)
def test_chi2(spark, counts):
    got = association.chi2_test(expand(spark, counts), "a", "b").first()
    chi2, dof = chi2_table(counts)
    assert (got.dof, got.n) == (dof, np.sum(counts))
    assert got.chi2 == pytest.approx(chi2, abs=1e-9)
    assert got.p_value == pytest.approx(chi2_tail(chi2, dof), abs=1e-12)
    k = min(np.shape(counts)) - 1
    expected = np.sqrt(chi2 / (np.sum(counts) * k)) if k else 0.0
    assert got.v_cramer == pytest.approx(expected, abs=1e-9)


def test_corrected_two_by_two_hand_value(spark):
    got = association.chi2_test(expand(spark, [[10, 4], [3, 9]]), "a", "b").first()
    assert got.chi2 == pytest.approx(3.8690476, abs=1e-7)


def test_matrix(spark):
    frame = sample_frame(300)[["niveau", "mois", "y"]]
    got = {r["variable"]: r for r in association.cramers_v_matrix(to_spark(spark, frame)).collect()}
    for a in frame.columns:
        for b in frame.columns:
            if a == b:
                assert got[a][b] == 1.0
                continue
            table = pd.crosstab(frame[a], frame[b]).to_numpy()
            chi2, _ = chi2_table(table)
            v = np.sqrt(chi2 / (table.sum() * (min(table.shape) - 1)))
            assert got[a][b] == pytest.approx(v, abs=1e-9)
            assert got[a][b] == got[b][a] and 0 <= got[a][b] <= 1


def test_matrix_in_blocks(spark, monkeypatch):
    df = to_spark(spark, sample_frame(120)[["niveau", "mois", "y"]])
    whole = rows(association.cramers_v_matrix(df), "variable")
    monkeypatch.setattr(association, "PAIRS_PER_SCAN", 1)
    for split, full in zip(rows(association.cramers_v_matrix(df), "variable"), whole):
        assert split == pytest.approx(full)


def test_pair_without_complete_rows_is_null(spark):
    df = spark.createDataFrame([("a", None, "u"), (None, "b", "v"), ("c", None, "v")], "p string, q string, r string")
    got = {r["variable"]: r for r in association.cramers_v_matrix(df).collect()}
    assert got["p"]["q"] is None and got["p"]["p"] == 1.0


def test_hot_level_with_many_partners(spark):
    """A level holding a third of the rows meets a different partner on each of them."""
    n = 3000
    records = [("hot" if i % 3 == 0 else f"k{i % 5}", f"id{i}") for i in range(n)]
    got = association.chi2_test(spark.createDataFrame(records, "a string, b string"), "a", "b").first()
    levels = len({a for a, _ in records})
    assert got.dof == (levels - 1) * (n - 1)
    # every partner is unique, so the table is perfectly associated
    assert got.v_cramer == pytest.approx(1.0)
