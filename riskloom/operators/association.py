"""Chi-squared independence test and Cramér's V, for one pair or for every pair of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import nan_to_null, require
from ..functions.numeric import ratio
from ..functions.pvalues import chi2_tail
from .levels import contingency

# Column pairs expanded per row in one pass; wider tables are handled in several passes.
PAIRS_PER_SCAN = 300


def _test_columns() -> list[Column]:
    """chi2, dof and V from the per-pair sums (n, r, c, cells, fit, expected, rr, cc)."""
    r, c, n = F.col("r"), F.col("c"), F.col("n").cast("double")
    dof = (r - 1) * (c - 1)
    # Cells with no rows contribute their expected count.
    empty = F.when(F.col("cells") == r * c, F.lit(0.0)).otherwise(F.greatest(n - F.col("expected"), F.lit(0.0)))
    plain = F.col("fit") + empty
    # 2x2: all four gaps |O-E| are equal; the correction shortens each by at most one half.
    margins = (n * n - F.col("rr")) * (n * n - F.col("cc")) / 4.0
    gap = F.sqrt(plain * margins / (n * n * n))
    kept = F.coalesce(F.try_divide(gap - F.least(gap, F.lit(0.5)), gap), F.lit(0.0))
    chi2 = F.when(dof == 0, 0.0).when(dof == 1, plain * kept * kept).otherwise(plain)
    k = F.least(r, c) - 1
    return [
        F.col("n"),
        dof.alias("dof"),
        chi2.alias("chi2"),
        F.when(k > 0, F.sqrt(ratio(chi2, n * k))).otherwise(F.lit(0.0)).alias("v_cramer"),
    ]


def _pair_sums(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sums behind the test for each group `by` of long cells (x, y, o).

    Margins come from aggregates joined back to the cells, not from windows: a level holding a
    third of the rows may meet any number of partners, and adaptive execution splits such a
    join, or broadcasts a margin table once its size is known to be small.
    """
    rows = cells.groupBy(*by, "x").agg(F.sum("o").alias("row_n"))
    cols = cells.groupBy(*by, "y").agg(F.sum("o").alias("col_n"))
    if by:
        # the group sizes travel with the margins, which are far fewer than the cells
        rows = rows.join(cells.groupBy(*by).agg(F.sum("o").alias("pair_n")), by)
    else:
        rows = rows.withColumn("pair_n", cells.agg(F.sum("o")).scalar())
    joined = cells.join(rows, [*by, "x"]).join(cols, [*by, "y"])
    o, row_n, col_n = (F.col(name).cast("double") for name in ("o", "row_n", "col_n"))
    expected = row_n * col_n / F.col("pair_n")
    return joined.groupBy(*by).agg(
        F.sum("o").alias("n"),
        F.count(F.lit(1)).alias("cells"),
        # each row's cells share out one, so these sums count rows and columns
        F.rint(F.sum(o / row_n)).cast("long").alias("r"),
        F.rint(F.sum(o / col_n)).cast("long").alias("c"),
        F.sum((o - expected) * (o - expected) / expected).alias("fit"),
        F.sum(expected).alias("expected"),
        F.sum(o * row_n).alias("rr"),
        F.sum(o * col_n).alias("cc"),
    )


def chi2_of(cells: DataFrame) -> DataFrame:
    """One row (n, dof, chi2, v_cramer, p_value) from a long contingency table (x, y, o)."""
    n, dof, chi2, v = _pair_sums(cells, []).select(*_test_columns()).first()
    p = None if chi2 is None else chi2_tail(chi2, dof)
    return cells.sparkSession.createDataFrame(
        [(n, dof, chi2, v, p)], "n long, dof long, chi2 double, v_cramer double, p_value double"
    )


def chi2_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Independence test of two columns, with the continuity correction on 2x2 tables."""
    return chi2_of(contingency(df, x, y))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Cramér's V of two columns (0 when either has a single level)."""
    return _pair_sums(contingency(df, x, y), []).select(*_test_columns()).select("v_cramer")


def cramers_v_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(variable_1, variable_2, v_cramer) for each unordered pair of columns, from one scan.

    Rows are first combined into distinct rows with a count, so that each of them, not each row
    of the table, is expanded to one record per pair of columns; at worst, with every row
    distinct, that adds one shuffle of rows to the shuffle of their pairs. The records combine
    on the map side into contingency cells.
    """
    names = list(columns or df.columns)
    require(df, *names)
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        raise ValueError("at least two columns are needed")
    keys = [f"c{i}" for i in range(len(names))]
    values = df.select(*[nan_to_null(df, name).cast("string").alias(key) for name, key in zip(names, keys)])
    distinct = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"))
    by = ["variable_1", "variable_2"]
    result = None
    for start in range(0, len(pairs), PAIRS_PER_SCAN):
        records = F.array(
            *[
                F.struct(
                    F.lit(names[i]).alias("variable_1"),
                    F.lit(names[j]).alias("variable_2"),
                    F.col(keys[i]).alias("x"),
                    F.col(keys[j]).alias("y"),
                )
                for i, j in pairs[start : start + PAIRS_PER_SCAN]
            ]
        )
        cells = (
            distinct.select("w", F.explode(records).alias("p"))
            .select("w", "p.*")
            .where(F.col("x").isNotNull() & F.col("y").isNotNull())
            .groupBy(*by, "x", "y")
            .agg(F.sum("w").alias("o"))
        )
        block = _pair_sums(cells, by).select(*by, *_test_columns()).select(*by, "v_cramer")
        result = block if result is None else result.unionByName(block)
    return result


def cramers_v_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Square matrix: one row per column of `df`, one value per column, diagonal 1.

    A pair with no complete rows is NULL.
    """
    names = list(columns or df.columns)
    pairs = cramers_v_pairs(df, names)
    # each value is laid out for both halves of the matrix
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("variable_1").alias("variable"), F.col("variable_2").alias("other"), "v_cramer"),
                F.struct(F.col("variable_2").alias("variable"), F.col("variable_1").alias("other"), "v_cramer"),
            )
        ).alias("e")
    ).select("e.*")
    found = both.groupBy("variable").agg(
        *[F.first(F.when(F.col("other") == name, F.col("v_cramer")), True).alias(f"v{i}") for i, name in enumerate(names)]
    )
    # a column without any complete pair still has its row
    rows = df.sparkSession.createDataFrame([(name,) for name in names], "variable string")
    return rows.join(found, "variable", "left").select(
        "variable",
        *[
            F.when(F.col("variable") == name, F.lit(1.0)).otherwise(F.col(f"v{i}")).alias(name)
            for i, name in enumerate(names)
        ],
    )
