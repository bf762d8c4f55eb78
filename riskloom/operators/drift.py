"""Population stability index between the first and the last month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import column, nan_to_null, require
from ..functions.numeric import PSI_ONE_PERIOD, floor_share, log_ratio, psi_class, ratio
from .levels import target_counts


def psi_of(cells: DataFrame, month: str, level: str, count: str = "effectif") -> DataFrame:
    """One row: PSI, its class and the two months compared.

    `cells` holds one row per month and level that occur. Rows with a NULL level only help to
    decide whether there are two months at all. Nothing is filtered, so the aggregate under
    `cells` keeps one plan and its shuffle is reused by every step; levels absent from both end
    months add nothing.
    """
    m, v, n = column(month), column(level), column(count)
    known = F.when(v.isNotNull(), m)
    ends = cells.agg(
        F.struct(
            F.min(known).alias("first"),
            F.max(known).alias("last"),
            F.coalesce(F.min(m) < F.max(m), F.lit(False)).alias("several"),
        )
    ).scalar()
    first, last, several = (ends.getField(f) for f in ("first", "last", "several"))
    sides = cells.groupBy(v.alias("level")).agg(
        F.coalesce(F.sum(F.when(known == first, n)), F.lit(0)).alias("ref"),
        F.coalesce(F.sum(F.when(known == last, n)), F.lit(0)).alias("act"),
    )
    sizes = sides.agg(F.struct(F.sum("ref").alias("ref"), F.sum("act").alias("act"))).scalar()
    ref = ratio(F.col("ref"), sizes.getField("ref"))
    act = ratio(F.col("act"), sizes.getField("act"))
    part = (floor_share(act) - floor_share(ref)) * log_ratio(act, ref)
    total = sides.select(part.alias("part")).agg(F.sum("part").alias("raw"))
    return total.select(
        F.when(several, F.col("raw")).alias("psi"),
        F.when(several, psi_class(F.col("raw"))).otherwise(F.lit(PSI_ONE_PERIOD)).alias("interpretation"),
        first.alias("periode_ref"),
        last.alias("periode_act"),
    )


def psi_table(df: DataFrame, variable: str, target: str, month: str) -> DataFrame:
    """PSI of a categorical variable, counting rows that have a target."""
    require(df, variable, target, month)
    cells = (
        df.select(nan_to_null(df, month).alias("m"), nan_to_null(df, variable).alias("v"), column(target))
        .groupBy("m", "v")
        .agg(*target_counts(df, target))
    )
    return psi_of(cells, "m", "v")
