"""Weight of evidence and information value from a level table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import iv_class, log_ratio, ratio, round_even
from .levels import levels_by_variable, per_variable, target_table, with_rates


def woe_of(levels: DataFrame, iv_column: str = "IV_modalite") -> DataFrame:
    """Add class shares, WoE (4 decimals) and the IV part (6 decimals, from the rounded WoE).

    The two class totals come from a scalar subquery over the same aggregate, whose shuffle is
    reused, so no level list passes through one task and the source is scanned once.
    """
    totals = levels.agg(
        F.struct(F.sum("nb_defaut").alias("bad"), F.sum("nb_non_defaut").alias("good"))
    ).scalar()
    return _weigh(levels, totals.getField("bad"), totals.getField("good"), iv_column)


def _weigh(levels: DataFrame, bad: Column, good: Column, iv_column: str) -> DataFrame:
    shared = levels.withColumns(
        {
            "dist_defaut": ratio(F.col("nb_defaut"), bad),
            "dist_non_defaut": ratio(F.col("nb_non_defaut"), good),
        }
    )
    weighted = shared.withColumn(
        "WoE", round_even(log_ratio(F.col("dist_non_defaut"), F.col("dist_defaut")), 4)
    )
    gap = F.col("dist_non_defaut") - F.col("dist_defaut")
    return weighted.withColumn(iv_column, round_even(gap * F.col("WoE"), 6))


def _iv_total(iv_column: str) -> Column:
    """Sum of the rounded parts, in whole millionths so that it is exact."""
    millionths = F.sum(F.rint(F.col(iv_column) * 1e6).cast("long"))
    return F.coalesce(millionths, F.lit(0)) / 1e6


def woe_table(df: DataFrame, variable: str, target: str) -> DataFrame:
    return woe_of(target_table(df, variable, target))


def iv_of(woe: DataFrame, iv_column: str = "IV_modalite") -> DataFrame:
    """One row: total information value and its class."""
    total = woe.agg(_iv_total(iv_column).alias("iv_total"))
    return total.withColumn("iv_interpretation", iv_class(F.col("iv_total")))


def information_value(df: DataFrame, variable: str, target: str) -> DataFrame:
    return iv_of(woe_table(df, variable, target))


def woe_by_variable(df: DataFrame, variables: list[str], target: str) -> DataFrame:
    """WoE/IV table of many variables from one scan: (variable, level, ...), levels as strings.

    The class totals of the variables travel as one map, not as a join by name.
    """
    counts = levels_by_variable(df, variables, target, fill_missing=False).select(
        "variable", "level", F.col("n_cible").alias("effectif"), "nb_defaut"
    )
    levels = with_rates(counts)
    totals = levels.groupBy("variable").agg(F.sum("nb_defaut").alias("_bad"), F.sum("nb_non_defaut").alias("_good"))
    sized = levels.withColumn("_all", per_variable(totals, F.struct("_bad", "_good")))
    return _weigh(sized, F.col("_all._bad"), F.col("_all._good"), "IV_modalite").drop("_all")


def iv_by_variable(df: DataFrame, variables: list[str], target: str) -> DataFrame:
    """(variable, iv_total, iv_interpretation) for many variables from one scan."""
    summed = woe_by_variable(df, variables, target).groupBy("variable").agg(_iv_total("IV_modalite").alias("iv_total"))
    return summed.withColumn("iv_interpretation", iv_class(F.col("iv_total")))


def woe_bars(woe: DataFrame, variable: str, iv_column: str = "IV_modalite") -> DataFrame:
    """Bar lengths of the WoE chart with the side each bar points to."""
    side = F.when(F.col("WoE") >= 0, F.lit("positif")).otherwise(F.lit("negatif"))
    return woe.select(variable, "WoE", side.alias("cote"), iv_column)
