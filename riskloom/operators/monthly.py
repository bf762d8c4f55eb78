"""Monthly counts of many variables from one scan, kept in a store that new months are added to.

A table of cells has one row per (variable, level, mois) that occurs, with the counts all monthly
tables are made of; levels are strings, and a missing level is NULL. Cells of separate rows add up,
so a store holds one batch of cells per delivery and old rows are never read again.

What is looked up per variable (its end months, its sizes per month) grows with the named variables
and the calendar only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import binary, column, nan_to_null, require
from ..functions.numeric import PSI_ONE_PERIOD, floor_share, log_ratio, percent, psi_class, ratio
from ..sources.shared import write_shared
from .levels import per_variable

KEYS = ["variable", "level", "mois"]
COUNTS = ["n", "effectif", "nb_defaut"]


def month_cells(df: DataFrame, variables: list[str], target: str, month: str) -> DataFrame:
    """(variable, level, mois, n, effectif, nb_defaut): rows, rows with a target, defaults.

    Rows without a month are left out. An empty table has no cells.
    """
    require(df, target, month, *variables)
    values = [nan_to_null(df, v).cast("string").alias(v) for v in variables]
    keyed = df.select(nan_to_null(df, month).alias("_m"), binary(df, target).alias("_y"), *values)
    long = keyed.where(F.col("_m").isNotNull()).unpivot(["_m", "_y"], [column(v) for v in variables], "variable", "level")
    return long.groupBy("variable", "level", F.col("_m").alias("mois")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_y").alias("effectif"),
        F.coalesce(F.sum("_y"), F.lit(0)).cast("long").alias("nb_defaut"),
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """One row per key from cells of several batches."""
    return cells.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def store_batch(cells: DataFrame, folder: str, batch: str) -> None:
    """Write one delivery's cells to the store. Writing a batch again replaces it, so a job that was
    interrupted is simply run again and counts no row twice."""
    if not re.fullmatch(r"\w[\w.-]*", batch):
        raise ValueError(f"a batch name has letters, digits, '_', '.' and '-' only: {batch!r}")
    cells.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All batches of a store, merged."""
    return merge_cells(spark.read.parquet(folder.rstrip("/")).drop("batch"))


def rates_of(cells: DataFrame) -> DataFrame:
    """Target table per variable, month and present level."""
    present = cells.where(F.col("level").isNotNull())
    return present.select(
        "variable", "mois", "level", "effectif", "nb_defaut",
        percent(F.col("nb_defaut"), F.col("effectif")).alias("taux_defaut_%"),
    )


def shares_of(cells: DataFrame) -> DataFrame:
    """(variable, mois, level, n, part_%): share of a level among its variable's rows with a target of
    the month, for every month of the variable; absent levels count 0."""
    present = cells.where(F.col("level").isNotNull())
    sizes = present.groupBy("variable", "mois").agg(F.sum("effectif").alias("taille"))
    calendar = sizes.groupBy("variable").agg(F.collect_list(F.struct("mois", "taille")).alias("mois"))
    levels = present.groupBy("variable", "level").agg(
        F.map_from_entries(F.collect_list(F.struct("mois", "effectif"))).alias("_n")
    )
    full = levels.select("variable", "level", "_n", F.explode(per_variable(calendar, F.col("mois"))).alias("_m"))
    n = F.coalesce(F.try_element_at("_n", F.col("_m.mois")), F.lit(0))
    return full.select(
        "variable", F.col("_m.mois").alias("mois"), "level", n.alias("n"),
        (ratio(n, F.col("_m.taille")) * 100).alias("part_%"),
    )


def psi_of_variables(cells: DataFrame) -> DataFrame:
    """(variable, psi, interpretation, periode_ref, periode_act): first against last month in which a
    variable has a level, counting rows that have a target.

    Rows without a level only help to decide whether there are two months at all.
    """
    m, n = F.col("mois"), F.col("effectif")
    known = F.when(F.col("level").isNotNull(), m)
    ends = cells.groupBy("variable").agg(
        F.min(known).alias("first"), F.max(known).alias("last"), (F.min(m) < F.max(m)).alias("several")
    )
    end = per_variable(ends, F.struct("first", "last", "several"))
    marked = cells.withColumn("_end", end)
    sides = marked.groupBy("variable", "level").agg(
        *[
            F.coalesce(F.sum(F.when(known == F.col("_end").getField(side), n)), F.lit(0)).alias(side)
            for side in ("first", "last")
        ]
    )
    totals = sides.groupBy("variable").agg(F.sum("first").alias("first"), F.sum("last").alias("last"))
    sized = sides.withColumn("_size", per_variable(totals, F.struct("first", "last")))
    ref = ratio(F.col("first"), F.col("_size.first"))
    act = ratio(F.col("last"), F.col("_size.last"))
    part = (floor_share(act) - floor_share(ref)) * log_ratio(act, ref)
    summed = sized.select("variable", part.alias("part")).groupBy("variable").agg(F.sum("part").alias("raw"))
    several = F.col("_end.several")
    return summed.withColumn("_end", end).select(
        "variable",
        F.when(several, F.col("raw")).alias("psi"),
        F.when(several, psi_class(F.col("raw"))).otherwise(F.lit(PSI_ONE_PERIOD)).alias("interpretation"),
        F.col("_end.first").alias("periode_ref"),
        F.col("_end.last").alias("periode_act"),
    )


def monthly_profile(df: DataFrame, variables: list[str], target: str, month: str) -> dict[str, DataFrame]:
    """Rates, shares and PSI of many variables; the rows are read once, into written cells."""
    cells = write_shared(month_cells(df, variables, target, month))
    return {"taux": rates_of(cells), "parts": shares_of(cells), "psi": psi_of_variables(cells)}
