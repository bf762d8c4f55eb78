"""Level tables: frequencies, entropy, target counts per level and per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import binary, column, missing, nan_to_null, present, require
from ..functions.numeric import percent, ratio
from ..sources.shared import write_shared
from .ordering import running_totals


def level_counts(df: DataFrame, variable: str) -> DataFrame:
    """(level, effectif) with the missing level kept as one NULL row."""
    require(df, variable)
    return df.groupBy(nan_to_null(df, variable).alias("level")).agg(F.count(F.lit(1)).alias("effectif"))


def frequencies_of(counts: DataFrame, name: str) -> DataFrame:
    """Frequency table from a written `level_counts`: shares over all rows, missing included, and
    the running share summed in whole hundredths, most frequent level first."""
    rows = counts.agg(F.sum("effectif")).scalar()
    hundredths = F.rint(ratio(F.col("effectif"), rows) * 100 * 100).cast("long")
    shares = counts.where(F.col("level").isNotNull()).withColumn("share", hundredths)
    ranked = running_totals(shares, [F.col("effectif").desc(), F.col("level").asc()], ["share"])
    return ranked.select(
        F.col("level").alias(name),
        "effectif",
        (F.col("share") / 100.0).alias("frequence_%"),
        ((F.col("share_before") + F.col("share")) / 100.0).alias("frequence_cum_%"),
    )


def frequency_table(df: DataFrame, variable: str) -> DataFrame:
    return frequencies_of(write_shared(level_counts(df, variable)), variable)


def entropy_of(counts: DataFrame) -> DataFrame:
    """One row: sizes, missing rate, number of levels, Shannon entropy and its 0-1 version."""
    is_level = F.col("level").isNotNull()
    filled = counts.agg(F.sum(F.when(is_level, F.col("effectif")))).scalar()
    share = ratio(F.col("effectif"), filled)
    summary = counts.agg(
        F.coalesce(F.sum("effectif"), F.lit(0)).alias("n_total"),
        F.coalesce(F.sum(F.when(~is_level, F.col("effectif"))), F.lit(0)).alias("n_missing"),
        F.count(F.when(is_level, 1)).alias("n_modalites"),
        (-F.sum(F.when(is_level, share * F.log2(share)))).alias("entropie"),
    )
    widest = F.when(F.col("n_modalites") > 1, F.log2(F.col("n_modalites").cast("double"))).otherwise(1.0)
    return summary.select(
        "n_total",
        "n_missing",
        percent(F.col("n_missing"), F.col("n_total")).alias("pct_missing"),
        "n_modalites",
        (F.col("entropie") + 0.0).alias("entropie"),
        (F.col("entropie") / widest + 0.0).alias("entropie_norm"),
    )


def entropy_table(df: DataFrame, variable: str) -> DataFrame:
    return entropy_of(level_counts(df, variable))


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Long contingency table (x, y, o) of the pairs that occur; missing pairs dropped."""
    require(df, x, y)
    return (
        df.where(present(df, x) & present(df, y))
        .groupBy(column(x).alias("x"), column(y).alias("y"))
        .agg(F.count(F.lit(1)).alias("o"))
    )


def target_counts(df: DataFrame, target: str) -> list[Column]:
    flag = binary(df, target)
    return [
        F.count(flag).alias("effectif"),
        F.coalesce(F.sum(flag), F.lit(0)).alias("nb_defaut"),
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "nb_non_defaut": F.col("effectif") - F.col("nb_defaut"),
            "taux_defaut_%": percent(F.col("nb_defaut"), F.col("effectif")),
        }
    )


def target_table(df: DataFrame, variable: str, target: str) -> DataFrame:
    """Per level: rows with a target, defaults, non-defaults and default rate."""
    require(df, variable, target)
    return with_rates(
        df.where(present(df, variable)).groupBy(column(variable)).agg(*target_counts(df, target))
    )


def monthly_table(df: DataFrame, variable: str, target: str, month: str) -> DataFrame:
    """`target_table` per month and level, for the pairs that occur."""
    require(df, variable, target, month)
    counts = (
        df.where(present(df, variable) & present(df, month))
        .groupBy(column(month), column(variable))
        .agg(*target_counts(df, target))
    )
    return with_rates(counts).drop("nb_non_defaut")


def global_rate_of(levels: DataFrame) -> DataFrame:
    return levels.agg(
        F.sum("effectif").alias("effectif"),
        F.sum("nb_defaut").alias("nb_defaut"),
        (ratio(F.sum("nb_defaut"), F.sum("effectif")) * 100).alias("taux_global_%"),
    )


def missing_rates(df: DataFrame, *columns: str) -> DataFrame:
    """One row per column: number of rows, of missing values, and the missing percentage."""
    names = list(columns) or df.columns
    require(df, *names)
    flags = df.select(*[missing(df, name).cast("int").alias(name) for name in names])
    wide = flags.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.coalesce(F.sum(column(name)), F.lit(0)).alias(name) for name in names],
    )
    return wide.unpivot(["_rows"], [column(name) for name in names], "variable", "n_missing").select(
        "variable",
        F.col("_rows").alias("n_total"),
        "n_missing",
        percent(F.col("n_missing"), F.col("_rows")).alias("pct_missing"),
    )


def month_list(df: DataFrame, month: str) -> DataFrame:
    require(df, month)
    return df.where(present(df, month)).select(column(month)).distinct()


def monthly_shares(monthly: DataFrame, month: str, variable: str, count: str = "effectif") -> DataFrame:
    """Share of each level within its month, in percent, for every month and level.

    Absent pairs count 0: each level is expanded over the list of months (a calendar, short by
    nature) rather than joined with every month.
    """
    m, v = column(month), column(variable)
    months = monthly.agg(F.collect_set(m)).scalar()
    full = monthly.groupBy(v).agg(F.map_from_entries(F.collect_list(F.struct(m, column(count)))).alias("_n"))
    full = full.select(v, F.explode(months).alias(month), "_n").select(
        m, v, F.coalesce(F.try_element_at("_n", m), F.lit(0)).alias("n")
    )
    sizes = monthly.groupBy(m).agg(F.sum(column(count)).alias("_size"))
    return full.join(sizes, month).select(
        m, v, "n", (ratio(F.col("n"), F.col("_size")) * 100).alias("part_%")
    )


# --- many variables in one scan -------------------------------------------------------------


def as_level(df: DataFrame, name: str) -> Column:
    """The value as a level string, missing as 'MISSING'."""
    return F.coalesce(nan_to_null(df, name).cast("string"), F.lit("MISSING"))


def per_variable(table: DataFrame, value: Column) -> Column:
    """The value of this row's variable, from a table of one row per variable.

    It travels as one map from a scalar subquery, which grows with the named variables, never with
    levels or rows, and needs no join on a key that a third of the rows may share.
    """
    entries = F.collect_list(F.struct("variable", value.alias("value")))
    return F.try_element_at(table.agg(F.map_from_entries(entries)).scalar(), F.col("variable"))


def levels_by_variable(
    df: DataFrame, variables: list[str], target: str, fill_missing: bool = True
) -> DataFrame:
    """(variable, level, effectif, n_cible, nb_defaut) for all variables from one scan.

    Rows are unpivoted to one per variable and combined on the map side, so the shuffle holds
    levels, not rows.
    """
    require(df, target, *variables)
    flag = binary(df, target).alias("_y")
    values = [
        (as_level(df, v) if fill_missing else nan_to_null(df, v).cast("string")).alias(v)
        for v in variables
    ]
    long = df.select(flag, *values).unpivot(["_y"], [column(v) for v in variables], "variable", "level")
    return (
        long.where(F.col("level").isNotNull())
        .groupBy("variable", "level")
        .agg(
            F.count(F.lit(1)).alias("effectif"),
            F.count("_y").alias("n_cible"),
            F.coalesce(F.sum("_y"), F.lit(0)).alias("nb_defaut"),
        )
    )


def modality_order(
    df: DataFrame, variables: list[str], target: str, sens: str = "croissant"
) -> DataFrame:
    """One row, one array column per variable: its levels ordered by number of defaults.

    Ties are broken by level, ascending. The array cell is the result the caller asks for, so
    this is meant for variables whose level list fits a cell; `levels_by_variable` is the long
    form for any size.
    """
    if sens not in ("croissant", "decroissant"):
        raise ValueError("sens must be 'croissant' or 'decroissant'")
    counts = levels_by_variable(df, variables, target, fill_missing=False)
    weight = F.col("nb_defaut") if sens == "croissant" else -F.col("nb_defaut")
    listed = counts.groupBy("variable").agg(
        F.sort_array(F.collect_list(F.struct(weight.alias("w"), F.col("level").alias("level")))).alias("s")
    )
    ordered = listed.select("variable", F.col("s.level").alias("levels"))
    empty = F.array().cast("array<string>")
    return ordered.groupBy().agg(
        *[
            F.coalesce(F.first(F.when(F.col("variable") == v, F.col("levels")), True), empty).alias(v)
            for v in variables
        ]
    )


def risk_order(df: DataFrame, variables: list[str], target: str) -> DataFrame:
    """(variable, level, rang, taux, ...) ranked by mean target, lowest first; ties by level."""
    counts = levels_by_variable(df, variables, target)
    rated = write_shared(
        counts.withColumns({"taux": ratio(F.col("nb_defaut"), F.col("n_cible")), "one": F.lit(1).cast("long")})
    )
    order = [F.col("variable").asc(), F.col("taux").asc_nulls_last(), F.col("level").asc()]
    ranked = running_totals(rated, order, ["one"])
    first = ranked.groupBy("variable").agg(F.min("one_before").alias("_first"))
    return ranked.select(
        "variable",
        "level",
        (F.col("one_before") - per_variable(first, F.col("_first"))).cast("int").alias("rang"),
        "taux",
        "effectif",
        "n_cible",
        "nb_defaut",
    )
