"""Full profile of a categorical variable against a binary target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import binary, nan_to_null, require
from ..operators.association import chi2_of
from ..operators.drift import psi_of
from ..operators.levels import entropy_of, frequencies_of, with_rates
from ..operators.woe import iv_of, woe_of
from ..sources.shared import write_shared
from .tables import Tables


def analyse_categorielle(
    df: DataFrame, var_cat: str, var_cible: str, var_mois: str | None = None
) -> Tables:
    """Tables: univarie, synthese, bivarie, tests and, with a month, temporel and psi.

    The table is scanned once, into counts by (level, month, target); everything else is
    computed from those counts, each table when it is first asked for.
    """
    require(df, var_cat, var_cible, var_mois)
    month = nan_to_null(df, var_mois) if var_mois else F.lit(None).cast("string")
    cells = write_shared(
        df.select(
            nan_to_null(df, var_cat).alias("level"), month.alias("month"), binary(df, var_cible).alias("y")
        )
        .groupBy("level", "month", "y")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    o, y, level = F.col("o"), F.col("y"), F.col("level")
    with_target = F.coalesce(F.sum(F.when(y.isNotNull(), o)), F.lit(0)).alias("effectif")
    defaults = F.coalesce(F.sum(o * y), F.lit(0)).alias("nb_defaut")

    counts = cells.groupBy("level").agg(F.sum("o").alias("effectif"))
    known = cells.where(level.isNotNull())
    levels = with_rates(known.groupBy(level.alias(var_cat)).agg(with_target, defaults))
    woe = woe_of(levels)

    def tests() -> DataFrame:
        pairs = known.where(y.isNotNull()).groupBy(level.alias("x"), "y").agg(F.sum("o").alias("o"))
        iv = iv_of(woe).agg(F.struct(F.first("iv_total").alias("v"), F.first("iv_interpretation").alias("c"))).scalar()
        return chi2_of(pairs).select(
            "chi2",
            "dof",
            "p_value",
            "v_cramer",
            iv.getField("v").alias("iv_total"),
            iv.getField("c").alias("iv_interpretation"),
        )

    tables = {
        "univarie": lambda: frequencies_of(write_shared(counts), var_cat),
        "synthese": lambda: entropy_of(counts),
        "bivarie": lambda: woe,
        "tests": tests,
    }
    if var_mois:
        dated = known.where(F.col("month").isNotNull())
        monthly = dated.groupBy(F.col("month").alias(var_mois), level.alias(var_cat)).agg(with_target, defaults)
        tables["temporel"] = lambda: with_rates(monthly).drop("nb_non_defaut")
        tables["psi"] = lambda: psi_of(cells.groupBy("month", "level").agg(with_target), "month", "level")
    return Tables(tables)
