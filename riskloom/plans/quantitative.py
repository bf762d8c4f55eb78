"""Full profile of a numeric variable against a binary target."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import binary, column, nan_to_null, require, require_numeric
from ..operators.binning import (
    Bin,
    bin_id,
    edge_probs,
    fill_bins,
    fill_months,
    quantile_bins,
    threshold_bins,
)
from ..operators.drift import psi_of
from ..operators.levels import with_rates
from ..operators.ranks import (
    QUARTILES,
    SUMMARY_QUANTILES,
    class_tests_of,
    histogram_quantiles,
    numeric_report,
    summary_of,
    value_histogram,
)
from ..operators.woe import iv_of, woe_of
from ..sources.shared import write_shared
from .tables import Tables


def analyse_quantitative(
    df: DataFrame,
    var_quanti: str,
    var_cible: str,
    var_mois: str | None = None,
    seuils: Sequence[float] | None = None,
    n_tranches: int = 5,
    winsor_limits: tuple[float, float] = (0.01, 0.99),
) -> Tables:
    """Tables: univarie, winsorisation, tests, bivarie, iv and, with a month, temporel and psi.

    Two scans: one into a value histogram, from which every order statistic and the quantile
    edges come, and one into counts by (month, bin, target). A table's jobs run when it is first
    asked for.
    """
    require_numeric(df, var_quanti)
    require(df, var_cible, var_mois)
    edges = [] if seuils is not None else edge_probs(n_tranches)
    histogram = value_histogram(df, var_quanti, var_cible, var_mois)
    keep_empty = seuils is not None
    sums = [F.sum("effectif").alias("effectif"), F.sum("nb_defaut").alias("nb_defaut")]

    @cache
    def report():
        wanted = {"n": [*SUMMARY_QUANTILES, *winsor_limits], "n0": QUARTILES, "n1": QUARTILES}
        return numeric_report(histogram, wanted)

    @cache
    def binned() -> tuple[DataFrame, list[Bin], list[Bin]]:
        if seuils is not None:
            bins = dated_bins = threshold_bins(seuils)
        else:
            found = histogram_quantiles(histogram, {"m": edges} | ({"mm": edges} if var_mois else {}))
            bins = quantile_bins(found["m"])
            dated_bins = quantile_bins(found["mm"]) if var_mois else bins
        cells = write_shared(_bin_cells(df, var_quanti, var_cible, var_mois, bins, dated_bins))
        return cells, bins, dated_bins

    def limits() -> DataFrame:
        low, high = report().quantiles["n"][len(SUMMARY_QUANTILES) :]
        return df.sparkSession.createDataFrame([(low, high)], "bas double, haut double")

    def woe() -> DataFrame:
        cells, bins, _ = binned()
        return woe_of(with_rates(fill_bins(cells.groupBy("bin_id").agg(*sums), bins, keep_empty)), "IV_tranche")

    def dated() -> DataFrame:
        keys = F.col("month").alias(var_mois), F.col("dated_bin").alias("bin_id")
        return binned()[0].where(F.col("month").isNotNull()).groupBy(*keys).agg(*sums)

    def monthly() -> DataFrame:
        return with_rates(fill_months(dated(), var_mois, binned()[2], keep_empty)).drop("nb_non_defaut")

    tables = {
        "univarie": lambda: summary_of(report(), df),
        "winsorisation": limits,
        "tests": lambda: class_tests_of(report(), df),
        "bivarie": woe,
        "iv": lambda: iv_of(woe(), "IV_tranche").withColumnRenamed("iv_interpretation", "interpretation"),
    }
    if var_mois:
        tables["temporel"] = monthly
        tables["psi"] = lambda: psi_of(dated(), var_mois, "bin_id")
    return Tables(tables)


def _bin_cells(
    df: DataFrame, variable: str, target: str, month: str | None, bins: list[Bin], dated_bins: list[Bin]
) -> DataFrame:
    """Counts by month, bin and bin on the dated rows, over rows with a value and a target."""
    dated = nan_to_null(df, month) if month else F.lit(None).cast("string")
    value = nan_to_null(df, variable).cast("double")
    rows = df.select(dated.alias("month"), value.alias("v"), binary(df, target).alias("y")).where(
        column("v").isNotNull() & column("y").isNotNull()
    )
    v = column("v")
    return (
        rows.groupBy("month", bin_id(v, bins).alias("bin_id"), bin_id(v, dated_bins).alias("dated_bin"))
        .agg(F.count(F.lit(1)).alias("effectif"), F.sum("y").alias("nb_defaut"))
    )


def bin_woe_table(
    df: DataFrame,
    variable: str,
    target: str,
    seuils: Sequence[float] | None = None,
    n_tranches: int = 5,
) -> DataFrame:
    """WoE/IV table over threshold bins (all kept) or quantile bins (those that occur)."""
    require_numeric(df, variable)
    require(df, target)
    if seuils is not None:
        bins = threshold_bins(seuils)
    else:
        histogram = value_histogram(df, variable, target)
        bins = quantile_bins(histogram_quantiles(histogram, {"m": edge_probs(n_tranches)})["m"])
    cells = _bin_cells(df, variable, target, None, bins, bins)
    by_bin = cells.groupBy("bin_id").agg(F.sum("effectif").alias("effectif"), F.sum("nb_defaut").alias("nb_defaut"))
    return woe_of(with_rates(fill_bins(by_bin, bins, seuils is not None)), "IV_tranche")
