"""Digitising and binning numeric columns; thresholds read from tree dumps."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import column, missing, require, require_numeric
from ..functions.numeric import cuts_passed
from .levels import as_level
from .ranks import exact_quantiles

MISSING_BIN = -1


@dataclass(frozen=True)
class Bin:
    """Interval (lo, hi]; `lo`/`hi` are the contract, the label is for display."""

    bin_id: int
    tranche: str
    lo: float | None
    hi: float | None


BIN_SCHEMA = T.StructType(
    [
        T.StructField("bin_id", T.IntegerType(), False),
        T.StructField("tranche", T.StringType(), False),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
    ]
)


def bins_frame(spark: SparkSession, bins: Sequence[Bin]) -> DataFrame:
    return spark.createDataFrame([(b.bin_id, b.tranche, b.lo, b.hi) for b in bins], BIN_SCHEMA)


# --- bins from thresholds or quantile edges ---------------------------------------------------


def threshold_bins(thresholds: Sequence[float]) -> list[Bin]:
    """(-inf, t1], (t1, t2], ..., (tk, +inf). Repeated thresholds are an error."""
    cuts = sorted(thresholds)
    if len(set(cuts)) != len(cuts):
        raise ValueError(f"thresholds must be distinct: {cuts}")
    ends = [-math.inf, *cuts, math.inf]
    bins = []
    for i, (low, high) in enumerate(zip(ends, ends[1:])):
        if low == -math.inf:
            label = f"≤ {high}"
        elif high == math.inf:
            label = f"> {low}"
        else:
            label = f"]{low}, {high}]"
        bins.append(Bin(i, label, float(low), float(high)))
    return bins


def _shorten(edge: float, precision: int) -> float:
    """Edge at `precision` decimals, or at that many digits after the leading zeros of a pure
    fraction."""
    if not math.isfinite(edge) or edge == 0:
        return edge
    whole = math.trunc(edge)
    if whole == 0:
        precision += -math.floor(math.log10(abs(edge - whole))) - 1
    return float(round(edge, precision))


def quantile_bins(edges: Sequence[float | None]) -> list[Bin]:
    """Bins between the distinct quantile edges, the lowest edge included.

    Labels show the fewest decimals, from three up, that keep the edges apart. A column with a
    single distinct edge gets one bin labelled 'nan'.
    """
    cuts = sorted({float(e) for e in edges if e is not None})
    if len(cuts) < 2:
        return [Bin(0, "nan", None, None)]
    precision = next(
        (p for p in range(3, 20) if len({_shorten(c, p) for c in cuts}) == len(cuts)), 3
    )
    shown = [_shorten(c, precision) for c in cuts]
    shown[0] -= 10.0**-precision
    return [
        Bin(i, f"({shown[i]}, {shown[i + 1]}]", cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1)
    ]


def bin_id(value: Column, bins: Sequence[Bin]) -> Column:
    """Bin number of a present value; right-closed intervals, ends open to infinity."""
    return cuts_passed(value, [b.lo for b in bins[1:]], inclusive=False)


def with_bins(df: DataFrame, variable: str, bins: Sequence[Bin], name: str = "bin_id") -> DataFrame:
    """Add the bin number; missing values get NULL."""
    require_numeric(df, variable)
    return df.withColumn(name, F.when(~missing(df, variable), bin_id(column(variable), bins)))


def quantile_edges(df: DataFrame, variable: str, n_bins: int) -> list[float | None]:
    return exact_quantiles(df, variable, edge_probs(n_bins))


def edge_probs(n_bins: int) -> list[float]:
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    return [i / n_bins for i in range(n_bins + 1)]


def winsorise(df: DataFrame, variable: str, limits: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Clip a column to two of its exact quantiles; missing values stay missing."""
    low, high = exact_quantiles(df, variable, list(limits))
    value = column(variable)
    clipped = F.when(missing(df, variable), value).otherwise(
        F.least(F.greatest(value, F.lit(low)), F.lit(high))
    )
    return df.withColumn(variable, clipped)


# --- digitising whole tables ------------------------------------------------------------------


def transform_numeric_column(df: DataFrame, variable: str, bins: Sequence[float]) -> Column:
    """How many of the sorted thresholds are at or below the value; missing is -1."""
    require_numeric(df, variable)
    cuts = [float(b) for b in bins]
    if cuts != sorted(cuts):
        raise ValueError(f"thresholds must be sorted: {cuts}")
    return F.when(missing(df, variable), F.lit(MISSING_BIN)).otherwise(
        cuts_passed(column(variable), cuts, inclusive=True)
    )


def transform_categorical_column(df: DataFrame, variable: str) -> Column:
    """The value as a string, missing as 'MISSING'."""
    return as_level(df, variable)


def transform_dataframe(df: DataFrame, thresholds: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every column in one projection: digitised if it has thresholds, else as a level."""
    return df.select(
        *[
            (
                transform_numeric_column(df, name, thresholds[name])
                if name in thresholds
                else transform_categorical_column(df, name)
            ).alias(name)
            for name in df.columns
        ]
    )


# --- thresholds from tree dumps -----------------------------------------------------------------


def extract_thresholds(trees: DataFrame, json: str = "tree") -> DataFrame:
    """(feature, bins): the distinct root split conditions per feature, sorted.

    `trees` holds one JSON document per tree. Roots that split on categories and trees that
    are a single leaf are left out.
    """
    require(trees, json)
    text = column(json)
    roots = trees.select(
        F.get_json_object(text, "$.split").alias("feature"),
        F.get_json_object(text, "$.split_condition").cast("double").alias("threshold"),
        F.coalesce(F.array_contains(F.json_object_keys(text), "categories"), F.lit(False)).alias("categorical"),
    )
    return (
        roots.where(~F.col("categorical") & F.col("feature").isNotNull() & F.col("threshold").isNotNull())
        .groupBy("feature")
        .agg(F.sort_array(F.collect_set("threshold")).alias("bins"))
    )


def thresholds_map(thresholds: DataFrame) -> dict[str, list[float]]:
    """The small (feature, bins) table as the mapping `transform_dataframe` takes."""
    return {row["feature"]: list(row["bins"]) for row in thresholds.toLocalIterator()}


def thresholds_frame(spark: SparkSession, thresholds: Mapping[str, Sequence[float]]) -> DataFrame:
    rows = [(feature, [float(b) for b in bins]) for feature, bins in thresholds.items()]
    return spark.createDataFrame(rows, "feature string, bins array<double>")


def build_bin_description(thresholds: DataFrame) -> DataFrame:
    """Readable intervals per feature: bin 0 from -inf, the last to +inf, and bin -1 for missing.

    `thresholds` is (feature, bins). Intervals are [lo, hi), as `transform_numeric_column` counts.
    """
    infinity = F.lit(math.inf)
    lows = F.concat(F.array(-infinity), F.col("bins"))
    highs = F.concat(F.col("bins"), F.array(infinity))
    pairs = F.arrays_zip(lows.alias("lo"), highs.alias("hi"))
    intervals = thresholds.select("feature", F.posexplode(pairs).alias("bin_id", "edge")).select(
        "feature", "bin_id", F.col("edge.lo").alias("lo"), F.col("edge.hi").alias("hi"), F.lit(False).alias("is_missing")
    )
    gone = thresholds.select(
        "feature",
        F.lit(MISSING_BIN).alias("bin_id"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        F.lit(True).alias("is_missing"),
    )
    return intervals.unionByName(gone)


# --- target tables over bins --------------------------------------------------------------------


def fill_bins(counts: DataFrame, bins: Sequence[Bin], keep_empty: bool) -> DataFrame:
    """Attach labels to (bin_id, effectif, nb_defaut); empty bins are kept on request."""
    frame = bins_frame(counts.sparkSession, bins)
    joined = frame.join(counts, "bin_id", "left" if keep_empty else "inner")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in counts.columns if c != "bin_id"}
    )


def fill_months(counts: DataFrame, month: str, bins: Sequence[Bin], keep_empty: bool) -> DataFrame:
    """Like `fill_bins` per month: with `keep_empty`, every observed month gets every bin."""
    frame = bins_frame(counts.sparkSession, bins)
    if not keep_empty:
        return counts.join(frame, "bin_id")
    m = column(month)
    # the bins of a month are packed in one map, then laid out over the full bin list
    values = [c for c in counts.columns if c not in (month, "bin_id")]
    packed = counts.groupBy(m).agg(
        F.map_from_entries(F.collect_list(F.struct("bin_id", F.struct(*values)))).alias("_by_bin")
    )
    every = F.explode(F.array(*[F.lit(b.bin_id) for b in bins])).alias("bin_id")
    full = packed.select(m, every, "_by_bin").withColumn("_c", F.try_element_at("_by_bin", F.col("bin_id")))
    return full.select(
        m, "bin_id", *[F.coalesce(F.col(f"_c.{c}"), F.lit(0)).alias(c) for c in values]
    ).join(frame, "bin_id")
