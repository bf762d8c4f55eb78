"""Exact order statistics and rank tests from one value histogram.

The histogram (distinct value -> counts) is combined on the map side, so a value held by a
third of the rows is one row of it. Sizes and means come from one aggregate over the histogram,
rank sums, central moments and quantiles from one aggregate over its running totals; only those
two rows reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import binary, nan_to_null, present, require, require_numeric
from ..functions.numeric import ratio, rint_number
from ..functions.pvalues import erfc_tail
from ..sources.shared import write_shared
from .ordering import running_totals

# Quantiles of the numeric summary.
SUMMARY_QUANTILES = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
QUARTILES = [0.25, 0.5, 0.75]

CLASSES = {"n": "all", "n0": "non_defaut", "n1": "defaut"}


def value_histogram(
    df: DataFrame, variable: str, target: str | None = None, month: str | None = None
) -> DataFrame:
    """Written table of distinct values v (missing as one NULL row) with row counts:
    n all rows and, with a target, m rows with one, mm rows with one and a month, n0/n1 by class."""
    require_numeric(df, variable)
    require(df, target, month)
    v = nan_to_null(df, variable).cast("double").alias("v")
    if target is None:
        return write_shared(df.select(v).groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    dated = present(df, month) if month else F.lit(True)
    y = F.col("y")
    counts = (
        df.select(v, binary(df, target).alias("y"), dated.alias("dated"))
        .groupBy("v")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(y).alias("m"),
            F.count(F.when(F.col("dated"), y)).alias("mm"),
            F.count_if(y == 0).alias("n0"),
            F.count_if(y == 1).alias("n1"),
        )
    )
    return write_shared(counts)


def histogram_sizes(histogram: DataFrame) -> dict[str, int]:
    """Rows of each population that have a value, and the number of distinct values."""
    known = F.col("v").isNotNull()
    counts = [c for c in histogram.columns if c != "v"]
    sums = [F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).alias(c) for c in counts]
    return histogram.agg(F.count("v").alias("values"), *sums).first().asDict()


def ranked_values(histogram: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Running totals of the counts over the ascending known values."""
    known = histogram.where(F.col("v").isNotNull()).select("v", *counts)
    return running_totals(known, [F.col("v").asc()], counts)


class _Picks:
    """Aggregates over the ranked histogram that find the values around each quantile.

    Values ascend with the rows before them, so the value at a rank is the largest one with no
    more than that many rows before it. Populations of equal size are the same rows (each is a
    subset of the one before) and share their picks.
    """

    def __init__(self, wanted: Mapping[str, Sequence[float]], sizes: Mapping[str, int]):
        self.wanted = {count: list(probs) for count, probs in wanted.items()}
        self.sizes = sizes
        nested = [c for c in ("n", "m", "mm") if c in sizes]
        self.same = {c: next((d for d in nested if sizes[d] == sizes[c]), c) if c in nested else c for c in self.wanted}
        self.ranks = sorted(
            {
                (self.same[c], rank)
                for c, probs in self.wanted.items()
                if sizes[c]
                for q in probs
                for rank in _around(q, sizes[c])
            }
        )

    @property
    def counts(self) -> list[str]:
        return sorted({c for c, _ in self.ranks})

    def columns(self) -> list[Column]:
        return [
            F.max(F.when(F.col(f"{c}_before") <= F.lit(rank), F.col("v"))).alias(f"{c}_at_{rank}")
            for c, rank in self.ranks
        ]

    def quantiles(self, row) -> dict[str, list[float | None]]:
        return {c: [self._quantile(row, c, q) for q in probs] for c, probs in self.wanted.items()}

    def _quantile(self, row, count: str, q: float) -> float | None:
        size = self.sizes[count]
        if not size:
            return None
        low, high = _around(q, size)
        a, b = (row[f"{self.same[count]}_at_{rank}"] for rank in (low, high))
        return a if a == b else a + (b - a) * (q * (size - 1) - low)


def _around(q: float, size: int) -> tuple[int, int]:
    position = q * (size - 1)
    return math.floor(position), math.ceil(position)


def histogram_quantiles(
    histogram: DataFrame, wanted: Mapping[str, Sequence[float]]
) -> dict[str, list[float | None]]:
    """Linear quantiles of several populations (count column -> probabilities) in one pass."""
    sizes = histogram_sizes(histogram)
    picks = _Picks(wanted, sizes)
    if not picks.ranks:
        return picks.quantiles({})
    ranked = ranked_values(histogram, picks.counts)
    return picks.quantiles(ranked.agg(*picks.columns()).first())


def exact_quantiles(df: DataFrame, variable: str, probs: Sequence[float]) -> list[float | None]:
    """Exact linear quantiles of a column, as numbers."""
    return histogram_quantiles(value_histogram(df, variable), {"n": probs})["n"]


@dataclass(frozen=True)
class NumericReport:
    """Order statistics and moments of a numeric column, and of its two classes if a target
    was given. Numbers only: every table below is one row made of them."""

    rows: int
    missing: int
    sizes: dict[str, int]
    means: dict[str, float | None]
    stds: dict[str, float | None]
    low: float | None
    high: float | None
    skewness: float | None
    kurtosis: float | None
    quantiles: dict[str, list[float | None]]
    tests: dict[str, float | None] = field(default_factory=dict)


def numeric_report(
    histogram: DataFrame,
    probs: Mapping[str, Sequence[float]],
) -> NumericReport:
    """`probs` lists the quantiles wanted per count column of the histogram."""
    counts = [c for c in CLASSES if c in histogram.columns]
    populations = [c for c in histogram.columns if c != "v"]
    v = F.col("v")
    first = histogram.agg(
        F.count("v").alias("values"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        *[F.coalesce(F.sum(F.when(v.isNotNull(), F.col(c))), F.lit(0)).alias(c) for c in populations],
        *[F.sum(v * F.col(c)).alias(f"sum_{c}") for c in counts],
    ).first()
    sizes = {c: first[c] for c in ("values", *populations)}
    means = {c: first[f"sum_{c}"] / sizes[c] if sizes[c] else None for c in counts}

    sums: list[Column] = []
    for c in counts:
        gap = v - F.lit(means[c])
        sums.append(F.sum(F.col(c) * gap * gap).alias(f"s2_{c}"))
    gap = v - F.lit(means["n"])
    sums += [F.sum(F.col("n") * F.pow(gap, F.lit(float(k)))).alias(f"s{k}_n") for k in (3, 4)]
    picks = _Picks(probs, sizes)
    tested = len(counts) > 1
    if tested:
        sums += _rank_sums(sizes["n0"], sizes["n1"])
    needed = sorted({*picks.counts, *counts})
    ranked = ranked_values(histogram, needed)
    second = ranked.agg(*sums, *picks.columns()).first()
    tests = _rank_tests(sizes["n0"], sizes["n1"], second["u0"], second["ties"], second["ap"]) if tested else {}
    return NumericReport(
        first["rows"],
        first["rows"] - sizes["n"],
        sizes,
        means,
        {c: math.sqrt(second[f"s2_{c}"] / (sizes[c] - 1)) if sizes[c] > 1 else None for c in counts},
        first["low"],
        first["high"],
        _skewness(sizes["n"], second["s2_n"], second["s3_n"]),
        _kurtosis(sizes["n"], second["s2_n"], second["s4_n"]),
        picks.quantiles(second),
        tests,
    )


def _skewness(n: int, s2: float | None, s3: float | None) -> float | None:
    """Bias-corrected sample skewness; 0 for a constant column, NULL below three values."""
    if n < 3:
        return None
    if s2 < 1e-14:
        return 0.0
    return (s3 / n) / (s2 / n) ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)


def _kurtosis(n: int, s2: float | None, s4: float | None) -> float | None:
    """Bias-corrected excess kurtosis; 0 for a constant column, NULL below four values."""
    if n < 4:
        return None
    if s2 < 1e-14:
        return 0.0
    excess = (s4 / n) / (s2 / n) ** 2 - 3
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6)


def _rank_sums(size0: int, size1: int) -> list[Column]:
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    tied = n0 + n1
    above0 = (F.lit(size0) - F.col("n0_before")).cast("double")
    above1 = (F.lit(size1) - F.col("n1_before")).cast("double")
    return [
        # pairs a non-default wins: lower defaults, and half of those with the same value
        F.sum(n0 * (F.col("n1_before") + n1 / 2)).alias("u0"),
        F.sum(tied * tied * tied - tied).alias("ties"),
        # precision when every value from this one up is called a default
        F.sum(ratio(n1, F.lit(size1)) * ratio(above1, above1 + above0)).alias("ap"),
    ]


def _rank_tests(n0: int, n1: int, u0: float | None, ties: float | None, ap: float | None) -> dict[str, float | None]:
    """U of class 0, its two-sided normal-approximation p-value with tie and continuity
    corrections, AUC, adjusted AUC and average precision; NULL without both classes."""
    if not n0 or not n1:
        return dict.fromkeys(("mann_whitney_U", "mann_whitney_pvalue", "auc", "auc_ajuste")) | {"auc_pr": ap}
    n, pairs = n0 + n1, float(n0) * n1
    deviation = math.sqrt(max(0.0, pairs / 12 * ((n + 1) - ties / (float(n) * (n - 1)))))
    # without any spread of ranks the correction alone decides: p = 1
    z = (max(u0, pairs - u0) - pairs / 2 - 0.5) / deviation if deviation else -math.inf
    auc = (pairs - u0) / pairs
    return {
        "mann_whitney_U": u0,
        "mann_whitney_pvalue": erfc_tail(z),
        "auc": auc,
        "auc_ajuste": max(auc, 1 - auc),
        "auc_pr": ap,
    }


# --- one-row tables -----------------------------------------------------------------------------


def _one_row(like: DataFrame, values: dict[str, float | int | None]) -> DataFrame:
    kinds = {name: "long" if isinstance(v, int) else "double" for name, v in values.items()}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
    return like.sparkSession.createDataFrame([tuple(values.values())], schema)


def summary_of(report: NumericReport, like: DataFrame) -> DataFrame:
    """Univariate summary: sizes, moments and quantiles, rounded to 4 decimals."""
    quantiles = dict(zip(SUMMARY_QUANTILES, report.quantiles["n"]))  # further ones are left out
    rounded = {
        "mean": report.means["n"],
        "median": quantiles[0.5],
        "std": report.stds["n"],
        "min": report.low,
        "max": report.high,
        "skewness": report.skewness,
        "kurtosis": report.kurtosis,
    } | {f"Q{int(q * 100)}": value for q, value in quantiles.items()}
    share = report.missing / report.rows * 100 if report.rows else None
    return _one_row(
        like,
        {"count": report.rows, "missing": report.missing, "missing_%": rint_number(share, 2)}
        | {name: rint_number(value, 4) for name, value in rounded.items()},
    )


def class_tests_of(report: NumericReport, like: DataFrame) -> DataFrame:
    """Rank tests and class statistics of a numeric variable against the target."""
    row = {k: report.tests[k] for k in ("mann_whitney_U", "mann_whitney_pvalue", "auc", "auc_ajuste")}
    for label, values in (
        ("moyenne", report.means),
        ("mediane", {c: report.quantiles[c][1] for c in ("n0", "n1")}),
        ("ecart_type", report.stds),
        ("effectif", report.sizes),
    ):
        row |= {f"{label}_{CLASSES[c]}": values[c] for c in ("n0", "n1")}
    return _one_row(like, row)


def numeric_summary(df: DataFrame, variable: str) -> DataFrame:
    return summary_of(numeric_report(value_histogram(df, variable), {"n": SUMMARY_QUANTILES}), df)


def class_tests(df: DataFrame, variable: str, target: str) -> DataFrame:
    probs = {"n0": QUARTILES, "n1": QUARTILES}
    return class_tests_of(numeric_report(value_histogram(df, variable, target), probs), df)


def score_metrics(df: DataFrame, score: str, target: str) -> DataFrame:
    """One row: AUC, Gini, average precision, prevalence and their ratio for a score column."""
    histogram = value_histogram(df, score, target)
    sizes = histogram_sizes(histogram)
    n0, n1 = sizes["n0"], sizes["n1"]
    ranked = ranked_values(histogram, ["n0", "n1"])
    row = ranked.agg(*_rank_sums(n0, n1)).first()
    tests = _rank_tests(n0, n1, row["u0"], row["ties"], row["ap"])
    auc, ap = tests["auc"], tests["auc_pr"]
    prevalence = n1 / (n0 + n1) if n0 + n1 else None
    return _one_row(
        df,
        {
            "auc": auc,
            "gini": None if auc is None else 2 * auc - 1,
            "auc_pr": ap,
            "prevalence": prevalence,
            "rp": ap / prevalence if ap is not None and prevalence else None,
        },
    )
