"""Unpenalised logistic regression on distinct feature rows, with metrics and Wald tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import binary, column, require
from ..functions.numeric import ratio
from ..functions.pvalues import normal_two_sided_tail
from ..sources.shared import write_shared
from .encoding import SEPARATOR
from .ordering import running_totals

# Guard inside the logarithms of the likelihood, iteration limit of the fit.
LOG_GUARD = 1e-15
MAX_ITERATIONS = 1000
TOLERANCE = 1e-10

ROWS_PER_TASK = 50_000

COUNTS = ["train_0", "train_1", "test_0", "test_1"]
METRICS = ["aic", "bic", "gini_train", "brier_train", "gini_test", "auc_pr", "rp", "brier_test"]


@dataclass(frozen=True)
class LogitFit:
    features: list[str]
    intercept: float
    coefficients: list[float]
    metrics: dict[str, float | None]
    iterations: int
    converged: bool
    std_errors: list[float | None] = field(default_factory=list)
    model: LogisticRegressionModel | None = None

    def coefficient_table(self, spark) -> DataFrame:
        """(variable, level, coef, std_error, wald_z, pvalue), one row per dummy."""
        errors = self.std_errors or [None] * len(self.features)
        rows = []
        for name, coef, error in zip(self.features, self.coefficients, errors):
            variable, _, level = name.partition(SEPARATOR)
            z = coef / error if error else None
            rows.append((variable, level, coef, error, z, None if z is None else normal_two_sided_tail(z)))
        return spark.createDataFrame(
            rows,
            "variable string, level string, coef double, std_error double, wald_z double, pvalue double",
        )


def feature_patterns(train: DataFrame, test: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Distinct feature rows with their train and test counts by class, in one aggregate."""
    require(train, target, *features)
    require(test, target, *features)
    sides = []
    for role, df in (("train", train), ("test", test)):
        y = binary(df, target)
        flags = [
            ((y == c) if role == r else F.lit(False)).alias(f"{r}_{c}") for r in ("train", "test") for c in (0, 1)
        ]
        sides.append(df.select(*[column(f) for f in features], *flags))
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*[column(f) for f in features])
        .agg(*[F.count_if(F.col(c)).alias(c) for c in COUNTS])
    )


def fit_patterns(
    patterns: DataFrame,
    features: Sequence[str],
    prevalence: float | None = None,
    wald: bool = False,
) -> LogitFit:
    """Fit on the weighted distinct rows and score train and test.

    Equal rows carry their counts as weights, so an iteration costs one pass over the distinct
    rows whatever the table size.
    """
    if not features:
        raise ValueError("no feature columns to fit")
    data = _vectors(patterns, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = data.count()
        # few rows, few tasks: every solver iteration is a job over these partitions
        packed = data.coalesce(max(1, math.ceil(rows / ROWS_PER_TASK)))
        model = _fit(packed)
        scored = model.transform(packed)
        probability = F.element_at(vector_to_array("probability"), 2)
        scores = scored.select(probability.alias("p"), *COUNTS)
        errors = _wald_errors(scored, len(features)) if wald else []
        metrics = model_metrics(scores, len(features), prevalence)
    finally:
        data.unpersist()
    iterations = model.summary.totalIterations if model.hasSummary else 0
    return LogitFit(
        list(features),
        float(model.intercept),
        [float(c) for c in model.coefficients.toArray()],
        metrics,
        iterations,
        iterations < MAX_ITERATIONS,
        errors,
        model,
    )


def score(fit: LogitFit, df: DataFrame, name: str = "probabilite") -> DataFrame:
    """`df` with the fitted probability of each row added as a column; no job runs.

    `df` holds the model's `variable&level` columns (see `get_test_dummies`); a NULL in one of them
    gives a NULL probability.
    """
    require(df, *fit.features)
    terms = [column(f).cast("double") * c for f, c in zip(fit.features, fit.coefficients)]
    while len(terms) > 1:  # in pairs, so that the expression stays shallow
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2 :]
    z = F.lit(fit.intercept) + (terms[0] if terms else F.lit(0.0))
    return df.withColumn(name, 1 / (1 + F.exp(-z)))


def with_wald_errors(fit: LogitFit, patterns: DataFrame) -> LogitFit:
    """The same fit with standard errors, for one more pass over the patterns."""
    scored = fit.model.transform(_vectors(patterns, fit.features))
    return replace(fit, std_errors=_wald_errors(scored, len(fit.features)))


def _vectors(patterns: DataFrame, features: Sequence[str]) -> DataFrame:
    # positional names keep arbitrary level text out of the assembler
    inputs = [f"f{i}" for i in range(len(features))]
    numbered = patterns.select(
        *[column(name).cast("double").alias(f) for name, f in zip(features, inputs)], *COUNTS
    )
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(numbered).select("features", *COUNTS)


def _fit(data: DataFrame) -> LogisticRegressionModel:
    labelled = data.select(
        "features",
        F.explode(
            F.array(
                F.struct(F.lit(0.0).alias("label"), F.col("train_0").cast("double").alias("weight")),
                F.struct(F.lit(1.0).alias("label"), F.col("train_1").cast("double").alias("weight")),
            )
        ).alias("r"),
    ).select("features", "r.label", "r.weight")
    solver = LogisticRegression(
        maxIter=MAX_ITERATIONS, tol=TOLERANCE, regParam=0.0, family="binomial", weightCol="weight"
    )
    return solver.fit(labelled.where(F.col("weight") > 0))


def model_metrics(
    scores: DataFrame,
    n_features: int,
    prevalence: float | None = None,
) -> dict[str, float | None]:
    """Train and test metrics of scored counts (p, train_0, train_1, test_0, test_1): one ordering
    of the distinct scores and one aggregate over it."""
    by_score = write_shared(scores.groupBy("p").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    ranked = running_totals(by_score, [F.col("p").asc()], COUNTS, totals=True)

    def number(name: str) -> Column:
        return F.col(name).cast("double")

    def auc(role: str) -> Column:
        # defaults meet every earlier non-default, and half of those with the same score
        wins = number(f"{role}_1") * (number(f"{role}_0_before") + number(f"{role}_0") / 2)
        pairs = F.max(number(f"{role}_0_all")) * F.max(number(f"{role}_1_all"))
        return F.try_divide(F.sum(wins), pairs)

    def squares(role: str) -> Column:
        return F.sum(number(f"{role}_1") * (1 - p) * (1 - p) + number(f"{role}_0") * p * p)

    p = F.col("p")
    above1 = number("test_1_all") - number("test_1_before")
    above0 = number("test_0_all") - number("test_0_before")
    loglik = number("train_1") * F.ln(p + LOG_GUARD) + number("train_0") * F.ln(1 - p + LOG_GUARD)
    row = ranked.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
        F.sum(loglik).alias("loglik"),
        squares("train").alias("sq_train"),
        squares("test").alias("sq_test"),
        auc("train").alias("auc_train"),
        auc("test").alias("auc_test"),
        F.sum(ratio(F.col("test_1"), F.col("test_1_all")) * ratio(above1, above1 + above0)).alias("ap"),
    ).first()
    n, m, k = row["train_0"] + row["train_1"], row["test_0"] + row["test_1"], n_features + 1
    if prevalence is None:
        prevalence = row["test_1"] / m if m else None
    return {
        "aic": -2 * row["loglik"] + 2 * k,
        "bic": -2 * row["loglik"] + k * math.log(n),
        "gini_train": None if row["auc_train"] is None else 2 * row["auc_train"] - 1,
        "brier_train": row["sq_train"] / n,
        "gini_test": None if row["auc_test"] is None else 2 * row["auc_test"] - 1,
        "auc_pr": row["ap"],
        "rp": row["ap"] / prevalence if row["ap"] is not None and prevalence else None,
        "brier_test": row["sq_test"] / m if m else None,
    }


def _wald_errors(scored: DataFrame, n_features: int) -> list[float | None]:
    """Standard errors from the information matrix.

    A row adds w·p(1-p)·xᵢxⱼ for its non-zero columns only, so dummies cost one cell per pair of
    levels that occur together; sums combine on the map side. The (k+1)² matrix is inverted on
    the driver. NULL where it is singular.
    """
    size = n_features + 1
    probability = F.element_at(vector_to_array("probability"), 2)
    weight = (F.col("train_0") + F.col("train_1")) * probability * (1 - probability)
    cells = F.transform(
        F.concat(F.array(F.lit(1.0)), vector_to_array("features")), lambda v, i: F.struct(i.alias("i"), v.alias("v"))
    )
    filled = F.filter(cells, lambda c: c["v"] != 0)
    rows = scored.select(filled.alias("x"), weight.cast("double").alias("w"))
    pairs = rows.select("w", "x", F.explode("x").alias("a")).select("w", "a", F.explode("x").alias("b"))
    products = (
        pairs.where("a.i <= b.i")
        .groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j"))
        .agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("h"))
    )
    information = np.zeros((size, size))
    for i, j, h in products.collect():
        information[i, j] = information[j, i] = h
    if not np.all(np.isfinite(information)) or np.linalg.cond(information) > 1e14:
        return [None] * n_features
    variances = np.diag(np.linalg.inv(information))[1:]
    return [math.sqrt(v) if v > 0 else None for v in variances]


def fit_logit_and_metrics(
    train: DataFrame,
    test: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    prevalence: float | None = None,
    wald: bool = True,
) -> LogitFit:
    """Fit on `train`, score both tables. `features` defaults to all non-target columns;
    `prevalence` to the test default rate."""
    names = list(features) if features is not None else [c for c in train.columns if c != target]
    return fit_patterns(feature_patterns(train, test, target, names), names, prevalence, wald)


def metrics_of_scores(df: DataFrame, score: str, target: str, n_features: int) -> DataFrame:
    """One row: log-likelihood, AIC, BIC and Brier score of a probability column."""
    require(df, score, target)
    y, p = binary(df, target), column(score)
    k = n_features + 1
    sums = df.agg(
        F.count(y).alias("n"),
        F.sum(y * F.ln(p + LOG_GUARD) + (1 - y) * F.ln(1 - p + LOG_GUARD)).alias("loglik"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )
    return sums.select(
        "n",
        "loglik",
        (-2 * F.col("loglik") + 2 * k).alias("aic"),
        (-2 * F.col("loglik") + k * F.ln(F.col("n").cast("double"))).alias("bic"),
        "brier",
    )
