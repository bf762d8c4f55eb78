"""Stratified folds and a cross-validated search over boosted trees."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import binary, column, require
from ..sources.shared import write_shared
from .ordering import running_totals

# Rows of a contiguous range of the shuffled order; each range is one task's window.
ROWS_A_SLICE = 250_000

# Ranges of the search (kind, low, high).
SEARCH_SPACE = {
    "maxDepth": ("int", 3, 8),
    "stepSize": ("log", 0.01, 0.2),
    "subsamplingRate": ("float", 0.5, 1.0),
    "featureSubsetStrategy": ("float", 0.5, 1.0),
    "minInstancesPerNode": ("int", 1, 20),
    "maxIter": ("int", 100, 800),
}
# Spark's gain is a drop of variance, mostly far below 1, so the range is set on its scale.
SEARCH_SPACE["minInfoGain"] = ("log", 1e-6, 1e-2)


def stratified_folds(
    df: DataFrame, target: str, id_columns: Sequence[str], k: int = 3, seed: int = 42, slices: int | None = None
) -> DataFrame:
    """Add `fold` (0..k-1): rows of each class are dealt in a seeded order, so class counts differ by
    at most one between folds.

    The order is the MD5 of the seed and the ids as text, joined by `|` (a missing id is empty), then
    the ids; rows without target are a class of their own. `id_columns` must identify a row. The
    order is cut into `slices` contiguous ranges, by default as many as the counted rows need, and a
    row's place is its global place less the sizes of the classes before its own.
    """
    require(df, target, *id_columns)
    keys = [column(c) for c in id_columns]
    y = F.coalesce(binary(df, target), F.lit(-1))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in keys])
    dealt = df.withColumns({"_y": y, "_h": F.md5(text), "_one": F.lit(1)})
    unknown, zeros, ones = dealt.agg(*[F.count(F.when(F.col("_y") == c, 1)) for c in (-1, 0, 1)]).first()
    ranges = slices or max(1, -(-(unknown + zeros + ones) // ROWS_A_SLICE))
    placed = running_totals(dealt, [F.col("_y"), F.col("_h"), *keys], ["_one"], ranges=ranges)
    start = F.when(F.col("_y") == 1, unknown + zeros).when(F.col("_y") == 0, unknown).otherwise(0)
    fold = F.pmod(F.col("_one_before") - start, F.lit(k)).cast("int")
    return placed.withColumn("fold", fold).select(*[column(c) for c in df.columns], "fold")


def draw_settings(
    n_trials: int, seed: int = 42, space: Mapping[str, tuple[str, float, float]] | None = None
) -> list[dict[str, float]]:
    """Seeded random settings from the search space."""
    generator = random.Random(seed)
    settings = []
    for _ in range(n_trials):
        setting = {}
        for name, (kind, low, high) in (SEARCH_SPACE | dict(space or {})).items():
            if kind == "int":
                setting[name] = generator.randint(int(low), int(high))
            elif kind == "log":
                setting[name] = math.exp(generator.uniform(math.log(low), math.log(high)))
            else:
                setting[name] = generator.uniform(low, high)
        settings.append(setting)
    return settings


def boosted_tree_search(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    id_columns: Sequence[str],
    n_trials: int = 30,
    k: int = 3,
    seed: int = 42,
    space: Mapping[str, tuple[str, float, float]] | None = None,
    parallelism: int = 2,
    fold: str | None = None,
) -> DataFrame:
    """(rang, auc_cv, settings...) best first: mean validation AUC of each drawn setting over
    stratified folds, or over the folds 0..k-1 that the column `fold` names."""
    require(df, target, *features, *id_columns)
    settings = draw_settings(n_trials, seed, space)
    folded = df.withColumn("fold", column(fold)) if fold else stratified_folds(df, target, id_columns, k, seed)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    numbers = folded.select(
        *[column(f).cast("double").alias(f) for f in features],
        binary(folded, target).cast("double").alias("label"),
        "fold",
    )
    data = write_shared(numbers)
    trees = GBTClassifier(featuresCol="features", labelCol="label", seed=seed)
    grid = [
        {
            getattr(trees, name): str(value) if name == "featureSubsetStrategy" else value
            for name, value in setting.items()
        }
        for setting in settings
    ]
    # numBins=0 keeps the validation AUC exact
    judge = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    search = CrossValidator(
        estimator=trees,
        estimatorParamMaps=grid,
        evaluator=judge,
        numFolds=k,
        foldCol="fold",
        parallelism=parallelism,
        seed=seed,
    )
    model = search.fit(assembler.transform(data).select("features", "label", "fold"))
    ranked = sorted(zip(model.avgMetrics, range(len(settings))), key=lambda t: (-t[0], t[1]))
    rows = [
        (place, float(auc), *[float(settings[i][name]) for name in SEARCH_SPACE])
        for place, (auc, i) in enumerate(ranked, start=1)
    ]
    schema = "rang int, auc_cv double, " + ", ".join(f"{name} double" for name in SEARCH_SPACE)
    return df.sparkSession.createDataFrame(rows, schema)
