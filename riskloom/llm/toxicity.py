"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of single words, neighbouring pairs and pairs with one or two
words between. Every coordinate has its own learning rate, and the L1 term keeps a weight at zero
until its gradient sum is large, so a model is a short list of (feature, weight) that is
broadcast to score whole texts.

Fitting uses a sample of labelled rows of bounded size, dealt to shards by hash. Each shard is
fitted in a task of its own; the sparse weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import broadcast_if_small
from .hashing import LETTERS, mix64, word_hashes

BITS = 20
TRAINING_ROWS = 24_000  # bound of the labelled sample
ROWS_PER_SHARD = 6_000


@dataclass(frozen=True)
class Settings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 5


def text_features(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct feature numbers of a text from its word hashes, below 2**BITS."""
    parts = [hashes]
    for gap in (1, 2, 3):
        if len(hashes) > gap:
            parts.append(hashes[:-gap] * np.uint64(2 * gap + 1) + mix64(hashes[gap:] + np.uint64(gap)))
    every = mix64(np.concatenate(parts)) >> np.uint64(64 - BITS)
    return np.unique(every.astype(np.int64))


def fit_ftrl(rows: list[tuple[int, np.ndarray]], settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a non-zero weight, their weights, and the intercept."""
    s, size = settings, 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last one is the intercept, without L1

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    def intercept() -> float:
        return -z[size] / ((s.beta + np.sqrt(n[size])) / s.alpha)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for k in order.permutation(len(rows)):
            y, i = rows[k]
            w = weight(i)
            b = intercept()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - step * w
            n[i] += g * g
            z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / s.alpha * b
            n[size] += g * g
    every = np.arange(size)
    w = weight(every)
    return every[w != 0], w[w != 0], intercept()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str,
    text: str,
    label: str,
    training_rows: int = TRAINING_ROWS,
    settings: Settings = Settings(),
) -> dict[int, float]:
    """Weights by feature number, the intercept under -1; empty without labelled rows.

    `labels` has the id and a 0/1 label, at most one row per id counts; other labels are left out.
    At most about `training_rows` ids, chosen by hash, are used.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(
        F.max(label).alias("__y")
    )
    total = known.count()
    if not total:
        return {}
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), id_column), F.lit(1_000_000)) / 1e6
    sample = known.where(chance < training_rows / total)
    shards = max(1, -(-min(total, training_rows) // ROWS_PER_SHARD))
    taught = docs.select(F.col(id_column), F.col(text).alias("__text")).join(
        broadcast_if_small(sample, min(total, training_rows)), id_column
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = word_hashes(batch.column("__text").cast(pa.binary()).to_pylist(), LETTERS)
            lists = [text_features(h).astype(np.int32) for h in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("__y"), pa.array(lists, pa.list_(pa.int32()))],
                names=["shard", "y", "features"],
            )

    rows = write_shared(
        taught.select(
            F.pmod(F.xxhash64(F.lit("shard"), id_column), F.lit(shards)).alias("shard"),
            F.col("__y").cast("int").alias("__y"),
            "__text",
        ).mapInArrow(features, "shard long, y int, features array<int>")
    )

    def fit_shard(frame: pd.DataFrame) -> pd.DataFrame:
        i, w, b = fit_ftrl(list(zip(frame.y, [np.asarray(f, np.int64) for f in frame.features])), settings)
        return pd.DataFrame({"feature": np.append(i, -1), "weight": np.append(w, b)})

    fitted = rows.groupBy("shard").applyInPandas(fit_shard, "feature long, weight double")
    summed = fitted.groupBy("feature").agg(F.sum("weight").alias("w")).collect()
    used = max(1, rows.select("shard").distinct().count())
    return {r.feature: r.w / used for r in summed}


def score(docs: DataFrame, weights: dict[int, float], id_column: str, text: str, keep: list[str]) -> DataFrame:
    """(id, *keep, score): the probability of label 1 for each whole text; NULL counts as empty.

    Without a model every score is 0.5.
    """
    dense = np.zeros(1 << BITS, np.float32)
    for feature, weight in weights.items():
        if feature >= 0:
            dense[feature] = weight
    sparse = np.flatnonzero(dense)
    shared = docs.sparkSession.sparkContext.broadcast((sparse, dense[sparse], float(weights.get(-1, 0.0))))
    out = docs.select(F.col(id_column), *keep, F.col(text).alias("__text"))
    schema = out.drop("__text").withColumn("score", F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[index] = values
        for batch in batches:
            found = word_hashes(batch.column("__text").cast(pa.binary()).to_pylist(), LETTERS)
            sums = np.array([table[text_features(h)].sum() for h in found], np.float64) + bias
            p = pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], p], names=[*batch.schema.names[:-1], "score"]
            )

    return out.mapInArrow(scored, schema)
