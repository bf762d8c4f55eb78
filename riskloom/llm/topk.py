"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; a segment's mean and deviation bound its share of any inner product:
sum(x y) <= L (mean_x mean_y + dev_x dev_y). Summed over the segments this bounds the score from
above, which is a lower bound of the distance at given norms. Each task runs through its vectors in
batches, from one segment to many: a vector stays a candidate of a query only while its bound
reaches the query's k-th best score so far, and survivors are scored exactly in integers.

Queries are taken in blocks of bounded size, one scan of the vectors for each block, so neither the
queries nor the vectors have to fit anywhere whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES_PER_BLOCK = 4096
LEVELS = (1, 4, 16)
# beyond this a score need not fit 64 bits, and such a table is refused
LARGEST_COMPONENT = 2**26


def quantised(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) per component.

    Rows with a NULL id, a NULL vector, or a component that is NULL or not finite are left out. A
    finite component beyond LARGEST_COMPONENT after scaling raises an error.
    """
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = F.forall(
        F.col(f"`{vector}`"),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    fits = F.forall(F.col(f"`{vector}`"), lambda x: F.abs(x.cast("double")) <= LARGEST_COMPONENT / scale)
    refusal = F.raise_error(F.lit(f"a component is beyond {LARGEST_COMPONENT / scale:g}: its scores need not fit 64 bits"))
    v = F.when(fits, F.transform(v, lambda x: x.cast("long"))).otherwise(refusal)
    return vectors.where(F.col(f"`{id_column}`").isNotNull() & usable).select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), v.alias("v")
    )


def bounds_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of the rows of `x` from above."""
    parts = []
    for piece in np.array_split(x.astype(np.float64), min(segments, max(1, x.shape[1])), axis=1):
        length = piece.shape[1]
        mean = piece.mean(axis=1) if length else np.zeros(len(x))
        rest = piece - mean[:, None]
        parts += [mean * np.sqrt(length), np.sqrt((rest * rest).sum(axis=1))]
    return np.stack(parts, axis=1)


class _Best:
    """The k best scores of each query so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.levels = [bounds_features(rows, s) for s in LEVELS]
        self.norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        self.found = np.zeros((0, 3), np.int64)  # query, score, vec_id
        self.least = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for start in (0, 64) if not len(self.found) else (0,):  # the first few only set the bar
            end = 64 if start == 0 and not len(self.found) else len(ids)
            if start < end:
                self._add(ids[start:end], x[start:end])

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        slack = 1e-9 * self.norm.max(initial=0) * np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0) + 1e-6
        bar = self.least - slack
        bound = self.levels[0] @ bounds_features(x, LEVELS[0]).T
        q, c = np.nonzero(bound >= bar[:, None])
        for level, segments in zip(self.levels[1:], LEVELS[1:]):
            features, keep = bounds_features(x, segments), np.empty(len(q), bool)
            for i in range(0, len(q), 1 << 18):
                s = slice(i, i + (1 << 18))
                keep[s] = np.einsum("ij,ij->i", level[q[s]], features[c[s]]) >= bar[q[s]]
            q, c = q[keep], c[keep]
        other = self.ids[q] != ids[c]
        q, c = q[other], c[other]
        score = np.empty(len(q), np.int64)
        for i in range(0, len(q), 1 << 18):
            s = slice(i, i + (1 << 18))
            score[s] = np.einsum("ij,ij->i", self.rows[q[s]], x[c[s]])
        rows = np.concatenate([self.found, np.stack([q, score, ids[c]], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.found = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.least[full[:, 0]] = full[:, 1]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    lists = batch.column("v")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield ids[rows], flat[starts[rows][:, None] + np.arange(n)]


def exact_top_k(
    vectors: DataFrame,
    k: int = 10,
    query_modulus: int = 100,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best scores, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by `query_modulus`; candidates all rows with another
    id and as many components. A query with fewer candidates than k gets all of them. Repeated
    rows are candidates each; equal query rows are one query. No usable query: no rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_column, vector, scale)
    queries = rows.where(F.col("vec_id") % query_modulus == 0).distinct()
    blocks = -(-queries.count() // QUERIES_PER_BLOCK)
    found = None
    for block in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        sides = {}
        for batch in chosen.combine_chunks().to_batches():
            for ids, x in _by_length(batch):
                sides[x.shape[1]] = (ids, x)
        shared = spark.sparkContext.broadcast(sides)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = {n: _Best(ids, x, k) for n, (ids, x) in shared.value.items()}
            for batch in batches:
                for ids, x in _by_length(batch):
                    if x.shape[1] in best:
                        for i in range(0, len(ids), 4096):
                            best[x.shape[1]].add(ids[i : i + 4096], x[i : i + 4096])
            for n, b in best.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.found[:, 0] * 1_000_003 + n),
                        pa.array(b.ids[b.found[:, 0]]),
                        pa.array(b.found[:, 2]),
                        pa.array(b.found[:, 1]),
                    ],
                    names=["query", "query_id", "vec_id", "score"],
                )

        part = rows.mapInArrow(scan, "query long, query_id long, vec_id long, score long")
        part = part.withColumn("block", F.lit(block))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best_first = W.partitionBy("block", "query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best_first))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
