"""Line dedup by winnowing over line hashes.

A run of lines with at least `least_words` words that also occurs at an earlier place is deleted.
Places are ordered by (doc_id, NULL last; text hash; line number).

Of every two neighbouring lines the one with the smaller hash is a fingerprint, and so is each line
that has `least_words` words by itself; so every run in question holds a fingerprint, and the same
one wherever the run occurs. Fingerprints are grouped by hash, and only those found twice
go on. Around them a match is extended both ways as far as it takes to reach `least_words`: the
shortest runs from each line forward and backward. Their hashes meet in one grouping that keeps
the earliest place of each, so a passage in a third of all documents costs one partial row per
task, and no pairs of places are ever formed. Overlapping later runs add up to the whole repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import broadcast_if_small, releasing
from .hashing import mix64

LEAST_WORDS = 50
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
KEY = ["z", "d", "k"]


def fingerprints(hashes: np.ndarray, words: np.ndarray, least_words: int) -> np.ndarray:
    """Line numbers of the window minima (the later one on a tie) and of the long lines."""
    m = mix64(hashes.view(np.uint64))
    chosen = words >= least_words
    if len(m) > 1:
        later = m[1:] <= m[:-1]
        chosen[1:] |= later
        chosen[:-1] |= ~later
    return np.flatnonzero(chosen)


def shortest_runs(words: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each run that reaches `least_words` and would not without one end."""
    total = np.concatenate([[0], np.cumsum(words)])
    lines = np.arange(len(words))
    last = np.searchsorted(total, total[:-1] + least_words) - 1
    first = np.searchsorted(total, total[1:] - least_words, side="right") - 1
    forward, backward = last < len(words), first >= 0
    i = np.concatenate([lines[forward], first[backward]])
    j = np.concatenate([last[forward], lines[backward]])
    both = np.unique(i * (len(words) + 1) + j)
    return both // (len(words) + 1), both % (len(words) + 1)


def run_hashes(hashes: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the line sequence i..j for each run."""
    out = []
    for salt, base in enumerate(BASES):
        m = mix64(hashes.view(np.uint64) + np.uint64(salt + 1))
        power = np.full(len(m) + 1, base, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        back = np.full(len(m) + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m * power[:-1])])
        out.append(mix64((total[j + 1] - total[i]) * back[i] + (j - i).astype(np.uint64)).view(np.int64))
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _keys(batch: pa.RecordBatch, take: np.ndarray) -> list[pa.Array]:
    index = pa.array(take)
    return [batch.column(c).take(index) for c in KEY]


def with_keys(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    id_, body = F.col(f"`{id_column}`"), F.col(f"`{text}`")
    return docs.withColumns(
        {
            "__z": id_.isNull(),
            "__d": F.coalesce(id_.cast("long"), F.lit(0).cast("long")),
            "__k": F.xxhash64(F.coalesce(body, F.lit(""))),
        }
    )


def line_table(docs: DataFrame, text: str) -> DataFrame:
    """Key, line hashes and words per line of each row."""

    @releasing
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = [], []
            for data in batch.column("__text").cast(pa.binary()).to_pylist():
                lines = (data or b"").split(b"\n")
                hashes.append(np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64).view(np.int64))
                counts.append(np.array([len(x.split()) for x in lines], np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))],
                names=[*KEY, "hashes", "words"],
            )

    rows = docs.select(
        F.col("__z").alias("z"), F.col("__d").alias("d"), F.col("__k").alias("k"), F.col(f"`{text}`").alias("__text")
    )
    return rows.mapInArrow(split, "z boolean, d long, k long, hashes array<long>, words array<int>")


def repeated_runs(lines: DataFrame, least_words: int) -> DataFrame:
    """(z, d, k, first, last) of each shortest run that also occurs earlier."""

    @releasing
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (k, h[(i := fingerprints(h, w.copy(), least_words))], i)
                for k, (h, w) in enumerate(zip(_lists(batch.column("hashes")), _lists(batch.column("words"))))
            ]
            take = np.concatenate([np.full(len(i), k) for k, _, i in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *_keys(batch, take),
                    pa.array(np.concatenate([h for _, h, _ in found])),
                    pa.array(np.concatenate([i for _, _, i in found]).astype(np.int32)),
                ],
                names=[*KEY, "fp", "line"],
            )

    points = lines.mapInArrow(select, "z boolean, d long, k long, fp long, line int")
    shared = write_shared(points.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"))
    meeting = (
        points.join(broadcast_if_small(shared), "fp").groupBy(*KEY).agg(F.collect_set("line").alias("points"))
    )

    @releasing
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_lists(batch.column(c)) for c in ("hashes", "words", "points")]
            take, parts = [], []
            for k, (h, w, p) in enumerate(zip(*columns)):
                i, j = shortest_runs(w, least_words)
                met = np.zeros(len(w) + 1, np.int64)
                met[p + 1] = 1
                met = np.cumsum(met)
                near = met[j + 1] > met[i]
                i, j = i[near], j[near]
                take.append(np.full(len(i), k))
                parts.append([*run_hashes(h, i, j), i, j, np.full(len(i), len(w))])
            arrays = [np.concatenate(x) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [*_keys(batch, np.concatenate(take).astype(np.int64)), *[pa.array(a.astype(np.int64)) for a in arrays]],
                names=[*KEY, "h1", "h2", "first", "last", "n"],
            )

    near = lines.join(meeting, KEY).select(*KEY, "hashes", "words", "points")
    runs = write_shared(
        near.mapInArrow(extend, "z boolean, d long, k long, h1 long, h2 long, first long, last long, n long")
    )
    place = F.struct("z", "d", "k", "first")
    earliest = (
        runs.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("times")).where("times > 1")
    )
    return runs.join(earliest.drop("times"), ["h1", "h2"]).where(place > F.col("place")).select(*KEY, "first", "last", "n")


def _left(runs: pd.Series, n: pd.Series) -> pd.Series:
    """The line ranges that no run covers."""
    out = []
    for row, size in zip(runs, n):
        gone = np.zeros(int(size) + 1, np.int64)
        for r in row:
            gone[r["first"]] += 1
            gone[r["last"] + 1] -= 1
        kept = (np.cumsum(gone)[:-1] == 0).astype(np.int8)
        edge = np.diff(kept, prepend=np.int8(0), append=np.int8(0))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out.append([{"first": int(x), "length": int(y - x)} for x, y in zip(a, b)])
    return pd.Series(out)


def dedup_lines(
    docs: DataFrame, least_words: int = LEAST_WORDS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`docs` with later repeated runs cut from `text`, and n_lines and removed_lines (long) added.

    Lines end at `\\n` and are compared byte by byte. The first occurrence of a run stays, also inside
    one document. Rows that agree in id and text count as one document and are cut alike. NULL text
    stays NULL, with 0 lines; a text whose lines are all repeated becomes empty. Every row is
    returned; columns named n_lines or removed_lines must be renamed before.
    """
    keyed = with_keys(docs, id_column, text)
    lines = write_shared(line_table(keyed, text))
    runs = repeated_runs(lines, least_words)
    uncovered = F.pandas_udf(_left, "array<struct<first:int,length:int>>")
    kept = (
        runs.groupBy(*KEY)
        .agg(F.collect_set(F.struct("first", "last")).alias("runs"), F.max("n").alias("n"))
        .select(*[F.col(c).alias(f"__{c}") for c in KEY], uncovered("runs", "n").alias("__kept"))
    )
    # a shuffle at every size: how many rows are cut depends on the data, not on a bound
    joined = keyed.join(write_shared(kept).hint("merge"), ["__z", "__d", "__k"], "left")
    body = F.split(F.col(f"`{text}`"), "\n")
    left = F.array_join(
        F.flatten(F.transform("__kept", lambda r: F.slice(body, r["first"] + 1, r["length"]))), "\n"
    )
    total = F.coalesce(F.size(body), F.lit(0)).cast("long")
    stay = F.aggregate(F.col("__kept"), F.lit(0).cast("long"), lambda a, r: a + r["length"])
    cut = F.col("__kept").isNotNull()
    return joined.select(
        *[
            F.when(cut, left).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.when(F.col(f"`{text}`").isNull(), F.lit(0).cast("long")).otherwise(total).alias("n_lines"),
        F.when(cut, total - stay).otherwise(F.lit(0).cast("long")).alias("removed_lines"),
    )
