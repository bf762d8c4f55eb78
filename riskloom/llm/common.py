"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

# A side of a join is broadcast only after it was counted at or below this many narrow rows;
# beyond it the same join runs by shuffle.
BROADCAST_ROWS = 1_000_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACES = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, with what the jobs left behind let go.

    Shuffle files of finished jobs are deleted when the driver notices that nothing refers to their
    plans any more; a chain of large jobs asks for that after each step instead of waiting.
    """
    written = write_shared(df)
    del df
    gc.collect()
    written.sparkSession._jvm.System.gc()
    return written


def broadcast_if_small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def spaced(text: Column) -> Column:
    """The text with each ASCII white-space character made a space; NULL is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACES:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space, in order."""
    return F.array_remove(F.split(spaced(text), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_characters(text: Column, characters: str) -> Column:
    """How often any of the characters occurs."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("long")


def crc_of_id(column: str) -> Column:
    """CRC-32 of the id written as text; of the empty text for NULL."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def releasing(
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` of a mapInArrow that gives back, at the end of each task, what Arrow keeps of freed batches.

    The worker process lives on idle beside later stages, and Arrow's pool would hold its largest batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def bounded_slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of the text column, a longer text by itself."""
    sizes = batch.column(text).cast(pa.binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int32)[sizes.offset : sizes.offset + len(sizes) + 1])
    block = (np.cumsum(lengths.astype(np.int64)) - 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
