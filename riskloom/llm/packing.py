"""Packing in the order of a space-filling curve.

A document's hashed token vector is projected to a few dimensions by random signs; the point's
Hilbert index puts similar documents side by side. A range sort by that index and a distributed
prefix sum of lengths give each document its place on one long line, which is cut every
`length` tokens. So neighbours on the curve share sequences, and nothing is padded: the rest at
the end of the line is cut into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import running_totals
from riskloom.sources.shared import write_shared

from .common import releasing
from .hashing import mix64
from .tokens import encode_all, forget_encoder

DIMENSIONS = 4
BITS = 15
BUCKETS = 1024


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points (n, d) with coordinates below 2**bits.

    From the top bit down, a set bit inverts the first coordinate's lower bits and a clear one
    swaps them with the first coordinate's; Gray decoding of the interleaved bits follows.
    """
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[d - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of each token id, and a row of random signs for each bucket."""
    bucket = mix64(np.arange(vocabulary, dtype=np.uint64) + np.uint64(11)) % np.uint64(BUCKETS)
    cells = np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64) + np.uint64(5)
    signs = (mix64(cells) & np.uint64(1)).astype(np.int64) * 2 - 1
    return bucket.astype(np.int32), signs.reshape(BUCKETS, DIMENSIONS)


def curve_keys(ids: list[np.ndarray], projected: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    bucket, signs = projected
    means = np.zeros((len(ids), DIMENSIONS))
    for k, row in enumerate(ids):
        means[k] = np.bincount(bucket[row], minlength=BUCKETS) @ signs / max(1, len(row))
    return hilbert_index(np.floor((means + 1) / 2 * ((1 << BITS) - 1)), BITS)


def tokenised(docs: DataFrame, path: str, end: int, id_column: str, text: str) -> DataFrame:
    """(doc_id, key, n, ids): curve key, number of tokens and token ids with `end` at the end."""

    @releasing
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = projection(1 << 16)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                encoded, kind = encode_all(part.column("__text").to_pylist(), path, end)
                ids = [np.frombuffer(e, kind) & 0xFFFF for e in encoded]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(curve_keys(ids, signs)),
                        pa.array([len(r) for r in ids], pa.int64()),
                        pa.array(encoded, pa.binary()),
                        pa.array([int(kind[-1])] * len(ids), pa.int32()),
                    ],
                    names=["doc_id", "key", "n", "ids", "width"],
                )

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(encode, "doc_id long, key long, n long, ids binary, width int")


def cuts_of_rest(total: int, length: int) -> list[int]:
    """Ends of the sequences after the last full one: powers of two that add up to the rest."""
    at, out = total // length * length, []
    rest = total - at
    while rest:
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
        out.append(at)
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = 4096,
    end: int = 2,
    id_column: str = "doc_id",
    text: str = "text",
    token_ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and unless not asked for
    token_ids (array<int>).
    Every id of every row lies in one piece; a row without text has the one id `end`. All sequences
    are full but the last few, whose lengths are powers of two (`length` is one too), so there is no
    padding. Rows with one curve key are ordered by id and content; equal rows are packed each. An
    empty table gives no pieces. Other columns are not read.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = write_shared(
        tokenised(docs, tokenizer, end, id_column, text).withColumn("row", F.monotonically_increasing_id())
    )
    narrow = write_shared(rows.select("row", "doc_id", "key", "n", F.xxhash64("ids").alias("content")))
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = [F.col(c).asc_nulls_first() for c in ("key", "doc_id", "content", "row")]
    placed = running_totals(narrow, order, ["n"]).select("row", F.col("n_before").alias("before"))
    rest = cuts_of_rest(total, length)
    full = total // length

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoder()  # all texts are encoded; the worker lives on, beside other work
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            out = {name: [] for name in names}
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "before", "n", "ids", "width")]
            for doc_id, before, n, ids, width in zip(*columns):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                at = before
                while at < before + n:
                    if at < full * length:
                        sequence, first = divmod(at, length)
                        first, last = at - first, at - first + length
                    else:
                        k = next(k for k, e in enumerate(rest) if e > at)
                        sequence, last = full + k, rest[k]
                        first = rest[k - 1] if k else full * length
                    stop = min(last, before + n)
                    piece = wide[at - before : stop - before]
                    row = (doc_id, at - before, stop - at, zlib.crc32(piece), n, sequence, at - first, piece)
                    for name, value in zip(names, row):
                        out[name].append(value)
                    at = stop
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(list(zip(names, kinds))))

    kinds = [pa.int64()] * 7
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    described = ", ".join(f"{n} long" for n in names)
    if token_ids:
        kinds, names = [*kinds, pa.list_(pa.int32())], [*names, "token_ids"]
        described += ", token_ids array<int>"
    whole = rows.join(placed, "row").select("doc_id", "before", "n", "ids", "width")
    return whole.mapInArrow(cut, described)
