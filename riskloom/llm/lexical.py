"""Ranked lexical search of items over all documents with document FP-trees.

Documents are reduced to term vectors restricted to the items' terms. Blocks of vectors become
FP-trees: a vector's terms, the most frequent in the corpus first, are its path, so documents that
share frequent terms share the start of their paths. Every tree node keeps the largest tf of each term
and the smallest length norm m below it. A document's score grows with tf and falls with m, so the
score formula on these two bounds every document below the node. Each item walks each tree
depth first, the best bound first, and leaves out what cannot reach its ten best so far; documents
in the leaves are scored exactly.

One pass over the texts makes the vectors and the corpus figures N, L and df; a second one reads only
the vectors. Items are taken in blocks of bounded size, so what tasks hold does not grow with them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import bounded_slices
from .hashing import LETTERS, word_groups

TOP = 10
ITEMS_AT_ONCE = 1024
ITEM_CHARACTERS = 1 << 20  # of one block of items; a longer item is a block of its own
LEAF = 32
CELLS = 1 << 22  # documents x terms of one tree
BYTES_AT_ONCE = 1 << 23
SALTS = 64


def term_vectors(docs: DataFrame, vocabulary: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) per row: number of terms, and the restricted vector by place in `vocabulary`.

    `vocabulary` holds sorted 64-bit hashes of terms. Terms are runs of ASCII letters, digits and
    anything beyond ASCII, with A-Z lower-cased.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (s for b in batches for s in bounded_slices(b, "__text", BYTES_AT_ONCE)):
            sizes, ends, terms, tfs = [], [np.zeros(1, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            last = 0
            for hashes, bounds in word_groups(batch.column("__text").cast(pa.binary()).to_pylist(), LETTERS):
                n = np.diff(bounds)
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                row = np.repeat(np.arange(len(n)), n)[hit]
                keys, tf = np.unique(row * max(1, len(known)) + at[hit], return_counts=True)
                row, term = np.divmod(keys, max(1, len(known)))
                sizes.append(n)
                ends.append(last + np.cumsum(np.bincount(row, minlength=len(n))))
                last = int(ends[-1][-1])
                terms.append(term.astype(np.int32))
                tfs.append(tf.astype(np.int32))
            cuts = pa.array(np.concatenate(ends), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])),
                    pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(terms))),
                    pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(tfs))),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(describe, "doc_id long, n long, terms array<int>, tfs array<int>")


def parts_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score before its weight; grows with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class DocumentTree:
    """FP-tree over restricted vectors: paths of term ranks, 0 the most frequent."""

    def __init__(self, paths: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, n_terms: int):
        keys = [p.astype(">u4").tobytes() for p in paths]
        self.order = order = sorted(range(len(keys)), key=lambda k: (keys[k], m[k]))
        self.keys = [keys[k] for k in order]
        self.m = m[order]
        self.tf = np.zeros((len(order), n_terms), np.int32)
        for row, k in enumerate(order):
            self.tf[row, paths[k]] = tfs[k]
        self.low: list[int] = []
        self.high: list[int] = []
        self.children: list[np.ndarray] = []
        self._grow()
        self.largest = np.zeros((len(self.low), n_terms), np.int32)
        self.least = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):  # children have higher numbers
            below = self.children[node]
            if len(below):
                self.largest[node], self.least[node] = self.largest[below].max(axis=0), self.least[below].min()
            else:
                inside = slice(self.low[node], self.high[node])
                self.largest[node], self.least[node] = self.tf[inside].max(axis=0), self.m[inside].min()

    def _add(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append(np.zeros(0, np.int64))
        return len(self.low) - 1

    def _grow(self) -> None:
        todo = [(self._add(0, len(self.keys)), 0)]
        while todo:
            node, depth = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            first, last = self.keys[low], self.keys[high - 1]
            if first == last:  # one path: cut by m, in whose order equal paths stand
                step = max(LEAF, -(-(high - low) // LEAF))
                starts = [*range(low, high, step)]
            else:
                while first[depth : depth + 4] == last[depth : depth + 4]:
                    depth += 4
                heads = [self.keys[k][depth : depth + 4] for k in range(low, high)]
                starts = [low, *[low + k for k in range(1, len(heads)) if heads[k] != heads[k - 1]]]
            # neighbouring small branches share a leaf
            ends, groups = [*starts[1:], high], []
            for start, end in zip(starts, ends):
                if groups and end - groups[-1][0] <= LEAF:
                    groups[-1][1] = end
                else:
                    groups.append([start, end])
            made = [self._add(start, end) for start, end in groups]
            self.children[node] = np.array(made, np.int64)
            todo += [(child, depth) for child in made]

    def search(self, terms: np.ndarray, weights: np.ndarray, found: list[tuple], ids: list, top: int) -> None:
        """Put the best documents of this tree into `found`, a heap of the `top` best of one item."""

        def scores(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
            return parts_of_score(tf[:, terms].astype(np.int64), m[:, None]) @ weights

        todo = [(int(scores(self.largest[:1], self.least[:1])[0]), 0)]
        while todo:
            bound, node = todo.pop()
            if bound <= 0 or (len(found) == top and bound < found[0][0]):
                continue
            below = self.children[node]
            if len(below):
                bounds = scores(self.largest[below], self.least[below])
                best_last = np.argsort(bounds, kind="stable")
                todo += zip(bounds[best_last].tolist(), below[best_last].tolist())
                continue
            low, high = self.low[node], self.high[node]
            exact = scores(self.tf[low:high], self.m[low:high])
            worst = found[0][0] if len(found) == top else 1
            for k in np.flatnonzero(exact >= max(1, worst)).tolist():
                doc_id = ids[self.order[low + k]]
                # a missing id comes after all others
                entry = (int(exact[k]), doc_id is not None, -(doc_id or 0))
                if len(found) < top:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)


def _norms(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    if n_docs * int(n.max(initial=0)) < 1 << 56:
        return 10 + (90 * n * n_docs) // length
    return np.array([10 + (90 * int(x) * n_docs) // length for x in n], np.int64)


def best_of_trees(vectors: DataFrame, items: list, weights: np.ndarray, rank: np.ndarray, n_docs: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each task for each item of the block."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights, rank))
    cells = CELLS

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w, place = shared.value
        at_once = max(64, min(8192, cells // max(1, len(place))))
        queries = [np.sort(place[terms]) for terms in asked]
        w_by_rank = np.zeros(len(place), np.int64)
        w_by_rank[place] = w
        found: list[list[tuple]] = [[] for _ in asked]
        held: list[tuple] = []

        def emptied() -> None:
            ids, n, paths, tfs = (list(x) for x in zip(*held))
            tree = DocumentTree(paths, tfs, _norms(np.array(n, np.int64), n_docs, length), len(place))
            for heap, terms in zip(found, queries):
                if len(terms):
                    tree.search(terms, w_by_rank[terms], heap, ids, top)
            held.clear()

        for batch in batches:
            n = batch.column("n").to_numpy()
            starts = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(starts)
            terms, tfs = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                inside = slice(ends[k] - starts[k], ends[k])
                path = place[terms[inside]]
                order = np.argsort(path)
                held.append((doc_id, n[k], path[order], tfs[inside][order]))
                if len(held) == at_once:
                    emptied()
        if held:
            emptied()
        rows = [(i, -e[2] if e[1] else None, e[0]) for i, heap in enumerate(found) for e in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["item", "doc_id", "score"]
        )

    return vectors.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item int, doc_id long, score long")


def _item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """The items with a block number, and the number of blocks."""
    size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // ITEMS_AT_ONCE), -(-size[1] // ITEM_CHARACTERS))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` highest-scoring rows of `docs` for each item.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a row's norm m = 10 + 90 n N div L, and the
    score sums weight * (10^9 tf div (1000 tf + 8 m)) over the item's distinct terms. Only scores above
    0 are ranked; equal ones by ascending doc_id, missing ids last. NULL and empty texts have no term;
    an item without known terms gives no row. Repeated rows of `docs` are ranked each; equal rows of
    `items` are one item, and items that share an id but not the text are answered each. Empty tables
    give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).distinct()
    asked, blocks = _item_blocks(write_shared(asked))
    kind = asked.schema["item_id"].dataType
    answers = None
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).orderBy("item_id", "text").collect()
        hashed = [np.unique(h) for h in _term_hashes([r["text"] for r in rows])]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        vectors = write_shared(term_vectors(docs, vocabulary, id_column, text))
        corpus = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not corpus["docs"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * corpus["docs"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        places = [np.searchsorted(vocabulary, h) for h in hashed]
        places = [p[df[p] > 0] for p in places]
        best = best_of_trees(vectors, places, weights, rank, corpus["docs"], corpus["terms"], top)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {kind.simpleString()}")
        # one row per item of the block: at most ITEMS_AT_ONCE, or the items of ITEM_CHARACTERS
        named = best.join(F.broadcast(ids), "item").withColumn("block", F.lit(block))
        answers = named if answers is None else answers.unionAll(named)
    if answers is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    # tasks grow with the corpus: their answers are merged in SALTS parts first
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = W.partitionBy("block", "item", "salt").orderBy(*order)
    merged = (
        answers.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        .withColumn("place", F.row_number().over(salted))
        .where(F.col("place") <= top)
    )
    whole = W.partitionBy("block", "item").orderBy(*order)
    ranked = merged.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _term_hashes(texts: list[str | None]) -> list[np.ndarray]:
    groups = word_groups([None if t is None else t.encode() for t in texts], LETTERS)
    return [part for hashes, bounds in groups for part in np.split(hashes, bounds[1:-1])]
