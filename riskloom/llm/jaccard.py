"""Exact Jaccard join of word shingles with count vectors and R-trees.

Documents with the same shingle set are one node. Nodes meet in buckets, one for each of the shingles
that come first in a fixed order of all shingles. If a pair overlaps in t of a node's n shingles, the
first n - t + l of both hold l common ones, so a linked pair meets in at least l buckets (`common_needed`). A
node in fewer shared buckets has no partner and leaves, and each node may stay away from its largest
buckets as long as any linked pair keeps one. Shingles are ordered by hash, but frequent ones come
last, by frequency, so that passages that many documents share open no bucket. The order changes
only the cost: any order finds every pair.

A node's shingles are hashed to groups; the group counts are a point. The sum of the smaller
coordinates of two points bounds the overlap of their sets from above. First every node is compared
with the few nodes that lead most of its buckets, which ties copies together without pairing
them out. Then every bucket that still holds more than one component is searched with an R-tree over
its points: a tree node keeps the largest coordinates below it, and two tree nodes are followed
only while their bound, their sizes and their components allow a new link. What is given are not
pairs but clusters: the nodes of a bucket that surviving pairs tie together, once for all buckets with
the same cluster. Each cluster is searched again with the whole sets at hand, and pairs are
verified until they add no link between its parts, so the rows given grow with the nodes, not with
their pairs. Buckets beyond a size and clusters beyond a number of shingles are dealt to pairs of blocks.

An R-tree over all points at once would not do: with hundreds of shingles spread over the groups,
unrelated documents of one length have bounds near the threshold, so the tree could not be cut to
parts that tasks hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_slices, broadcast_if_small, releasing, settled
from .components import connected_components
from .hashing import shingle_sets

WORDS = 5
PERCENT = 75
GROUPS = 64
FREQUENT = 200_000  # bound of the broadcast list of frequent shingles
BYTES_AT_ONCE = 1 << 22  # of the texts whose shingles are held at once
BLOCK = 2048
CLUSTERS_KEPT = 100_000  # of a task, to give a cluster of several buckets once
SHINGLES_AT_ONCE = 1 << 22  # of a block of a cluster
NODES_AT_ONCE = 1 << 8  # pairs of tree nodes whose children are compared at once
FANOUT = 16
SALTS = 64
LEADERS = 3


def needed_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of sets of a and b elements with 100 I >= percent (a + b - I)."""
    return -(-percent * (a + b) // (100 + percent))


def common_needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many leading shingles a set of n elements shares with a linked set that is not smaller."""
    return np.maximum(1, (n - -(-percent * n // 100) + 1) // 4)


def least_buckets(n: np.ndarray, percent: int) -> np.ndarray:
    """In how many buckets a set of n elements meets any linked set: of those the smallest has percent of n."""
    return common_needed(-(-percent * n // 100), percent)


def group_counts(shingles: np.ndarray) -> bytes:
    """Counts per group as bytes: GROUPS or the next power of two, so that about one shares a group."""
    groups = GROUPS
    while True:
        counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if len(shingles) <= groups and counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        groups *= 2


def folded(vectors: list[bytes], groups: int) -> np.ndarray:
    """The points with `groups` coordinates each; finer groups add up to coarser ones."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    if (sizes == groups).all():
        return np.frombuffer(b"".join(vectors), np.uint8).reshape(len(vectors), groups)
    out = np.zeros((len(vectors), groups), np.int32)
    for g in np.unique(sizes):
        at = np.flatnonzero(sizes == g)
        cells = np.frombuffer(b"".join([vectors[k] for k in at]), np.uint8)
        out[at] = cells.reshape(len(at), g // groups, groups).sum(axis=1, dtype=np.int32)
    return out


def overlap_bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sum of coordinate minima of each pair, in the finest groups that both have."""
    out = np.zeros(len(a), np.int64)
    fine = np.minimum([len(v) for v in a], [len(v) for v in b]) if a else np.zeros(0, np.int64)
    for g in np.unique(fine):
        every = np.flatnonzero(fine == g)
        step = max(1, (1 << 20) // int(g))
        for k in range(0, len(every), step):
            at = every[k : k + step]
            out[at] = np.minimum(folded([a[i] for i in at], int(g)), folded([b[i] for i in at], int(g))).sum(axis=1, dtype=np.int64)
    return out


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("__text").cast(pa.binary()).to_pylist()


def _half(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def document_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, node, vector) per row, and on some rows shingles that are frequent around it."""

    @releasing
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in bounded_slices(b, "__text", BYTES_AT_ONCE)):
            sizes, nodes, vectors, distinct = [], [], [], {}
            for s in shingle_sets(_texts(batch), WORDS):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                nodes.append(digest)
                vectors.append(group_counts(s))
                distinct[digest] = s
            every, counts = np.unique(np.concatenate([*distinct.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = counts >= max(2, -(-len(distinct) // 256))
            rest = [None] * (len(sizes) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array([_half(d) for d in nodes], pa.int64()),
                    pa.array(vectors, pa.binary()),
                    pa.array([every[often].view(np.int64), *rest], pa.list_(pa.int64())),
                    pa.array([counts[often], *rest], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "node", "s", "vector", "often", "times"],
            )

    return docs.mapInArrow(
        describe,
        "doc_id long, key long, n long, node binary, s long, vector binary, often array<long>, times array<long>",
    )


def frequent_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles found, sorted, and their place when ordered by frequency."""
    top = (
        described.where("often IS NOT NULL")
        .select(F.explode(F.arrays_zip("often", "times")).alias("x"))
        .groupBy("x.often")
        .agg(F.sum("x.times").alias("times"))
        .orderBy(F.col("times").desc(), "often")
        .limit(FREQUENT)
        .toArrow()
    )
    h = top.column("often").to_numpy().view(np.uint64)
    place = np.lexsort((h, top.column("times").to_numpy()))
    rank = np.empty(len(h), np.int64)
    rank[place] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], rank[order]


def leading(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, of which a partner shares `common_needed`, and which of them are frequent."""
    n = len(shingles)
    count = n - -(-percent * n // 100) + int(common_needed(n, percent)) if n else 0
    at = np.searchsorted(frequent, shingles)
    hit = np.zeros(n, bool)
    inside = at < len(frequent)
    hit[inside] = frequent[at[inside]] == shingles[inside]
    rare = shingles[~hit][:count]
    often = shingles[hit][np.argsort(rank[at[hit]])][: count - len(rare)]
    return np.concatenate([rare, often]), np.arange(len(rare) + len(often)) >= len(rare)


def buckets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """(h, s, need), each pair once: nodes by half id in each bucket of at least two.

    Only nodes that meet others in `need` buckets are left; `need` also holds for any linked pair.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    @releasing
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = shared.value
        seen: set[bytes] = set()
        for batch in (s for b in batches for s in bounded_slices(b, "__text", BYTES_AT_ONCE)):
            if len(seen) > 200_000:
                seen.clear()
            keys, nodes, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            needs = [np.zeros(0, np.int32)]
            for s in shingle_sets(_texts(batch), WORDS):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest not in seen:
                    seen.add(digest)
                    first, hot = leading(s, hashes, ranks, percent)
                    keys.append(first)
                    nodes.append(np.full(len(first), _half(digest)))
                    often.append(hot)
                    needs.append(np.full(len(first), least_buckets(len(s), percent), np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.concatenate(nodes)),
                    pa.array(np.concatenate(often)),
                    pa.array(np.concatenate(needs)),
                ],
                names=["h", "s", "often", "need"],
            )

    posted = docs.select("__text").mapInArrow(post, "h long, s long, often boolean, need int")
    # a frequent shingle is dealt over salts; its few partial leaders are combined afterwards
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("s"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    posted = posted.withColumn("salt", salt)
    together = W.partitionBy("h", "salt")
    # copies of a text in other tasks give the same pair again
    before = F.lag("s").over(together.orderBy("s"))
    once = posted.withColumn("before", before).where("before IS NULL OR before <> s").drop("before")
    met = settled(
        once.withColumns({"leader": F.min("s").over(together), "top": F.max("s").over(together)})
        .where("often OR leader < top")
        .select("h", "s", "leader", "often", "need")
    )
    # at most as many rows as there are frequent shingles, whatever the input
    leaders = met.where("often").groupBy("h").agg(F.min("leader").alias("first"), F.max("s").alias("top"))
    often = met.where("often").join(F.broadcast(leaders), "h").where("first < top").select("h", "s", "need")
    every = met.where("NOT often").select("h", "s", "need").unionAll(often)
    enough = every.groupBy("s").agg(F.count(F.lit(1)).alias("degree"), F.max("need").alias("least")).where("degree >= least")
    return settled(every.join(enough.select("s", "degree"), "s"))


def closest_leaders(met: DataFrame) -> DataFrame:
    """(s, t): for each node up to LEADERS nodes that lead most of its buckets.

    A bucket is led by the node that is in most buckets: the text that others were copied from has
    no rare shingles of its own, so it meets all its copies, while two copies may be too far apart.
    """
    led = met.groupBy("h").agg(F.max(F.struct("degree", "s"))["s"].alias("t"))
    counted = (
        met.join(led, "h")
        .where("s <> t")
        .groupBy("s", "t")
        .agg(F.count(F.lit(1)).alias("c"), F.max("need").alias("need"))
        .where("c >= need")
    )
    best = W.partitionBy("s").orderBy(F.col("c").desc(), "t")
    return counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS).select("s", "t")


def rtree_levels(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> list[tuple]:
    """Levels from the points up to one root: largest counts, least and largest size and component."""
    levels = [(points.astype(np.int32), sizes, sizes, parts, parts)]
    while len(levels[-1][0]) > 1:
        p, a, b, c, d = levels[-1]
        at = np.arange(0, len(p), FANOUT)
        levels.append(
            (
                np.maximum.reduceat(p, at, axis=0),
                np.minimum.reduceat(a, at),
                np.maximum.reduceat(b, at),
                np.minimum.reduceat(c, at),
                np.maximum.reduceat(d, at),
            )
        )
    return levels


def rtree_pairs(
    points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, percent: int, split: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points in different components whose bounds allow a link.

    With `split`, only pairs of one point before and one from that index on.
    """
    found = [(np.zeros(0, np.int64),) * 2, *rtree_search(points, sizes, parts, percent, split)]
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def rtree_search(
    points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, percent: int, split: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`rtree_pairs` in blocks: a large group of near copies never has all its pairs in memory."""
    if split is None:
        sides = [np.arange(len(points))] * 2
    else:
        sides = [np.arange(split), np.arange(split, len(points))]
    order = [x[np.lexsort((points[x, 1], points[x, 0], sizes[x]))] for x in sides]
    trees = [rtree_levels(points[x], sizes[x], parts[x]) for x in order]
    depth = max(map(len, trees))
    trees = [[*t, *[t[-1]] * (depth - len(t))] for t in trees]
    same = split is None
    i = j = np.zeros(1, np.int64)
    for level in range(depth - 1, -1, -1):
        kept = []
        left, right = trees[0][level], trees[1][level]
        for k in range(0, len(i), NODES_AT_ONCE):
            x, y = i[k : k + NODES_AT_ONCE], j[k : k + NODES_AT_ONCE]
            if level < depth - 1:
                x, y = (
                    _children(x, len(left[0]), len(trees[0][level + 1][0]))[:, :, None],
                    _children(y, len(right[0]), len(trees[1][level + 1][0]))[:, None, :],
                )
                x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
                inside = (x >= 0) & (y >= 0)
                if same:
                    inside &= x <= y if level else x < y
                x, y = x[inside], y[inside]
            elif same and level == 0:
                x, y = x[:0], y[:0]
            # the points only of what is left after sizes and components
            (a1, b1, c1, d1), (a2, b2, c2, d2) = ([v[q] for v in t[1:]] for t, q in ((left, x), (right, y)))
            may = (100 * b2 >= percent * a1) & (100 * b1 >= percent * a2)
            may &= ~((c1 == d1) & (c2 == d2) & (c1 == c2))
            x, y, need = x[may], y[may], needed_overlap(a1[may], a2[may], percent)
            for q in range(0, len(x), 1 << 13):
                u, v = x[q : q + (1 << 13)], y[q : q + (1 << 13)]
                fits = np.minimum(left[0][u], right[0][v]).sum(axis=1) >= need[q : q + (1 << 13)]
                if level:
                    kept.append((u[fits], v[fits]))
                elif fits.any():
                    yield order[0][u[fits]], order[1][v[fits]]
        if level:
            i = np.concatenate([x for x, _ in kept] or [np.zeros(0, np.int64)])
            j = np.concatenate([y for _, y in kept] or [np.zeros(0, np.int64)])


def _children(nodes: np.ndarray, below: int, here: int) -> np.ndarray:
    """Child numbers of tree nodes, -1 beyond the last; a level that was only repeated has itself."""
    if below == here:
        return nodes[:, None]
    out = nodes[:, None] * FANOUT + np.arange(FANOUT)
    return np.where(out < below, out, -1)


class Parts:
    """Disjoint parts of 0 to n - 1; the roots of many elements are read at once."""

    def __init__(self, same: np.ndarray):
        """Elements with equal numbers begin in one part."""
        _, first, place = np.unique(same, return_index=True, return_inverse=True)
        self.above = first[place]

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.above[x]
        while (up := self.above[found]).tobytes() != found.tobytes():
            found = up
        self.above[x] = found
        return found

    def root(self, x: int) -> int:
        while (up := self.above[x]) != x:
            self.above[x] = x = self.above[up]
        return x

    def join(self, x: int, y: int) -> None:
        self.above[self.root(x)] = self.root(y)


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by bucket as tables of complete buckets."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column("bucket").to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:  # everything before the last bucket is complete
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def two_sided(rows: pa.Table) -> Iterator[tuple[np.ndarray, int | None]]:
    """For each bucket its rows, side 0 first, and where side 1 begins; None for one with only side 0."""
    key, side = rows.column("bucket").to_numpy(), rows.column("side").to_numpy()
    cuts = np.flatnonzero(np.diff(key)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(key)]):
        split = int((side[a:b] == 0).sum())
        if split:
            yield a + np.argsort(side[a:b], kind="stable"), None if split == b - a else split


def in_blocks(groups: DataFrame, group: str) -> DataFrame:
    """Rows of groups with a number of `blocks` dealt to all pairs of blocks, as bucket and side."""
    own = F.pmod(F.xxhash64(F.lit("block"), "s"), F.col("blocks")).cast("int")
    return (
        groups.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns(
            {
                "bucket": F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")),
                "side": (F.col("own") > F.col("other")).cast("int"),
            }
        )
        .drop("own", "other", "blocks", group)
    )


def bucket_clusters(members: DataFrame, percent: int) -> DataFrame:
    """(cluster, s) from rows (bucket, side, s, n, vector, part) sorted by bucket inside partitions.

    A cluster holds the nodes of a bucket that pairs whose points allow a link tie together.
    """

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()  # clusters that this task gave before
        for rows in whole_buckets(batches):
            s, n, part = (rows.column(c).to_numpy() for c in ("s", "n", "part"))
            vectors = rows.column("vector").to_pylist()
            points = folded(vectors, GROUPS)
            tied = Parts(np.arange(len(s)))
            for order, split in two_sided(rows):
                for i, j in rtree_search(points[order], n[order], part[order], percent, split):
                    i, j = order[i], order[j]
                    apart = tied.roots(i) != tied.roots(j)
                    i, j = i[apart], j[apart]
                    fits = overlap_bounds([vectors[k] for k in i], [vectors[k] for k in j]) >= needed_overlap(n[i], n[j], percent)
                    for x, y in zip(i[fits].tolist(), j[fits].tolist()):
                        tied.join(x, y)
            roots = tied.roots(np.arange(len(s)))
            order = np.lexsort((s, roots))
            clusters, nodes = [], []
            for one in np.split(s[order], np.flatnonzero(np.diff(roots[order])) + 1):
                if len(one) > 1:
                    name = xxhash.xxh3_128_digest(one.tobytes())
                    if name not in known:
                        known.add(name)
                        clusters += [name] * len(one)
                        nodes.append(one)
            if len(known) > CLUSTERS_KEPT:
                known.clear()
            if nodes:
                columns = [pa.array(clusters, pa.binary()), pa.array(np.concatenate(nodes))]
                yield pa.RecordBatch.from_arrays(columns, names=["cluster", "s"])

    return members.mapInArrow(search, "cluster binary, s long").distinct()


def cluster_links(docs: DataFrame, clusters: DataFrame, nodes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of whole sets that join all parts of each cluster (cluster, s) which any links join."""
    near = settled(clusters.join(known, "s").join(nodes.select("s", "node", "key", "n"), "s"))
    sizes = near.groupBy("cluster").agg(F.ceil(F.sum("n") / SHINGLES_AT_ONCE).cast("int").alias("blocks"))
    placed = in_blocks(near.select("cluster", "s", "node", "part").join(sizes, "cluster"), "cluster")
    members = placed.join(whole_sets(docs, near.select("key")), "node").select("bucket", "side", "part", "node", "shingles")

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_buckets(batches):
            lists = rows.column("shingles")
            n = np.concatenate([x.value_lengths().to_numpy() for x in lists.chunks]).astype(np.int64)
            every = np.concatenate([x.flatten().to_numpy() for x in lists.chunks]).view(np.uint64)
            sets = np.split(every, np.cumsum(n)[:-1])
            node, part = rows.column("node").to_pylist(), rows.column("part").to_numpy()
            links: list[tuple[bytes, bytes]] = []
            for order, split in two_sided(rows):
                vectors = [group_counts(sets[k]) for k in order]
                size, tied = n[order], Parts(part[order])
                for i, j in rtree_search(folded(vectors, GROUPS), size, part[order], percent, split):
                    apart = tied.roots(i) != tied.roots(j)
                    i, j = i[apart], j[apart]
                    need = needed_overlap(size[i], size[j], percent)
                    fits = overlap_bounds([vectors[k] for k in i], [vectors[k] for k in j]) >= need
                    for x, y, least in zip(i[fits].tolist(), j[fits].tolist(), need[fits].tolist()):
                        if tied.root(x) != tied.root(y):
                            one, other = order[x], order[y]
                            if len(np.intersect1d(sets[one], sets[other], assume_unique=True)) >= least:
                                tied.join(x, y)
                                links.append((node[one], node[other]))
            if links:
                columns = [pa.array(side, pa.binary()) for side in zip(*links)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    members = members.repartition("bucket").sortWithinPartitions("bucket")
    return members.mapInArrow(search, "a binary, b binary").distinct()


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (s, t) whose points allow a link."""
    one = nodes.select("s", "n", "vector")
    left = one.select("s", F.col("n").alias("na"), F.col("vector").alias("va"))
    right = one.select(F.col("s").alias("t"), F.col("n").alias("nb"), F.col("vector").alias("vb"))

    @releasing
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            va, vb = (batch.column(c).to_pylist() for c in ("va", "vb"))
            fits = overlap_bounds(va, vb) >= needed_overlap(na, nb, percent)
            yield batch.select(["s", "t"]).filter(pa.array(fits))

    both = pairs.join(left, "s").join(right, "t").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return both.select("s", "na", "va", "t", "nb", "vb").mapInArrow(bounded, "s long, t long")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (s, t) of half ids whose whole sets reach the threshold.

    Only the sets of nodes in a pair are built from their texts.
    """
    left = nodes.select("s", F.col("node").alias("a"), F.col("key").alias("ka"))
    right = nodes.select(F.col("s").alias("t"), F.col("node").alias("b"), F.col("key").alias("kb"))
    close = settled(pairs.join(left, "s").join(right, "t").where("a <> b").select("a", "ka", "b", "kb"))
    whole = whole_sets(docs, close.select(F.explode(F.array("ka", "kb")).alias("key")))
    both = (
        close.select("a", "b").join(whole.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(whole.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    )
    overlap = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - overlap
    return both.where(100 * overlap >= percent * union).select("a", "b")


def whole_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, shingles) of the texts with these keys, once per node."""
    wanted = settled(keys.distinct())
    texts = docs.join(broadcast_if_small(wanted), "key")

    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in bounded_slices(b, "__text", BYTES_AT_ONCE)):
            found = list(shingle_sets(_texts(batch), WORDS))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                    pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
                ],
                names=["node", "shingles"],
            )

    return texts.select("__text").mapInArrow(sets, "node binary, shingles array<long>").dropDuplicates(["node"])


def component_rows(docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, n, component) per row of `docs`: 64-bit hash of the text, size of its set, and the
    component as the smallest node in it, NULL without words."""
    text_column = F.col(f"`{text}`")
    source = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(text_column).alias("key"), text_column.alias("__text")
    )
    described = settled(document_nodes(source))
    nodes = settled(described.where("n > 0").groupBy("node", "s", "n", "vector").agg(F.min("key").alias("key")))
    met = buckets(source, frequent_shingles(described), percent)
    first = settled(verified(source, possible(closest_leaders(met), nodes, percent), nodes, percent))
    tied = connected_components(first)

    # components as numbers, of the nodes in buckets only
    known = settled(
        nodes.select("node", "s").join(tied, "node", "left").select("s", F.xxhash64(F.coalesce("component", "node")).alias("part"))
    )
    parts = met.join(known, "s")
    # sums of half hashes: unlike XOR no member cancels, and they stay inside 64 bits
    mixed = F.xxhash64("s")
    halves = [F.shiftright("s", 32), F.col("s").bitwiseAND(0xFFFFFFFF), F.shiftright(mixed, 32), mixed.bitwiseAND(0xFFFFFFFF)]
    sums = [f"sum{k}" for k in range(len(halves))]
    open_ = (
        parts.groupBy("h")
        .agg(
            F.min("part").alias("low"),
            F.max("part").alias("high"),
            F.count(F.lit(1)).alias("members"),
            *[F.sum(half).alias(name) for half, name in zip(halves, sums)],
        )
        .where("low < high")
        .groupBy(*sums, "members")  # buckets with the same members are searched once
        .agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("alike"))
    )
    # a linked pair meets in `need` buckets of both, so each may stay away from under half as many: the largest
    largest = W.partitionBy("s").orderBy(F.desc("members"), "h").rowsBetween(W.unboundedPreceding, W.currentRow)
    searched = (
        met.join(open_.select("h", "members", "alike"), "h")
        .withColumn("left_out", F.sum("alike").over(largest))
        .where("2 * left_out > need - 1")
        .select("h", "s", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    )
    points = nodes.select("s", "n", "vector")
    members = in_blocks(searched, "h").join(known, "s").join(points, "s").repartition("bucket").sortWithinPartitions("bucket")
    clusters = settled(bucket_clusters(members, percent))
    second = settled(cluster_links(source, clusters, nodes, known, percent))
    final = connected_components(first.unionAll(second))
    return described.join(final, "node", "left").select(
        "doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component")
    )


def jaccard_components(
    docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of `docs`.

    Rows link when their sets of 5-word shingles have a Jaccard similarity of at least `percent` /
    100; the component is named by its smallest id. A text of fewer words is one shingle; NULL and
    texts without words have none, link with nothing and are components of their own. Repeated rows
    and equal texts are one component. A row without id gets the smallest id it is linked to, or NULL.
    Other columns are not read.
    """
    labelled = component_rows(docs, percent, id_column, text)
    names = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(names, "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
