"""Top-k search, line dedup, Jaccard components and packing against brute force."""

import collections
import itertools
import math
import random
import re
import sys
import tracemalloc
import types
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm_data import documents, empty, prose
from riskloom.llm.components import connected_components
from riskloom.llm.hashing import shingle_sets
from riskloom.llm.jaccard import bucket_clusters, cluster_links, common_needed, document_nodes, folded, group_counts, jaccard_components, leading, least_buckets, needed_overlap, overlap_bounds, rtree_pairs
from riskloom.llm.linededup import dedup_lines, line_table
from riskloom.llm.op7 import one_of_each
from riskloom.llm.op9 import tokenizer_path
from riskloom.llm.packing import hilbert_index, pack, tokenised
from riskloom.llm.tokens import Encoder, encode_all, forget_encoder
from riskloom.llm.topk import bounds_features, exact_top_k


def test_bounds_hold():
    x, q = np.random.default_rng(1).normal(size=(50, 30)), np.random.default_rng(2).normal(size=(20, 30))
    last = None
    for segments in (1, 4, 16):
        bound = bounds_features(q, segments) @ bounds_features(x, segments).T
        assert (bound >= q @ x.T - 1e-9).all()
        last = bound
    assert last.mean() < (bounds_features(q, 1) @ bounds_features(x, 1).T).mean()


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(v) for v in r.normal(size=16)]) for k in range(1500)]
    rows += [(2001, rows[7][1]), (2002, rows[7][1]), (2002, rows[7][1]), (2100, rows[7][1])]
    rows += [(3000, None), (3100, [1.0, None] * 8), (3200, [math.inf] * 16), (3300, [math.nan] * 16), (3400, [1.0, 2.0]), (3401, [2.0, 1.0]), (None, rows[3][1])]
    frame = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, score int")
    got = collections.defaultdict(list)
    for x in exact_top_k(frame).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    usable = [(k, [math.floor(1024 * v) for v in e]) for k, e in rows if k is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    for k, q in {k: e for k, e in usable if k % 100 == 0}.items():
        others = [(-sum(a * b for a, b in zip(q, e)), i) for i, e in usable if i != k and len(e) == len(q)]
        assert got.pop(k, []) == [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(others)[:10])]
    assert not got
    assert exact_top_k(frame.where("false")).count() == 0


def test_top_k_refuses_what_it_cannot_score(spark):
    rows = [(k, [float(k), 1.0]) for k in range(200)]
    fits = spark.createDataFrame([*rows, (201, [65536.0, 1.0])], "vec_id long, embedding array<double>")
    assert exact_top_k(fits).where("query_id = 100 AND rank = 1").first().vec_id == 201
    with pytest.raises(Exception, match="a component is beyond 65536"):
        exact_top_k(spark.createDataFrame([*rows, (201, [65537.0, 1.0])], "vec_id long, embedding array<double>")).collect()


def brute_lines(rows, least):
    """Rows (key, text) in order; every run of lines with enough words that occurs earlier goes."""
    first, out = {}, {}
    for key, text in rows:
        lines = text.split("\n")
        words = [len(x.encode().split()) for x in lines]
        runs = [(i, j) for i in range(len(lines)) for j in range(i, len(lines)) if sum(words[i : j + 1]) >= least]
        gone = set()
        for i, j in runs:
            if first.setdefault(tuple(lines[i : j + 1]), (key, i)) < (key, i):
                gone |= set(range(i, j + 1))
        out[key] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_line_dedup(spark):
    extra = [(40, prose(50, 200, 9) + "\n" + prose(51, 40, 9) + "\n\n" + prose(50, 200, 9)[:400], "en", "s", 0)]
    extra += [(41, prose(51, 40, 9) + "\n" + prose(52, 90, 30), "en", "s", 0), (42, (prose(53, 20, 20) + "\n") * 12, "en", "s", 0)]
    extra += [(43, "x\n" + prose(50, 200, 9), "en", "s", 0)]
    docs = documents(spark, extra).where("doc_id IS NULL OR (doc_id <> 28)")
    got = dedup_lines(docs).collect()
    assert len(got) == docs.count()
    rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.text is not None and r.doc_id is not None})
    expected = brute_lines(rows, 50)
    for r in got:
        if r.doc_id is not None and r.doc_id != 23:
            assert (r.text, r.removed_lines) == expected[r.doc_id], r.doc_id
    assert next(r for r in got if r.doc_id == 23).text is None
    assert {r.text for r in got if r.doc_id == 20} == {""} and sum(r.removed_lines for r in got) > 40
    assert dedup_lines(empty(spark)).count() == 0


def brute_components(rows, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append(set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    names = {}
    for k in range(len(rows)):
        names[find(k)] = min(names.get(find(k), rows[k][0]), rows[k][0])
    return [(rows[k][0], len(sets[k]), names[find(k)]) for k in range(len(rows))]


def test_jaccard(spark):
    words = prose(70, 300).split()
    chain = [(100 + k, " ".join(words[6 * k : 150 + 6 * k]), "en", "s", 0) for k in range(20)]  # each links to the next ones only
    star = [(200 + k, " ".join([*words[:k], f"w{k}", *words[k + 1 :]]), "en", "s", 0) for k in range(60)]
    passage = prose(71, 60)
    shared = [(300 + k, passage + " " + prose(400 + k, 22), "en", "s", 0) for k in range(40)]
    docs = documents(spark, chain + star + shared).where("doc_id IS NULL OR doc_id <> 28")
    got = jaccard_components(docs)
    expected = brute_components([(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()])
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in got.where("doc_id IS NOT NULL").collect()]
    assert sorted(found) == sorted(expected)
    assert got.where("doc_id IS NULL").first().component_id is None
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, _, c in expected if i == c}
    assert kept.where("doc_id = 4").count() == 1 and kept.where("doc_id IS NULL").count() == 1
    assert jaccard_components(empty(spark)).count() == 0


def changed(text, at):
    words = text.split()
    return " ".join([*words[:at], "changed", *words[at + 1 :]])


def test_one_row_of_each_component(spark):
    """Ids that stand for several texts, repeated rows, and rows without id."""
    a, b, c = (prose(800 + k, 90) for k in range(3))
    near = changed(b, 40)
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (7, near, "x"), (8, c, "x"), (8, c, "x"), (8, c, "y"), (None, c, "x"), (None, a, "x"), (9, None, "x"), (9, None, "x"), (None, "", "x")]
    lone = prose(810, 80)
    rows += [(None, lone, "x"), (None, lone, "x"), (None, lone + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(4)
    kept = [(r.doc_id, r.text) for r in one_of_each(docs).collect()]
    fixed = [(1, a), (5, b), (8, c), (9, None), (9, None), (None, "")]
    assert sorted(map(str, kept)) == sorted(map(str, fixed + [x for x in kept if x[0] is None and x[1]]))
    assert len([x for x in kept if x[0] is None and x[1]]) == 1


def test_rows_without_id_link(spark):
    a = prose(820, 90)
    near = changed(a, 30)
    docs = spark.createDataFrame([(7, near), (None, a), (None, a), (3, prose(821, 50))], "doc_id long, text string")
    got = sorted(map(str, [(r.doc_id, r.component_id) for r in jaccard_components(docs).collect()]))
    assert got == sorted(map(str, [(7, 7), (None, 7), (None, 7), (3, 3)]))


def test_large_untied_group(spark):
    """Variants of one text, most of them too far apart, and exact links between some of them."""
    r = random.Random(21)
    base = prose(830, 160).split()
    rows = []
    for k in range(160):
        words = list(base)
        for at in r.sample(range(160), r.choice([3, 5, 9, 14])):
            words[at] = f"w{r.randint(0, 3)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_components(docs).collect())
    assert got == sorted(brute_components(rows))
    assert 1 < len({c for _, _, c in got}) < 160


@pytest.mark.parametrize("at_once", [1 << 22, 4000])
def test_rows_of_a_large_group_grow_with_its_nodes(spark, monkeypatch, at_once):
    """One bucket of near copies, many of them below the threshold: no row per pair of them."""
    monkeypatch.setattr("riskloom.llm.jaccard.SHINGLES_AT_ONCE", at_once)
    r = random.Random(22)
    base = prose(840, 120).split()
    rows = []
    for k in range(150):
        words = list(base)
        for place in r.sample(range(120), r.choice([2, 3, 4])):
            words[place] = f"w{r.randint(0, 2)}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) AS key", "text AS __text")
    nodes = document_nodes(docs).groupBy("node", "s", "n", "vector").agg({"key": "min"}).withColumnRenamed("min(key)", "key")
    known = nodes.selectExpr("s", "s AS part")
    members = nodes.selectExpr("1L AS bucket", "0 AS side", "s", "n", "vector", "s AS part").repartition("bucket")
    clusters = bucket_clusters(members, 75)
    n = nodes.count()
    assert 100 < n and clusters.count() <= n
    links = [(x.a, x.b) for x in cluster_links(docs, clusters, nodes, known, 75).collect()]
    sets = {x.node: x.doc_id for x in document_nodes(docs).collect()}
    found = [set(x.tolist()) for x in shingle_sets([t.encode() for _, t in rows], 5)]
    for a, b in links:
        x, y = found[sets[a]], found[sets[b]]
        assert 100 * len(x & y) >= 75 * len(x | y)
    assert len(links) < (n if at_once > 4000 else 12 * n)
    whole = spark.createDataFrame([(sets[a], sets[b]) for a, b in links], "a long, b long")
    tied = {x.node: x.component for x in connected_components(whole).collect()}
    expected = brute_components(rows)
    assert {(i, tied.get(i, i)) for i in {sets[x.node] for x in nodes.collect()}} <= {(i, c) for i, _, c in expected}


def test_leading_shingles_share_enough():
    """Any linked pair has as many common leading shingles as the smaller bound says."""
    r = np.random.default_rng(9)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(300):
        n = int(r.integers(1, 300))
        pool = r.integers(0, 2**63, 2 * n).astype(np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.12], pool[n : n + n // 12]]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common) or not len(b):
            continue
        shared = len(np.intersect1d(leading(a, *none, 75)[0], leading(b, *none, 75)[0]))
        sizes = np.array([len(a), len(b)])
        assert shared >= common_needed(sizes, 75).min() >= least_buckets(sizes, 75).max()


def test_jaccard_of_copies_in_several_tasks(spark):
    """Near copies whose exact copies lie in other partitions, all quoted by one long document."""
    first = [prose(900 + k, 90).split() for k in range(24)]
    second = [[*w[:45], "changed", *w[46:]] for w in first]
    blocks = [
        [(1000 * b + k, " ".join(w)) for k, w in enumerate(words)]
        for b, words in ((1, first), (2, second), (3, first), (4, second))
    ]
    quoted = " ".join(" ".join([*a, *b]) for a, b in zip(first, second))
    blocks.append([(1, quoted)])
    placed = spark.sparkContext.parallelize(blocks, len(blocks)).flatMap(lambda rows: rows)
    docs = spark.createDataFrame(placed, "doc_id long, text string")
    assert docs.rdd.getNumPartitions() == len(blocks)
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
    assert set(brute_components([r for rows in blocks for r in rows])) ^ set(found) == set()


@pytest.mark.parametrize("split", [None, 130])
def test_rtree_loses_no_pair(split):
    r = np.random.default_rng(5)
    base = r.poisson(4, size=(12, 64))
    points = np.maximum(0, base[r.integers(0, 12, 300)] + r.integers(-1, 2, (300, 64))).astype(np.uint16)
    sizes, parts = points.sum(axis=1).astype(np.int64), r.integers(0, 3, 300)
    i, j = rtree_pairs(points, sizes, parts, 75, split)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    least = np.minimum(points[:, None, :].astype(int), points[None, :, :]).sum(axis=2)
    allowed = (least >= needed_overlap(sizes[:, None], sizes[None, :], 75)) & (parts[:, None] != parts[None, :])
    near = (100 * sizes[:, None] >= 75 * sizes[None, :]) & (100 * sizes[None, :] >= 75 * sizes[:, None])
    sides = np.ones((300, 300), bool) if split is None else np.not_equal.outer(np.arange(300) < split, np.arange(300) < split)
    expected = {(a, b) for a, b in np.argwhere(allowed & near & sides).tolist() if a < b}
    assert got == expected and len(expected) > 100 and len(i) == len(got)


def test_near_copies_are_searched_in_bounded_memory():
    r = np.random.default_rng(6)
    points = (r.poisson(3, 64) + r.integers(0, 2, (2000, 64))).astype(np.uint8)
    sizes = points.sum(axis=1).astype(np.int64)
    tracemalloc.start()
    pairs = rtree_pairs(points, sizes, np.arange(2000), 75, 1000)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(pairs[0]) == len(pairs[1]) == 1_000_000
    assert peak < 60_000_000  # twice the pairs, and not the points of all pairs that are compared


def test_forgotten_encoder_frees_its_caches():
    texts = ["One two-three, four.", "Caf\u00e9 na\u00efve 'tis 42%", None, "\u0130x \u01c5 <|x a\x01b"]
    forget_encoder()
    first = encode_all(texts, tokenizer_path(), 2)
    kept = sys.modules["riskloom_worker_state"]
    alive = weakref.ref(kept.encoder)
    forget_encoder()
    assert alive() is None
    assert encode_all(texts, tokenizer_path(), 2) == first
    whole = kept.encoder.tokenizer
    for text, ids in zip(texts, first[0]):
        assert np.frombuffer(ids, first[1]).tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2]
    forget_encoder()


def test_workers_give_back_what_arrow_keeps(spark, monkeypatch):
    taken = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            taken.append(work)

    document_nodes(Rows())
    line_table(Rows(), "text")
    tokenised(Rows(), tokenizer_path(), 2, "doc_id", "text")
    columns = {"z": [False], "d": [1], "k": [2], "doc_id": [1], "key": [2], "__text": ["a line\nof six words in all"]}
    batch = pa.RecordBatch.from_pydict(columns)
    released = []
    pool = types.SimpleNamespace(release_unused=lambda: released.append(True))
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    for work in taken:
        released.clear()
        given = work(iter([batch, batch]))
        assert [next(given).num_rows for _ in range(2)] == [1, 1] and not released
        assert list(given) == [] and released == [True]


def test_finer_groups_bound_the_overlap():
    r = np.random.default_rng(8)
    pool = r.integers(0, 2**63, 9000).astype(np.uint64)
    sets = [np.unique(r.choice(pool, n)) for n in (3, 500, 700, 1100, 2500, 9000)]
    vectors = [group_counts(s) for s in sets]
    assert [len(v) for v in vectors][:3] == [64, 512, 1024]
    for (a, x), (b, y) in itertools.combinations(zip(sets, vectors), 2):
        fine, coarse = overlap_bounds([x], [y])[0], np.minimum(folded([x], 64), folded([y], 64)).sum()
        assert len(np.intersect1d(a, b)) <= fine <= coarse


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(200, 100), (100, 200), (300, 300), (150, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 100, 150: 100}


def test_hilbert_visits_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    index = hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_ids_of_any_text():
    """Word by word the ids are those that the library gives the whole text."""
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer_path()), Encoder(tokenizer_path())
    r = random.Random(4)
    letters = list("abcXYZ  \n\t\r.,'s3<|>") + list("éÉßẞſİıŋʼnΣςσ́̊日Ͻ😀\xa0\x0b\x85ﬁÅ")
    letters += ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|EndOfText|>", "e\u0301", "don't", "A\u030a"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 16))) for _ in range(6000)]
    texts += ["<|ENDOFTEXT|>", "a <|ENDOFTEXT|> b", "<|EndOfText|>x", "<|STARTOFTEXT|>", "FẞϽ1c ŋF.Y̊", "ΑΣ ΑΣ.", "x<|endoftext|>Y"]
    for text in texts:
        assert np.frombuffer(own.encode(text), own.type).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = documents(spark)
    pieces = pack(docs, tokenizer_path(), length=256).toPandas()
    expected = collections.Counter(
        tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()
    )
    runs = collections.Counter()
    # a document's pieces follow one another on the line of sequences
    order = pieces.sort_values(["sequence_id", "offset"])
    current: list[int] = []
    for p in order.itertuples():
        assert p.start == len(current) and p.length == len(p.token_ids)
        assert zlib.crc32(np.array(p.token_ids, "<u4").tobytes()) == p.ids_crc32
        current += list(p.token_ids)
        if len(current) == p.doc_tokens:
            runs[tuple(current)] += 1
            current = []
    assert runs == expected
    filled = order.groupby("sequence_id").agg(n=("length", "sum"), first=("offset", "min"))
    assert (order.offset == order.groupby("sequence_id").length.cumsum() - order.length).all()
    assert (filled.n[filled.n < 256].map(lambda n: n & (n - 1)) == 0).all() and (filled.n <= 256).all()
    assert pack(empty(spark), tokenizer_path()).count() == 0
    short = pack(docs, tokenizer_path(), length=256, token_ids=False)
    assert "token_ids" not in short.columns
    narrow = pieces.drop(columns="token_ids").astype("float").fillna(-1)
    assert sorted(map(tuple, narrow.values.tolist())) == sorted(map(tuple, short.toPandas().astype("float").fillna(-1).values.tolist()))
    with pytest.raises(ValueError):
        pack(docs, tokenizer_path(), length=100)
