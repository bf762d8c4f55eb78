"""Ranked lexical search against brute force, and its trees."""

import collections
import heapq
import math
import random
import re

import numpy as np

from llm_data import documents, empty, prose
from riskloom.llm import lexical
from riskloom.llm.lexical import DocumentTree, lexical_search, parts_of_score

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, top=10):
    """{item row: [(score, doc_id), ...]} in rank order."""
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    length = sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = {}
    for item in items:
        scores = []
        for doc_id, c in counted:
            if not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            s = 0
            for t in set(terms(item[1])):
                if t in c:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out[item] = [(-s, None if gone else d) for s, gone, d in sorted(scores)[:top]]
    return out


def items(spark):
    rows = [(k, prose(k, 30)) for k in range(6)]
    rows += [(7, None), (8, ""), (9, "*** !!! \x7f"), (10, "É étage 中文 DON'T"), (11, "again and AGAIN"), (11, "two"), (12, "zzz unknown"), (None, prose(2, 20)), (3, prose(3, 30)), (3, prose(3, 30))]
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "item_id AS score", "text AS rank")


def found(result):
    got = collections.defaultdict(list)
    for r in result.orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.rank, r.score, r.doc_id))
    return got


def test_search_equals_brute_force(spark, monkeypatch):
    docs = documents(spark).repartition(7)
    asked = items(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    brute = brute_search(rows, {(r.item_id, r.text) for r in asked.collect()})
    expected = collections.defaultdict(list)
    for (item, _), best in brute.items():
        expected[item] += [(k + 1, *b) for k, b in enumerate(best)]
    expected = {k: sorted(v) for k, v in expected.items() if v}
    assert {k: sorted(v) for k, v in found(lexical_search(docs, asked)).items()} == expected
    # several blocks of items give the same rows
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 4)
    assert {k: sorted(v) for k, v in found(lexical_search(docs, asked)).items()} == expected
    assert len(expected) >= 8 and 12 not in expected
    assert lexical_search(empty(spark), asked).count() == 0
    assert lexical_search(docs, asked.where("false")).count() == 0


def test_many_equal_rows(spark):
    """Ties in score are ranked by id, whatever the task they lie in."""
    rows = [(k, "red green blue") for k in range(500, 0, -1)] + [(k, "red " * 3 + "green") for k in range(1000, 1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    asked = spark.createDataFrame([(1, "blue"), (2, "red"), (3, "blue red green")], "item_id long, text string")
    brute = brute_search(rows, {(r.item_id, r.text) for r in asked.collect()})
    got = found(lexical_search(docs, asked))
    for (item, _), best in brute.items():
        assert got[item] == [(k + 1, *b) for k, b in enumerate(best)]
    assert [d for _, _, d in got[1]] == list(range(1, 11))


def test_tree_bounds_and_paths():
    r = random.Random(5)
    n_terms, paths, tfs = 40, [], []
    for _ in range(900):
        path = np.array(sorted(x for x in range(n_terms) if r.random() < 1 / (1 + x / 3)), np.int64)
        paths.append(path)
        tfs.append(np.array([r.randint(1, 9) for _ in path], np.int64))
    m = np.array([r.randint(10, 400) for _ in paths], np.int64)
    tree = DocumentTree(paths, tfs, m, n_terms)
    assert sorted(tree.order) == list(range(900)) and tree.keys == sorted(tree.keys)
    for node, below in enumerate(tree.children):
        inside = slice(tree.low[node], tree.high[node])
        assert (tree.largest[node] == tree.tf[inside].max(axis=0)).all() and tree.least[node] == tree.m[inside].min()
        if len(below):
            assert [tree.low[c] for c in below] == [tree.low[node], *[tree.high[c] for c in below[:-1]]]
            assert tree.high[below[-1]] == tree.high[node]
    weights = np.arange(1, 6) * 1000
    asked = np.array([0, 4, 9, 20, 39])
    heap: list = []
    tree.search(asked, weights, heap, list(range(900)), 10)
    exact = parts_of_score(tree.tf[:, asked].astype(np.int64), tree.m[:, None]) @ weights
    best = sorted(((int(s), True, -tree.order[k]) for k, s in enumerate(exact) if s > 0), reverse=True)[:10]
    assert sorted(heap, reverse=True) == best == heapq.nlargest(10, best)
