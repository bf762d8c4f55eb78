"""Text statistics, decision lists, mixing and ranking."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from llm_data import documents, empty, prose
from riskloom.llm.mixing import mix, source_targets
from riskloom.llm.op8 import mixed_documents
from riskloom.llm.op10 import base_failed, keep_good
from riskloom.llm.ranking import learn_ranker
from riskloom.llm.rules import learn_decision_list
from riskloom.llm.textstats import with_statistics


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    got = with_statistics(documents(spark), prefix="q_").collect()
    assert len(got) == documents(spark).count()
    for r in got:
        found = (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words)
        assert found == brute_statistics(r.text), r.doc_id
    assert with_statistics(empty(spark)).count() == 0


def test_statistics_under_a_filter(spark):
    """Filters run after the statistics; columns of the same names are replaced, others kept."""
    docs = documents(spark).selectExpr("*", "doc_id AS __cut0", "'x' AS n_words")
    got = with_statistics(docs).where("n_repeat_words > 100 AND n_dup_lines >= 0").where("n_words < 40000")
    expected = [r for r in docs.collect() if brute_statistics(r.text)[4] > 100]
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r.doc_id) for r in expected)
    assert [c for c in got.columns if c == "n_words"] == ["n_words"] and "__cut0" in got.columns


def test_decision_list_finds_planted_rule(spark):
    r = random.Random(1)
    rows = [(k, r.random(), r.random()) for k in range(3000)]
    labelled = spark.createDataFrame(
        [(k, a, b, 0 if a > 0.8 and b < 0.5 else 1) for k, a, b in rows] + [(5000, None, float("nan"), 1), (5001, 0.5, 0.5, None)],
        "id long, a double, b double, y int",
    )
    rules = learn_decision_list(labelled, ["a", "b"], "y", "id", max_rules=3)
    judged = labelled.where("y IS NOT NULL").select("y", rules.rejects({"a": F.col("a"), "b": F.col("b")}).alias("no"))
    counts = {(x.y, x.no): x["count"] for x in judged.groupBy("y", "no").count().collect()}
    assert counts[0, True] > 0.9 * (counts[0, True] + counts.get((0, False), 0))
    assert counts.get((1, True), 0) < 0.1 * counts[0, True]
    assert "reject if" in str(rules)


def test_decision_list_without_labels(spark):
    none = spark.createDataFrame([], "id long, a double, y int")
    assert learn_decision_list(none, ["a"], "y", "id").rules == []


def test_quality_filter_keeps_columns(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(k, 1) for k in range(12)] + [(31, 0), (32, None)], "doc_id long, quality int")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(12)) <= ids and not {23, 24, 25, 26, 32} & ids
    failed = with_statistics(docs).where(base_failed()).select("doc_id").collect()
    counted = {r.doc_id: brute_statistics(r.text) for r in docs.collect() if r.doc_id != 28}
    assert {r.doc_id for r in failed} == {i for i, (n, *_, again) in counted.items() if n < 50 or 100 * again > 50 * n}
    assert {r.doc_id for r in failed} == {23, 24, 25, 26, 27, 31, 32, 33}
    assert keep_good(empty(spark), labels).count() == 0


def brute_targets(sizes):
    """The excess over twice a source's size is dealt again by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not above:
            return target | {s: 2.0 * sizes[s] for s in full}
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 20, None: 7}, {"a": 5}, {"a": 0, "b": 9}, {"b": 3, "aa": 400, "é": 80, "z": 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark):
    docs = documents(spark)
    got = mix(docs).collect()
    assert len(got) == docs.count()
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.source].append(r)
    sizes = {s: sum(r.size for r in v) for s, v in rows.items()}
    expected = brute_targets(sizes)
    for source, v in rows.items():
        assert sum(r.taken for r in v) == int(expected[source] + 0.5)
        budget = int(expected[source] + 0.5)
        epochs, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        key = lambda r: (hashlib.md5(f"mix|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.size, r.tie)
        for r in sorted(v, key=key):
            part = max(0, min(r.size, rest))
            rest -= part
            assert r.taken == epochs * r.size + part <= 2 * r.size
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, got))
    assert mix(empty(spark)).count() == 0


def test_mixed_documents_end_among_repeated_rows(spark):
    text = " ".join("abcdefghij")
    rows = [(k, text, source) for k, source in enumerate("abc") for _ in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = collections.Counter()
    for r in mixed_documents(docs).collect():
        words[r.source] += len(r.text.split())
    # weights 3, 1, 2 of 450 words, at most 200 a source
    assert words == {"a": 200, "b": 83, "c": 167}


def test_mixed_documents(spark):
    docs = documents(spark)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken, copied = collections.Counter(), collections.Counter()
    for r in mix(docs).collect():
        taken[r.doc_id] += r.taken
    originals = collections.defaultdict(set)
    for r in docs.collect():
        originals[r.doc_id].add(r.text)
    for r in out.collect():
        copied[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert any(t and t.startswith(r.text) for t in originals[r.doc_id])
    assert +taken == copied


def test_ranker(spark):
    r = random.Random(3)
    rows = [(k, float(k % 7 == 0) + r.gauss(0, 0.2), r.gauss(0, 1), 0 if k % 7 == 0 else 1) for k in range(2000)]
    table = spark.createDataFrame(rows, "id long, a double, b double, y int")
    ranker = learn_ranker(table, ["a", "b"], "y", "id")
    scored = table.select("y", ranker.score({"a": F.col("a"), "b": F.col("b")}).alias("s")).toPandas()
    assert scored.s.between(0, 1).all()
    assert ((scored.s >= 0.3) == (scored.y == 1)).mean() > 0.97
    one = learn_ranker(table.where("y = 1"), ["a", "b"], "y", "id")
    assert set(one.weights) == {0.0}
