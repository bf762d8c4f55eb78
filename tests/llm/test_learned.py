"""URL models, toxicity and WARC archives."""

import collections
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_data import documents, empty, prose
from riskloom.llm import warc
from riskloom.llm.op2 import RULES
from riskloom.llm.op3 import round_trip
from riskloom.llm.toxicity import fit, score
from riskloom.llm.urls import UrlModel, context_counts, judge, score_text

URLS = [
    ("http://a.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://org/x", "org", "/x", "org/", "allow"),
    ("http://x.org", "x.org", "", None, None),
    ("http://forg/x", "forg", "/x", None, None),
    ("https://w.com/fr/a#b", "w.com", "/fr/a", "com/fr/", "allow"),
    ("https://w.com/de/?q=http://x.org/", "w.com", "/de/", "com/de/", "block"),
    ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("https://example.org/en/27", "example.org", "/en/27", "org/", "allow"),
    ("https://É.net/A?b", "É.net", "/A", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://" + "a" * 5000 + ".net/" + "b" * 5000, "a" * 5000 + ".net", "/" + "b" * 5000, None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u[0], 1) for k, u in enumerate(URLS)], "page_id long, url string, score int")
    got = {r.page_id: r for r in judge(pages, RULES).collect()}
    assert len(got) == len(URLS)
    for k, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert judge(pages.where("false"), RULES).count() == 0


def test_url_counts_and_score(spark):
    texts = [("abab", True), ("abba", True), ("bbbb", False)]
    frame = spark.createDataFrame(texts, "text string, allowed boolean")
    brute = collections.defaultdict(lambda: [0, 0])
    for text, allowed in texts:
        padded = "\n" + text
        for i in range(1, len(padded)):
            for k in range(0, min(i, 2) + 1):
                brute[padded[i - k : i], padded[i]][not allowed] += 1
    rows = context_counts(frame, 2).collect()
    assert {(r.context, r.ch): [r.a, r.b] for r in rows} == brute
    model = UrlModel([tuple(r) for r in rows], 2)
    assert score_text("abab", model.seen, model.back, 2) > 0 > score_text("bbbb", model.seen, model.back, 2)
    assert score_text("", model.seen, model.back, 2) == 0


def test_url_model_separates_unruled(spark):
    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    rows = [f"http://{word('abc')}.com/fr/{word('abc')}" for _ in range(200)]
    rows += [f"http://{word('xyz')}.com/de/{word('xyz')}" for _ in range(200)]
    rows += [f"http://{word('abc')}.net/qq/{word('abc')}" for _ in range(50)]
    rows += [f"http://{word('xyz')}.net/qq/{word('xyz')}" for _ in range(50)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = [x.verdict for x in judge(pages, RULES).orderBy("page_id").collect()]
    assert got[400:450].count("allow") > 45 and got[450:].count("block") > 45


def test_url_models_keep_every_count(spark):
    matched = {rule.text: rule.verdict == "allow" for rule in RULES}
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    rows = [f"http://{word()}.com/{k}/{word()}" for k in ("fr", "de", "qq") for _ in range(900)]
    rows += [u for u, *_ in URLS] + [rows[0], rows[-1]] + [None] * 40
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    judged = judge(pages, RULES)
    got = {x.page_id: x for x in judged.collect()}
    assert len(got) == len(rows)
    taught = [(x.host + x.path, matched[x.rule]) for x in got.values() if x.rule and x.host + x.path]
    frame = spark.createDataFrame(taught, "text string, allowed boolean")
    counts = [tuple(x) for x in context_counts(frame).collect()]
    assert len(counts) > 150_000
    model = UrlModel(counts, 5)
    for x in got.values():
        assert x.score == pytest.approx(score_text(x.host + x.path, model.seen, model.back, 5), abs=1e-9)


def test_toxicity_held_out(spark):
    rows = [(k, prose(k, 80) + (" nasty horrible" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    weights = fit(docs.where("doc_id < 400"), docs.where("doc_id < 400").select("doc_id", F.col("y").alias("toxic")), "doc_id", "text", "toxic")
    assert 1 < len(weights) < 5000
    got = score(docs.where("doc_id >= 400"), weights, "doc_id", "text", ["y"]).toPandas()
    assert ((got.score >= 0.3) == (got.y == 1)).mean() > 0.97


def test_toxicity_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (23, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    weights = fit(docs, labels, "doc_id", "text", "toxic")
    got = score(docs, weights, "doc_id", "text", ["lang"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert fit(empty(spark), labels.where("false"), "doc_id", "text", "toxic") == {}
    assert {r.score for r in score(docs, {}, "doc_id", "text", []).collect()} == {0.5}


def test_warc_round_trip(spark):
    big = prose(1, 9000)
    rows = [(5, "http://a/\r\nX: y", big), (3, "http://b/", big), (9, None, big), (None, "http://n/", big)]
    rows += [(11, "u", None), (12, None, ""), (13, "u", "short"), (14, "u", "short"), (15, "u", "é" * 60), (15, "u", "é" * 60)]
    rows += [(100 + k, "u", prose(k, 40)) for k in range(30)]
    got = round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    html = collections.Counter((r[0], len((r[2] or "").encode())) for r in rows)
    assert collections.Counter((r.page_id, r.payload_bytes) for r in got) == html
    refers = {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (3, 5, 9, None, 15, 13)}
    assert refers == {
        (3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (15, "response", None), (13, "response", None),
    }
    import hashlib

    expected = {r[0]: hashlib.sha256((r[2] or "").encode()).hexdigest() for r in rows}
    assert all(r.payload_digest == expected[r.page_id] for r in got)
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("split", [7, 100, 1000, 10**9])
def test_every_record_has_one_owner(split):
    r = random.Random(2)
    fake = warc.MAGIC + b"\x00" * 7  # magic inside a stored payload is no record
    payloads = [bytes(r.randrange(256) for _ in range(r.randrange(0, 400))) + fake * (k % 3) for k in range(40)]
    data = b"".join(warc.record(k, "u", p, "d", None) for k, p in enumerate(payloads))
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    data += stored.compress(warc.VERSION + b"Content-Length: 20\r\nWARC-Record-ID: <urn:page:40>\r\n\r\n" + fake * 2 + b"\r\n\r\n") + stored.flush()
    found = []
    for start in range(0, len(data), split):
        found += [warc.parse(x) for x in warc.records_in_range(io.BytesIO(data), start, start + split, len(data))]
    assert [b for _, b in found] == [*payloads, fake * 2]
