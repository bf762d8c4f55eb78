"""Language identification: held-out accuracy, rejection and the awkward texts."""

import random

import pytest

from llm_data import documents, empty
from riskloom.llm.langid import DICTIONARY_BYTES, identify, learn_dictionaries, letters_only

SYLLABLES = {
    "aa": ["ka", "to", "mi", "ren", "sol", "du"],
    "bb": ["été", "eau", "ment", "oi", "que", "il"],
    "cc": ["ung", "sch", "ein", "ver", "ü", "ist"],
}


def sentence(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))).capitalize() for _ in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(k, sentence(lang, k, 40), lang) for lang in SYLLABLES for k in range(60)]
    rows += [(1, sentence("aa", 1, 40), "aa")] * 300  # copies count once
    rows += [(2, sentence("aa", 2, 40), None), (3, None, "bb"), (4, "", "dd"), (5, "12 ++", "ee")]
    return learn_dictionaries(spark.createDataFrame(rows, "id long, text string, lang string").repartition(5))


def test_dictionaries(learned):
    assert {name for name, _ in learned} == set(SYLLABLES) and learned[0][0] == "aa"
    assert all(0 < len(raw) <= DICTIONARY_BYTES for _, raw in learned)
    for name, raw in learned:
        others = [other for other in SYLLABLES if other != name]
        assert not any(s.encode() in raw for o in others for s in SYLLABLES[o] if len(s) > 2 and not any(s in x for x in SYLLABLES[name]))


def test_held_out_texts(spark, learned):
    rows = [(lang, sentence(lang, k, n)) for lang in SYLLABLES for k in range(1000, 1100) for n in (6, 30)]
    rows += [("cc", sentence("cc", 5, 20_000))]  # beyond one block
    got = identify(spark.createDataFrame(rows, "lang string, text string"), learned).collect()
    assert len(got) == len(rows)
    assert sum(r.best_lang == r.lang for r in got) >= 0.99 * len(got)
    assert all(r.detected_lang in (r.best_lang, None) for r in got)
    assert all(r.detected_lang == r.lang for r in got if len(r.text) > 200)


def test_smallest_code_wins(learned):
    from riskloom.llm.langid import _Coders

    coders = _Coders(learned)
    for lang in SYLLABLES:
        text = sentence(lang, 77, 50)
        sizes = dict(zip(coders.names, coders.sizes(letters_only(text))))
        best, margin, size = coders.classify(text)
        ordered = sorted(sizes.values())
        assert best == min(sizes, key=sizes.get) == lang
        assert size == ordered[0] and margin == 1 - ordered[0] / ordered[1]


def test_awkward_texts(spark, learned):
    docs = documents(spark).selectExpr("*", "doc_id AS lang_margin", "text AS best_lang")
    got = identify(docs, learned)
    assert got.columns[: len(docs.columns) - 2] == [c for c in docs.columns if c not in ("lang_margin", "best_lang")]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        none = not letters_only(r.text)
        assert (r.best_lang == "und") == none and 0 <= r.lang_margin <= 1
        assert (r.coded_bytes is None) == none
        if none:
            assert r.detected_lang is None and r.lang_margin == 0
    assert {r.doc_id for r in rows if r.best_lang == "und"} == {23, 24, 25, 31}
    tied = spark.createDataFrame([("x",), ("同",)], "text string")
    assert [r.best_lang for r in identify(tied, learned).collect()] == ["aa", "aa"]  # the more frequent one
    assert all(r.detected_lang is None for r in identify(tied, learned, margin=0.9).collect())
    assert identify(empty(spark), learned).count() == 0


def test_without_languages(spark):
    none = learn_dictionaries(spark.createDataFrame([], "text string, lang string"))
    assert none == []
    assert identify(spark.createDataFrame([("some text",)], "text string"), none).first().best_lang == "und"
    one = learn_dictionaries(spark.createDataFrame([("some text", "en")], "text string, lang string"))
    got = identify(spark.createDataFrame([("other text",)], "text string"), one).first()
    assert (got.best_lang, got.lang_margin) == ("en", 1.0)
