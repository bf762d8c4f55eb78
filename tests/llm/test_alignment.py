"""Cross-tokenizer alignment against a plain version on whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from llm_data import documents, empty, prose
from riskloom.llm import alignment
from riskloom.llm.alignment import Aligner, _added_up, align_documents, link_counts, refined_ends
from riskloom.llm.op13 import tokenizer_paths
from riskloom.sources.shared import write_shared


@pytest.fixture(scope="module")
def plain():
    """Text -> groups [(a ids, b ids)] from whole encodings and decoded bytes only."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    path_a, path_b = tokenizer_paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    letters = {}
    for byte in range(256):  # the tokenizer's own spelling of each byte
        if byte < 128:
            letters[a.encode(chr(byte), add_special_tokens=False).tokens[0]] = byte
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    letters = {chr(byte) if byte in printable else chr(next(rest)): byte for byte in range(256)} | letters
    assert isinstance(a.decoder, decoders.ByteLevel)

    def groups(text):
        if not text:
            return []
        data = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            return []
        out, left, right, at_a, at_b = [], [], [], 0, 0
        sides = iter(zip(ids_b, bytes_b))
        for i, spelled in zip(ids_a, bytes_a):
            left.append(i)
            at_a += len(spelled)
            while at_b < at_a:
                j, spelled = next(sides)
                right.append(j)
                at_b += len(spelled)
            if at_a == at_b:
                out.append((left, right))
                left, right = [], []
        return out

    return groups


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


AWKWARD = ["  two  spaces ", "\n\n x\n  y\n", "<|endoftext|> <s> </s> <unk> <0x41>", "日本語 한국 😀👩‍👩‍👧 é", "▁ lower block", "a▁b", "tab\tand\r\nreturn \x00 \x1c\x85   　x", "'s don't WE'LL 3.14 10000", " ", "\n", "x" * 5000, "ab " * 3000, "ý " * 70, "﻿bom ​ zero"]


def test_refined_ends():
    # a character of three bytes in two tokens, then a plain token
    got = refined_ends(np.array([0, 2, 2, 5]), np.array([2, 5, 5, 7]), np.array([2, 1, 2, 2]))
    assert got.tolist() == [2, 3, 5, 7]
    # byte-fallback tokens whose spans are empty but the last one's
    got = refined_ends(np.array([0, 1, 1, 1]), np.array([1, 1, 1, 4]), np.array([1, 1, 1, 1]))
    assert got.tolist() == [1, 2, 3, 4]


def test_fuzz(plain):
    aligner = Aligner(*tokenizer_paths())
    assert aligner.apart
    r = random.Random(11)
    letters = list("abcdefgh THE  \n\n\t\r.,;'s't-_0123456789<>|/éüß日本😀́▁  \x00\x85ﬁ한אب")
    letters += ["<|endoftext|>", "<s>", "<0x41>", " the", " and", "\n\n", "  ", "‍"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(1500)] + AWKWARD
    words = [aligner.words(t) for t in texts]
    known = aligner.learn(words)
    for text, cut in zip(texts, words):
        found = [known[w] for w in cut]
        assert "".join(cut) == " " + text
        assert ("" if None in found else ";".join(x[0] for x in found)) == written(plain(text)), text


def test_words_that_come_again_stay_known(monkeypatch):
    monkeypatch.setattr(alignment, "WORDS_KEPT", 40)
    aligner = Aligner(*tokenizer_paths())
    encoded, align = [], aligner.align
    monkeypatch.setattr(aligner, "align", lambda words: encoded.extend(words) or align(words))
    for k in range(30):
        cut = aligner.words("the same words " + " ".join(f"n{k}x{j}" for j in range(10)))
        known = aligner.learn([cut])
        assert set(cut) <= known.keys()
        assert len(aligner.known) <= 40 and len(aligner.before) <= 40
    assert encoded.count(" same") == 1 and len(encoded) == len(set(encoded))


def rows(spark):
    extra = [(100 + k, t, "en", "s", 0) for k, t in enumerate(AWKWARD)] + [(200 + k, prose(k, 40), "en", "s", 0) for k in range(30)]
    return documents(spark, extra)


@pytest.mark.parametrize("frequent", [0, 5, 100_000])
def test_counts(spark, plain, frequent):
    docs = rows(spark).where("doc_id IS NULL OR doc_id <> 28").repartition(5)
    aligned = write_shared(align_documents(docs, *tokenizer_paths()))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    all_groups = [plain(t) for _, t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in all_groups]
    count = collections.Counter(p for one in links for p in set(one))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    expected = [
        (
            doc_id or -1,
            sum(len(a) for a, _ in g),
            sum(len(b) for _, b in g),
            len(g),
            len(one),
            sum(count[p] == best[p[0]] for p in one),
            sum(count[p] for p in one),
            hashlib.sha256(written(g).encode()).hexdigest() if g else "",
        )
        for (doc_id, _), g, one in zip(texts, all_groups, links)
    ]
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [(r.doc_id or -1, *[r[c] for c in columns]) for r in link_counts(aligned, frequent).collect()]
    assert sorted(got) == sorted(expected)
    spelled = {(r.doc_id, r.groups or "") for r in aligned.collect()}
    assert spelled == {(i, written(g)) for (i, _), g in zip(texts, all_groups)}


def test_long_group_is_counted():
    a, b = np.repeat([7, 8, 7], 200), np.repeat([3, 4], 250)
    g = np.zeros
    pairs, times, ends = Aligner._links(a, g(600, int), np.array([600]), b, g(500, int), np.array([500]))
    assert ends.tolist() == [4] and dict(zip(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()), times.tolist())) == {
        (7, 3): 100_000, (7, 4): 100_000, (8, 3): 50_000, (8, 4): 50_000,
    }


def test_added_up():
    codes = [np.array(x, np.int64).tobytes() for x in ([5, 7], [5], [9, 5])]
    every, times = _added_up(tuple(codes), (None, np.array([4]).tobytes(), None))
    assert (every.tolist(), times.tolist()) == ([5, 7, 9], [6, 1, 1])
    every, times = _added_up(tuple(codes), (None, None, None))
    assert (every.tolist(), times.tolist()) == ([5, 7, 9], [3, 1, 1])


def test_empty_table(spark):
    aligned = write_shared(align_documents(empty(spark), *tokenizer_paths()))
    assert link_counts(aligned).count() == 0
