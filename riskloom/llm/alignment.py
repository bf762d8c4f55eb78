"""Alignment of two tokenizers on the same texts.

Both tokenizers cut the bytes of a space and the text. Their own spans give coarse cuts: character
offsets from the byte-level tokenizer, byte spans from sentencepiece. Where several tokens
share a character, or a byte-fallback token has no span of its own, the cut is refined by the length of
the token's decoded bytes. Byte offsets where tokens of both end cut the tokens into groups, and every
token of one side is linked with every token of the other side of its group.

A single space or newline between two visible characters is a place where both tokenizers cut whatever
stands around it (checked on the two files), so texts are aligned word by word, and words seen before
come from a cache of bounded size, which lets go only of words that did not come again. Texts are read once; corpus-wide counts of id pairs are one Spark
aggregate. The FREQUENT most frequent pairs are looked up in a broadcast array, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.shared import write_shared

from .common import bounded_slices

FREQUENT = 65_536
WORDS_KEPT = 250_000  # of each of two generations
LONGEST_WORD = 64  # longer stretches are aligned without being kept
BYTES_AT_ONCE = 1 << 20
STRETCH = 1 << 14  # characters of new words that are encoded at once
PIECE_SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def refined_ends(start: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """End of each token in bytes, from the tokenizer's spans and the decoded tokens' lengths.

    A span of its own gives a coarse cut. A token that shares a character with a neighbour, or has
    an empty span, ends as many bytes after the last coarse cut as the decoded bytes since then.
    """
    alone = end > start
    shared = end[:-1] > start[1:]
    alone[:-1] &= ~shared
    alone[1:] &= ~shared
    total = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(alone, np.arange(len(end)), -1))
    base = np.where(last < 0, 0, end[last] - total[last])
    return base + total


class Aligner:
    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        self.a_bytes = {
            i: bytes([letters[c] for c in name]) if all(c in letters for c in name) else name.encode()
            for name, i in self.a.get_vocab().items()
        }
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(PIECE_SPACE, " ").encode()
            for i, name in enumerate(names)
        ]
        self.a_lengths = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, spelled in self.a_bytes.items():
            self.a_lengths[i] = len(spelled)
        self.b_lengths = np.array([len(spelled) for spelled in self.b_bytes])
        # each id as it is written before another of its side, the other side and the next group
        self.numbers = [f"{i}{c}" for i in range(max(len(self.a_lengths), len(self.b_lengths))) for c in ",|;"]
        self.number_lengths = np.array([len(x) for x in self.numbers])
        self.apart = self._cuts_at_spaces(names)
        self.known: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def _cuts_at_spaces(self, names: list[str]) -> bool:
        """Whether both tokenizers always cut before a lone space or newline."""
        cutter = json.loads(self.a.to_str())
        by_pattern = (cutter.get("pre_tokenizer") or {}) == {
            "type": "ByteLevel",
            "add_prefix_space": False,
            "trim_offsets": True,
            "use_regex": True,
        } and cutter.get("normalizer") is None
        crossing = re.compile(f"[^{PIECE_SPACE}]{PIECE_SPACE}|\n")
        plain = "xÅ ﬁ  ý "  # letters that a normalising model would change
        return by_pattern and self.b.normalize(plain) == PIECE_SPACE + plain.replace(" ", PIECE_SPACE) and not any(
            crossing.search(name) for name in names
        )

    def tokens(self, stretch: str) -> tuple[np.ndarray, ...] | None:
        """Ids and ends of both sides on a stretch that begins with a space or a newline; None if the
        tokens of one side do not spell it byte by byte."""
        data = stretch.encode()
        found = self.a.encode(stretch, add_special_tokens=False)
        a = np.array(found.ids, np.int64)
        letters = np.frombuffer(data, np.uint8)
        at = np.append(np.flatnonzero((letters & 0xC0) != 0x80), len(data))  # first byte of each character
        spans = at[np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(a)).reshape(-1, 2)]
        a_ends = self._ends(a, spans, self.a_bytes, self.a_lengths, data)

        led = stretch[0] == " "
        found = self.b.encode(data[1:] if led else data, return_type="offset_mapping")
        b = np.array(found["ids"], np.int64)
        # the space that the model puts first has no place in its own text
        spans = np.fromiter(chain.from_iterable(found["offsets"]), np.int64, 2 * len(b)).reshape(-1, 2) + 1
        if led:
            spans[spans == 1] = 0
            spans[spans[:, 1] == 0, 1] = 1  # the space alone is a token
        elif len(b) and self.b_bytes[b[0]] == b" ":
            b, spans = b[1:], spans[1:] - 1
        else:
            return None
        b_ends = self._ends(b, spans, self.b_bytes, self.b_lengths, data)
        return None if a_ends is None or b_ends is None else (a, a_ends, b, b_ends)

    @staticmethod
    def _ends(ids, spans, spelled, lengths, data: bytes) -> np.ndarray | None:
        if b"".join([spelled[i] for i in ids.tolist()]) != data:
            return None
        ends = refined_ends(spans[:, 0], spans[:, 1], lengths[ids])
        # decoded bytes decide where a tokenizer's span is off
        return ends if np.array_equal(ends, np.cumsum(lengths[ids])) else np.cumsum(lengths[ids])

    def align(self, words: list[str]) -> list[tuple | None]:
        """For neighbouring words: groups as text, id pairs, their times, and numbers of tokens and groups.

        None for a word whose bytes the tokens do not spell.
        """
        found = self.tokens("".join(words))
        ends = np.cumsum([len(w.encode()) for w in words])
        if found is not None:
            a, a_ends, b, b_ends = found
            common = np.intersect1d(a_ends, b_ends, assume_unique=True)
            last = np.searchsorted(common, ends)
        if found is None or not np.array_equal(common[np.minimum(last, len(common) - 1)], ends):
            return [None] if len(words) == 1 else [self.align([w])[0] for w in words]
        n = len(common)
        ga, gb = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        na, nb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        group_ends = last + 1
        # the written groups: ids of both sides in the order of group and side
        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        sides = np.stack([na, nb], axis=1).ravel()
        places = 3 * np.concatenate([a, b])[order]
        places[np.cumsum(sides) - 1] += np.tile([1, 2], n)
        text = "".join(map(self.numbers.__getitem__, places.tolist()))
        letters = np.concatenate([[0], np.cumsum(self.number_lengths[places])])
        text_ends = letters[np.cumsum(na + nb)[group_ends - 1]]
        pairs, times, pair_ends = self._links(a, ga, na, b, gb, nb)
        pair_ends = pair_ends[group_ends - 1]
        a_sizes, b_sizes, g_sizes = (
            np.diff(x, prepend=0).tolist() for x in (np.cumsum(na)[group_ends - 1], np.cumsum(nb)[group_ends - 1], group_ends)
        )
        pairs, times = pairs.tobytes(), None if times is None else times.tobytes()
        out, t0, p0 = [], 0, 0
        for t, p, *sizes in zip(text_ends.tolist(), (8 * pair_ends).tolist(), a_sizes, b_sizes, g_sizes):
            out.append((text[t0 : t - 1], pairs[p0:p], times and times[p0:p], *sizes))
            t0, p0 = t, p
        return out

    @staticmethod
    def _links(a, ga, na, b, gb, nb) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Linked id pairs by group, how often each is meant (None: once), and where each group's pairs end."""
        links = na * nb
        first_b = np.cumsum(nb) - nb
        if not len(links) or links.max() <= 1 << 16:
            times = nb[ga]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_b[ga], times)
            pairs = (np.repeat(a, times) << 32) + b[place]
            return pairs, None, np.cumsum(links)
        pairs, times, ends, first_a = [], [], [], np.cumsum(na) - na
        for g in range(len(links)):  # equal ids of a long group are counted, not paired one by one
            x, nx = np.unique(a[first_a[g] : first_a[g] + na[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
            pairs.append(((x << 32)[:, None] + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            ends.append(len(pairs[-1]))
        return np.concatenate(pairs), np.concatenate(times).astype(np.int64), np.cumsum(ends)

    def words(self, text: str) -> list[str]:
        """A space and the text, cut where both tokenizers cut whatever stands around."""
        return _BOUNDARY.split(" " + text) if self.apart else [" " + text]

    def learn(self, texts: list[list[str]]) -> dict[str, tuple | None]:
        """The alignment of every word of the texts; words not seen before are encoded side by side."""
        known = self.known
        missing = set().union(*texts).difference(known)
        if len(known) + len(missing) > WORDS_KEPT:
            # words that do not come again before the next turn are let go
            self.before, self.known = known, {}
            known, missing = self.known, set().union(*texts)
        before = self.before
        again = {w: before[w] for w in missing if w in before}
        known.update(again)
        missing.difference_update(again)
        group, size, new = [], 0, {}
        for w in sorted(missing):
            # only words between visible characters may stand side by side
            lone = not self.apart or w[1:2].isspace() or w[-1].isspace()
            if group and (lone or size + len(w) > STRETCH):
                new.update(zip(group, self.align(group)))
                group, size = [], 0
            if lone:
                new[w] = self.align([w])[0]
            else:
                group.append(w)
                size += len(w)
        if group:
            new.update(zip(group, self.align(group)))
        known.update((w, v) for w, v in new.items() if len(w) <= LONGEST_WORD)
        return known if len(new) == 0 or max(map(len, new)) <= LONGEST_WORD else {**known, **new}


#: Before a lone space or newline between two visible characters.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _aligner(byte_level: str, pieces: str) -> Aligner:
    """The aligner of this process, so that its cache outlives a task."""
    kept = sys.modules.setdefault("riskloom_alignment_state", types.ModuleType("riskloom_alignment_state"))
    if getattr(kept, "files", None) != (byte_level, pieces):
        kept.files, kept.aligner = (byte_level, pieces), Aligner(byte_level, pieces)
    return kept.aligner


ROW = [("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long")]
ROW += [("groups", "string"), ("groups_sha256", "string"), ("pairs", "array<long>"), ("times", "array<long>")]


def align_documents(
    docs: DataFrame, byte_level: str, pieces: str, id_column: str = "doc_id", text: str = "text", groups: bool = True
) -> DataFrame:
    """The alignment of every row of `docs`.

    doc_id, n_a, n_b, n_groups, n_links; groups ('a1,a2|b1;a3|b2,b3' by ids in order, NULL unless
    asked) and its SHA-256; the distinct linked id pairs (pairs: a << 32 | b, ascending) and how often
    each is linked (times). A text that is NULL or empty, or that the tokens of one side do not spell byte
    by byte, has no tokens: zeros, an empty groups_sha256 and empty lists. Texts are read whole,
    repeated rows are aligned each; other columns are not read.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_level, pieces)
        none = np.zeros(0, np.int64)
        for batch in (s for b in batches for s in bounded_slices(b, "__text", BYTES_AT_ONCE)):
            out = {name: [] for name, _ in ROW[1:]}
            texts = [aligner.words(t) if t else [] for t in batch.column("__text").to_pylist()]
            known = aligner.learn(texts)
            for words in texts:
                found = list(map(known.__getitem__, words))
                if not found or None in found:
                    row = (0, 0, 0, 0, None, "", none, none)
                else:
                    written, codes, counts, *sizes = zip(*found)
                    whole = ";".join(written)
                    every, times = _added_up(codes, counts)
                    digest = hashlib.sha256(whole.encode()).hexdigest()
                    row = (*map(sum, sizes), int(times.sum()), whole if groups else None, digest, every, times)
                for name, value in zip(out, row):
                    out[name].append(value)
            lists = {name: _lists(out.pop(name)) for name in ("pairs", "times")}
            kinds = {name: pa.string() if kind == "string" else pa.int64() for name, kind in ROW}
            arrays = [batch.column("doc_id"), *[pa.array(v, kinds[name]) for name, v in out.items()], *lists.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in ROW])

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    return rows.mapInArrow(describe, ", ".join(f"{name} {kind}" for name, kind in ROW))


def _added_up(codes: tuple[bytes, ...], counts: tuple[bytes | None, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of all words, ascending, and how often each is linked."""
    pairs = np.frombuffer(b"".join(codes), np.int64)
    if not any(counts):
        return np.unique(pairs, return_counts=True)
    times = np.concatenate([np.frombuffer(n, np.int64) if n else np.ones(len(c) // 8, np.int64) for c, n in zip(codes, counts)])
    every, place = np.unique(pairs, return_inverse=True)
    return every, np.bincount(place, times).astype(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs): in how many rows an id pair is linked."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal pairs of a batch are added up before they reach the shuffle
        for batch in batches:
            pairs, n = np.unique(_flat(batch.column("pairs"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return (
        aligned.select("pairs").mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs"))
    )


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list begins and the last one ends."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def link_counts(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of `aligned` with n_best and count_sum instead of the lists.

    n_best counts the links whose pair has the highest count of its A id in the corpus, ties included;
    count_sum adds the pair's count over all links. `aligned` must be written: it is read twice. Two
    things reach the driver and the tasks: one number per id of vocabulary A, and the `frequent` most
    frequent pairs; the links of all other pairs, none of them hot, are joined with their counts.
    """
    spark = aligned.sparkSession
    rows = aligned.withColumn("row", F.monotonically_increasing_id())
    counts = write_shared(pair_counts(aligned))
    a = F.shiftrightunsigned("pair", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n_docs").alias("best")).toArrow()
    most = np.zeros(int(max([*highest.column("a").to_pylist(), 0])) + 1, np.int64)
    most[highest.column("a").to_numpy()] = highest.column("best").to_numpy()
    top = counts.orderBy(F.desc("n_docs"), "pair").limit(frequent).toArrow()
    order = np.argsort(top.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast((top.column("pair").to_numpy()[order], top.column("n_docs").to_numpy()[order], most))
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n_docs, best = shared.value
        for batch in batches:
            codes, bounds = _flat(batch.column("pairs"))
            times, _ = _flat(batch.column("times"))
            at = np.searchsorted(pairs, codes)
            hit = np.zeros(len(codes), bool)
            inside = at < len(pairs)
            hit[inside] = pairs[at[inside]] == codes[inside]
            count = np.zeros(len(codes), np.int64)
            count[hit] = n_docs[at[hit]]
            first = np.where(hit & (count == best[codes >> 32]), times, 0)
            totals = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in (first, times * count)]
            left = np.diff(np.concatenate([[0], np.cumsum(~hit)])[bounds])
            ends = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
            rare = [pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (codes, times)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *map(pa.array, totals), *rare],
                names=[*kept, "n_best", "count_sum", "rare", "rare_times"],
            )

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema += ", n_best long, count_sum long, rare array<long>, rare_times array<long>"
    known = write_shared(rows.select(*kept, "pairs", "times").mapInArrow(add_up, schema))
    links = known.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select(
        "row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times")
    )
    tops = spark.createDataFrame(highest.to_pandas(), "a long, best long")
    # one number per id of a vocabulary: bounded, whatever the corpus
    judged = counts.join(F.broadcast(tops), counts["pair"].bitwiseAND(F.lit(-1 << 32)) == F.shiftleft("a", 32)).select(
        "pair", "n_docs", (F.col("n_docs") == F.col("best")).alias("first")
    )
    rest = (
        links.join(judged, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("first"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n_docs")).alias("more_sum"),
        )
    )
    total = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return known.drop("rare", "rare_times").join(rest, "row", "left").select(*kept[1:], *total)
