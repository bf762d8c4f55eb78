"""Hashes of the words of texts, computed for many words at once on the bytes of the texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_MASK = (1 << 64) - 1
_GROUP_BYTES = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + np.uint64(seed))


_BYTE = _numbers(1, 256)
_PLACE = _numbers(2, 4096) | np.uint64(1)

#: Words between ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Words of ASCII letters, digits and whatever is beyond ASCII; punctuation separates.
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = LETTERS[ord("A") : ord("Z") + 1] = True
LETTERS[ord("0") : ord("9") + 1] = LETTERS[128:] = True


def _hashed(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of the bytes."""
    a = np.frombuffer(data, np.uint8)
    mask = inside[a]
    edge = np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    length = ends - starts
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = _BYTE[a[mask]] * _PLACE[place & 4095]
    far = place > 4095
    if far.any():  # a word beyond the table of places
        value[far] = mix64(value[far] + (place[far] >> 12).astype(np.uint64))
    return starts, mix64(np.add.reduceat(value, first) + length.astype(np.uint64))


def word_groups(
    texts: Sequence[bytes | None], inside: np.ndarray = NOT_SPACE
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of groups of neighbouring texts, A-Z lower-cased, and where each text's words begin
    and the last one's end. A group has about a quarter of a megabyte, or one longer text."""
    group: list[bytes] = []
    size = 0

    def hashed() -> tuple[np.ndarray, np.ndarray]:
        starts, hashes = _hashed(b"\n".join(group).lower(), inside)
        ends = np.cumsum([len(t) + 1 for t in group])
        return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])

    for text in texts:
        text = text or b""
        if group and size + len(text) > _GROUP_BYTES:
            yield hashed()
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield hashed()


def word_hashes(texts: Sequence[bytes | None], inside: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """For each text the hashes of its words in order; none for NULL."""
    for hashes, bounds in word_groups(texts, inside):
        yield from np.split(hashes, bounds[1:-1])


def shingle_sets(texts: Sequence[bytes | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `n` words; fewer words are one run."""
    for hashes, bounds in word_groups(texts):
        runs = sequence_hashes(hashes, n)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            else:
                yield sequence_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of `n` neighbouring words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix64(out + hashes[k : k + m])
    return out
