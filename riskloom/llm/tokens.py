"""Token ids of whole texts by a public tokenizer file, with caches in the worker process.

For a tokenizer that lower-cases, drops white space and cuts words by a pattern, a text's ids are
the ids of its words one after another, so words seen before come from a cache of bounded size. A word
with a special token or with letters beyond Latin goes to the library as it stands. Any other
tokenizer encodes texts as a whole.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import types
from collections.abc import Sequence

import numpy as np

WORDS_KEPT = 700_000
PIECES_KEPT = 400_000


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.type == "<u2" else "I"
        pattern = self._word_pattern()
        self.pattern = regex.compile(pattern) if pattern else None
        # letters and marks on which the pattern and the library's agree; the rest goes to the library
        self.plain = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ſ]*")
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _word_pattern(self) -> str | None:
        made = json.loads(self.tokenizer.to_str())
        steps = [s["type"] for s in (made.get("normalizer") or {}).get("normalizers", [])]
        cuts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            return None
        split, letters = cuts
        if split["behavior"] != "Removed" or not split["invert"] or letters["add_prefix_space"] or letters["use_regex"]:
            return None
        return split["pattern"].get("Regex")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _word(self, word: str) -> bytes:
        low = word.lower()
        if "<|" in word or not self.plain.fullmatch(word) or not (word.isascii() or self.plain.fullmatch(low)):
            return self._whole(word)
        out = []
        for piece in self.pattern.findall(low):
            if piece == word:
                piece = word  # one string as the key of both caches
            found = self.pieces.get(piece)
            if found is None:
                # printable ASCII stands for itself
                spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(spelled)]
                found = struct.pack(f"<{len(ids)}{self.code}", *ids)
                if len(self.pieces) >= PIECES_KEPT:
                    self.pieces.clear()
                self.pieces[piece] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian numbers of `self.type`."""
        if self.pattern is None:
            return self._whole(text)
        if text.isascii() and "<|" not in text:
            text = text.lower()  # the same ids, and fewer words to keep
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) >= WORDS_KEPT:
            known.clear()
            known[""] = b""
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        return b"".join([known[w] for w in words])


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    """The encoder of this process, so that its cache outlives a task."""
    kept = sys.modules.setdefault("riskloom_worker_state", types.ModuleType("riskloom_worker_state"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, Encoder(path)
    return kept.encoder


def forget_encoder() -> None:
    """Free the encoder of this process and its caches; the next text makes a new one."""
    kept = sys.modules.get("riskloom_worker_state")
    if kept is not None:
        kept.path = kept.encoder = None


def encode_all(texts: Sequence[str | None], path: str, end: int) -> tuple[list[bytes], str]:
    """Ids of each text followed by the id `end`; NULL is an empty text. Also the numbers' type."""
    found = encoder(path)
    tail = np.array([end], found.type).tobytes()
    return [found.encode(t or "") + tail for t in texts], found.type
