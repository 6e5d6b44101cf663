"""Whole texts to ids with the tokenizers library, each distinct piece of text encoded once.

A text is cut only where no token and no rule of the file's normaliser or pre-tokeniser can reach across, so the ids of the pieces
joined are the library's ids of the text. Two kinds of file are known: those that drop white space (cut at ASCII white space)
and byte-level ones whose pieces may begin with one space (cut before a space between two visible characters). Both are cut between
ASCII letters, digits and marks too, as their pre-tokenisers do, but not in a text that may hold a special token. Any other file is given whole texts.
Pieces are looked up by their bytes. A new piece goes to the library: to its model alone if it is one word of letters that the file's
normaliser leaves as it is, or to the whole tokenizer.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from trajecta.llm import text as tx

SLICE_BYTES = 1 << 20

# Least bytes of a generation of the cache at which it is put aside; the one put aside before goes.
CACHE_BYTES = 40 << 20
ENTRY_BYTES = 180

# ASCII letters, digits, and marks but for the apostrophe, which begins contractions.
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = 1
CLASS[48:58] = 2
CLASS[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 3

VISIBLE = np.zeros(256, bool)
VISIBLE[[*range(0x21, 0x7F), *range(0x80, 0x100)]] = True
# White space and separators outside ASCII.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SPECIAL = b"<|"
# Words of Latin letters without combining marks; composed already, and with `fold` in lower case.
FOLDED_WORD = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
SPACED_WORD = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def byte_letters() -> str:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies: visible Latin-1 characters for themselves, the others from U+0100 on."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in itself else next(others)) for b in range(256))


class Known(dict):
    """Ids of pieces, encoded when first asked for; `turn` puts full generations aside and forgets those put aside before."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        self.encode, self.older, self.held = encode, {}, 0

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece)
        self[piece] = ids
        self.held += len(piece) + len(ids) + ENTRY_BYTES
        return ids

    def turn(self) -> None:
        if self.held > CACHE_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()


class Encoder:
    """Texts as UTF-8 bytes to little-endian 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = all(SPECIAL.decode() in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        before = spec["pre_tokenizer"] or {}
        spaced = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        split, *after = before.get("pretokenizers") or [{}]
        dropped = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and split.get("behavior") == "Removed" and split.get("invert") and [x["type"] for x in after] == ["ByteLevel"]
        self.runs = self._spaced if plain and spaced else tx.word_bounds if plain and dropped else lambda raw, at: (at[:-1], at[1:], np.arange(len(at)))
        self.cuts = plain and bool(spaced or dropped)
        self.folds, self.spaced = plain and bool(dropped), plain and bool(spaced)
        self.word = FOLDED_WORD if self.folds else SPACED_WORD
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.known = Known(self._piece)

    @staticmethod
    def _spaced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut before each space that stands between two bytes of visible characters."""
        seen = VISIBLE[raw]
        if (raw >= 0x80).any():
            data = raw.tobytes()
            if WIDE_SPACE.search(data):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    if WIDE_SPACE.search(data, a, b):
                        seen[a:b] &= raw[a:b] < 0x80
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 2:
            cut[1:-2] = (raw[1:-1] == 32) & seen[:-2] & seen[2:]
        cut[at[:-1][np.diff(at) > 0]] = True
        # A space that begins or ends a document has a neighbour of another one; the first is a start anyway.
        ends = at[1:][np.diff(at) > 0] - 1
        cut[ends] &= np.isin(ends, at[:-1])
        start = np.flatnonzero(cut[:-1]) if len(raw) else np.zeros(0, np.int64)
        return start, np.append(start[1:], len(raw)) if len(start) else start, np.searchsorted(start, at, "left")

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The pieces of all texts, and the n + 1 numbers of the pieces before each text."""
        special = [i for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if data.find(SPECIAL, a, b) >= 0] if SPECIAL in (data := raw.tobytes()) else []
        if self.folds:
            low = tx.LOWER[raw]  # the file folds case anyway, but looks for special tokens before
            for i in special:
                low[at[i] : at[i + 1]] = raw[at[i] : at[i + 1]]
            raw = low
        start, end, first = self.runs(raw, at)
        if not self.cuts:
            data = raw.tobytes()
            return [data[a:b] for a, b in zip(start.tolist(), end.tolist())], first
        if not len(raw):
            return [], first
        kind = CLASS[raw]
        for i in special:
            kind[at[i] : at[i + 1]] = 0
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        begins[at] = False
        begins[start] = True
        start = np.flatnonzero(begins)
        # A byte that no UTF-8 text has goes before each piece, or a space where white space is dropped.
        data = np.insert(raw, start, 32 if self.folds else 0xFF).tobytes()
        return data.split() if self.folds else data.split(b"\xff")[1:], np.searchsorted(start, at, "left")

    def _piece(self, piece: bytes) -> bytes:
        if self.cuts and piece.isalpha() and (self.spaced or piece.islower()):
            return array("I", [t.id for t in self.model.tokenize(piece.decode())]).tobytes()
        text = piece.decode("utf-8", "replace")
        if self.cuts and self.word.fullmatch(text) and (self.spaced or text.lower() == text):
            return array("I", [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))]).tobytes()
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts raw[at[i]:at[i+1]] one after another, and the n + 1 places where each text's begin."""
        self.known.turn()
        pieces, first = self._pieces(raw, at)
        ids = [*map(self.known.__getitem__, pieces)]
        place = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) >> 2, out=place[1:])
        return np.frombuffer(b"".join(ids), "<u4"), place[first]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> Encoder:
    return Encoder(path)
