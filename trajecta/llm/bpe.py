"""BPE encoding and decoding without a merge queue.

Encoder: an Aho-Corasick automaton over the reversed tokens finds, at each position of a piece, the longest token that starts
there. A left-to-right search takes it if it is compatible with the token before it, else the next shorter prefix token, and
steps back where none fits. Two neighbours are compatible if no merge across their border comes before the merges that made
them; answers are kept in a table. Each position is given up at most once, so a piece takes linear time, and the result is the
one that the merges give. Decoder: a table of all tokens' bytes and their offsets, gathered for many ids at once.

Defined results: null or empty text has no ids and decodes to the empty string; texts of any length are taken whole (slices of
about 2 MB at a time); repeated rows give repeated results. The input's other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from trajecta.llm import text as tx
from trajecta.llm import tokens

CACHE_WORDS = 200_000


class Cache(dict):
    """A dict that computes what it lacks; beyond `limit` entries a generation is set aside, and the one before it is dropped."""

    def __init__(self, compute, limit: int = CACHE_WORDS):
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class OffsetTable:
    """Byte strings by number, gathered for arrays of numbers."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        self.size = np.diff(self.at)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ids one after another, and the n + 1 places where they start."""
        size = self.size[ids]
        place = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=place[1:])
        return self.data[np.repeat(self.at[ids] - place[:-1], size) + np.arange(place[-1])], place


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies write for each byte."""
    seen = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder for a byte-level BPE file whose words end in a suffix (`tokenizers` JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        # One code point per start symbol: a byte, or a byte that ends its word.
        inner = {letters[b]: chr(b) for b in range(256)}
        final = {letters[b]: chr(0x100 + b) for b in range(256)}
        self.final = [final[letters[b]] for b in range(256)]

        def coded(token: str) -> str:
            if token.endswith(suffix) and len(token) > len(suffix):
                body = token[: -len(suffix)]
                return "".join(inner[c] for c in body[:-1]) + final[body[-1]]
            return "".join(inner[c] for c in token)

        self.coded = {coded(t): i for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.length = [0] * size
        self.shorter = [-1] * size
        self.halves = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for word, i in self.coded.items():
            self.length[i] = len(word)
            for n in range(len(word) - 1, 0, -1):
                if (j := self.coded.get(word[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.rank = [-1] * size
        for r, (a, b) in enumerate(model["merges"]):
            pair, i = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair], self.halves[i], self.rank[i] = i, pair, r
        self.automaton = ahocorasick.Automaton()
        for word, i in self.coded.items():
            self.automaton.add_word(word[::-1], i)
        self.automaton.make_automaton()
        self.pairs: Cache = Cache(self._compatible)
        self.pieces: Cache = Cache(self._piece)
        # Texts are cut as for the library; a piece of letters that the normaliser leaves as they are is a piece of the pattern.
        self.cutter = tokens.Encoder(path)
        self.cutter.known = tokens.Known(self._word)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        # Outside ASCII, normal forms and letter classes are the library's, as they depend on its Unicode version.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.decoder = OffsetTable([f"{names.get(i, '')} ".encode() for i in range(max(names) + 1)])
        self.decimals = OffsetTable([b"%d " % i for i in range(max(names) + 1)])

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging stops with this border in place: undo the later of the two last merges, again and again, and look
        for a merge across the border that would have come first."""
        left, right = pair
        rank, halves, merged = self.rank, self.halves, self.merged
        before = len(rank)
        while True:
            across = merged.get((left, right))
            if across is not None and rank[across] < before:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # Of equal ranks the left one was merged first, so the right one is undone first.
            if a > b:
                before, left = a, halves[left][1]
            else:
                before, right = b + 1, halves[right][0]

    def _piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of the split pattern."""
        word = piece[:-1].decode("latin-1") + self.final[piece[-1]]
        n = len(word)
        # By place from the end. The automaton names the tokens that end at a place from the longest on; the last entry of a key stays.
        longest = dict([*self.automaton.iter(word[::-1])][::-1])
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest.get(n - 1, -1)
        pairs, length, shorter = self.pairs, self.length, self.shorter
        while at < n:
            while token >= 0 and not (open_at[at + length[token]] and (not out or pairs[out[-1], token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest.get(n - 1 - at, -1)
            else:
                open_at[at] = 0
                token = out.pop()
                at -= length[token]
        return tuple(out)

    def _plain(self, chunk: str) -> list[int]:
        if chunk.isascii():
            pieces = self.pattern.findall(chunk.lower())
        else:
            pieces = [x for x, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]
        out: list[int] = []
        for piece in pieces:
            out += self.pieces[piece.encode()]
        return out

    def _word(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of a piece that the cutter makes."""
        if word.isalpha() and word.islower():
            return array("I", self._piece(word)).tobytes()
        chunk = word.decode("utf-8", "replace")
        if tokens.FOLDED_WORD.fullmatch(chunk) and chunk.lower() == chunk:
            return array("I", self._piece(word)).tobytes()
        ids: list[int] = []
        at = 0
        if self.special_pattern is not None and "<|" in chunk:
            for m in self.special_pattern.finditer(chunk):
                ids += self._plain(chunk[at : m.start()])
                ids.append(self.special[m[0]])
                at = m.end()
        ids += self._plain(chunk[at:])
        return array("I", ids).tobytes()

    def encode_all(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts raw[at[i]:at[i+1]] one after another, and the n + 1 places where each text's begin."""
        return self.cutter.encode(raw, at)

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decoder.gather(ids)[0].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode_column(df: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, ids array<int>: each row's whole text encoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for rows, raw, at in tx.slices(batches, column):
            ids, edge = bpe.encode_all(raw, at)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32)))], [key, "ids"])

    return df.select(F.col(key), F.col(column).alias(column)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_column(df: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key, text string: the ids of an array column decoded; null is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for rows in batches:
            out = [bpe.decode(np.array(x if x is not None else [], np.int64)).decode() for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.string())], [key, "text"])

    return df.select(F.col(key), F.col(column)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for rows, raw, at in tx.slices(batches, column):
            ids, edge = bpe.encode_all(raw, at)
            digests = []
            for table in (bpe.decimals, bpe.decoder):
                flat, place = table.gather(ids)
                view, cut = memoryview(flat), place[edge].tolist()
                digests.append([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:])])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(edge)), *(pa.array(x, pa.string()) for x in digests)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key), F.col(column).alias(column)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
