"""Fill-in-the-middle transformation on ropes.

A document is a rope: leaves are ranges of its UTF-8 bytes that end between units (`[A-Za-z]+` or one other character), at about LEAF units, and each
node caches the units, code points and bytes below it. Both cuts are splits of the tree at a unit rank; the pieces are put together again with leaves for the
sentinels, and only the bytes of leaves that are cut are looked at again. The way back makes a rope of the output, finds the ranks of its sentinels, and
splits there. The leaves of all documents of an Arrow slice are found at once in numpy.

The cuts and the form follow from hashes of the key, so a result depends on its own row alone: no shuffle, and a lost task is simply run again.

Defined results: a null text is the empty text (form plain, n 0); a null key hashes as `1:` and nothing after it; ties, repeated rows and other columns do
not matter; `transformed` keeps the other columns and replaces those with a name of its own. An empty table gives an empty result. A letter run of any
length is one unit and so one leaf. Memory is bounded by SLICE_BYTES of text, or one document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import text as tx
from trajecta.llm.tables import replaced

LEAF = 256
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class Settings:
    """Percent of documents that are cut, and percent of those with the suffix first."""

    cut: int = 90
    suffix_first: int = 20


class Leaf:
    """bytes start to end of a buffer, with the number of units and code points in them."""

    __slots__ = ("buffer", "start", "end", "units", "chars", "height")

    def __init__(self, buffer: bytes, start: int, end: int, units: int, chars: int):
        self.buffer, self.start, self.end, self.units, self.chars, self.height = buffer, start, end, units, chars, 1

    @property
    def size(self) -> int:
        return self.end - self.start


class Node:
    __slots__ = ("left", "right", "units", "chars", "size", "height")

    def __init__(self, left: Leaf | Node, right: Leaf | Node):
        self.left, self.right = left, right
        self.units, self.chars, self.size = left.units + right.units, left.chars + right.chars, left.size + right.size
        self.height = 1 + max(left.height, right.height)


Rope = Leaf | Node | None


def joined(a: Rope, b: Rope) -> Rope:
    """a and then b; the heights of neighbours differ by one at most."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.left), b.right)
    return Node(a, b)


def _balanced(a: Leaf | Node, b: Leaf | Node) -> Node:
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= rope.units:
        return rope, None
    if isinstance(rope, Node):
        if rank <= rope.left.units:
            a, b = split(rope.left, rank)
            return a, joined(b, rope.right)
        a, b = split(rope.right, rank - rope.left.units)
        return joined(rope.left, a), b
    raw = np.frombuffer(rope.buffer, np.uint8)[rope.start : rope.end]
    first, unit = _starts(raw)
    at = int(np.flatnonzero(unit)[rank])
    chars = int(first[:at].sum())
    return Leaf(rope.buffer, rope.start, rope.start + at, rank, chars), Leaf(rope.buffer, rope.start + at, rope.end, rope.units - rank, rope.chars - chars)


def leaves(rope: Rope) -> Iterator[Leaf]:
    """In order."""
    stack = [rope] if rope is not None else []
    while stack:
        node = stack.pop()
        if isinstance(node, Leaf):
            yield node
        else:
            stack += (node.right, node.left)


def content(rope: Rope) -> bytes:
    return b"".join(leaf.buffer[leaf.start : leaf.end] for leaf in leaves(rope))


def _starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point, and whether a unit, begins at each byte."""
    first, letter = (raw & 0xC0) != 0x80, IS_LETTER[raw]
    unit = first.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return first, unit


def ropes(buffer: bytes, at: np.ndarray) -> list[Rope]:
    """The rope of each document between the offsets."""
    raw = np.frombuffer(buffer, np.uint8)
    first, unit = _starts(raw)
    inner = at[(at > 0) & (at < len(raw))]
    unit[inner] = True
    where, chars = np.flatnonzero(unit), np.append(0, np.cumsum(first))
    unit_at = np.searchsorted(where, at)
    out = []
    for begin, end, u, v in zip(at[:-1].tolist(), at[1:].tolist(), unit_at[:-1].tolist(), unit_at[1:].tolist()):
        if begin == end:
            out.append(None)
            continue
        cuts = [*where[u:v:LEAF].tolist(), end]
        codes = chars[cuts].tolist()
        row = [Leaf(buffer, cuts[i], cuts[i + 1], min(LEAF, v - u - LEAF * i), codes[i + 1] - codes[i]) for i in range(len(cuts) - 1)]
        while len(row) > 1:  # neighbours pair up level by level; an odd one out is joined at its height
            pairs = [Node(row[i], row[i + 1]) for i in range(0, len(row) - 1, 2)]
            if len(row) % 2:
                pairs[-1] = joined(pairs[-1], row[-1])
            row = pairs
        out.append(row[0])
    return out


def _sentinel(mark: bytes) -> Leaf:
    return Leaf(mark, 0, 3, 3, 3)


def arranged(rope: Rope, low: int, high: int, suffix_first: bool) -> tuple[Rope, int, int]:
    """The rope cut before units low and high and put together anew, with the code points of prefix and middle."""
    prefix, rest = split(rope, low)
    middle, suffix = split(rest, high - low)
    parts = ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)) if suffix_first else ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle))
    out = None
    for mark, part in parts:
        out = joined(joined(out, _sentinel(mark)), part)
    return out, prefix.chars if prefix else 0, middle.chars if middle else 0


def _rank(rope: Leaf | Node, byte: int) -> int:
    """The number of units before a byte at which one begins."""
    rank = 0
    while isinstance(rope, Node):
        if byte < rope.left.size:
            rope = rope.left
        else:
            rank, byte, rope = rank + rope.left.units, byte - rope.left.size, rope.right
    return rank + int(_starts(np.frombuffer(rope.buffer, np.uint8)[rope.start : rope.start + byte])[1].sum())


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from: split at the ranks of its sentinels.

    A text with a sentinel in it is never cut, and no sentinel can begin in a text and end in another sentinel, so the first of each is the one put in."""
    if form == "plain":
        return output
    (rope,) = ropes(output, np.array([0, len(output)]))
    second, third = (PREFIX, MIDDLE) if form == "spm" else (SUFFIX, MIDDLE)
    p = _rank(rope, output.index(second, 3))
    q = _rank(rope, output.index(third, 3))
    _, rest = split(rope, 3)
    one, rest = split(rest, p - 3)
    two, rest = split(split(rest, 3)[1], q - p - 3)
    three = split(rest, 3)[1]
    prefix, suffix = (two, one) if form == "spm" else (one, two)
    return content(joined(joined(prefix, three), suffix))


def draws(key: object) -> list[int]:
    """Four numbers of 32 bits from the key."""
    digest = hashlib.sha256(b"1:" + (b"" if key is None else str(key).encode())).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Slices of (key, text, ...), with (n, form, prefix_chars, middle_chars, output, text) of each row."""
    for rows, raw, at in tx.slices(batches, "text"):
        buffer = raw.tobytes()
        marked = set()
        for mark in (PREFIX, SUFFIX, MIDDLE):
            i = buffer.find(mark)
            while i >= 0:
                d = bisect_right(at, i) - 1
                if i + 3 <= at[d + 1]:
                    marked.add(d)
                i = buffer.find(mark, i + 1)
        out = []
        for d, (key, rope) in enumerate(zip(rows.column(0).to_pylist(), ropes(buffer, at))):
            n = rope.units if rope else 0
            h1, h2, h3, h4 = draws(key)
            given = buffer[at[d] : at[d + 1]]
            if not n or d in marked or h3 % 100 >= s.cut:
                out.append((n, "plain", None, None, given, given))
                continue
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            form = "spm" if h4 % 100 < s.suffix_first else "psm"
            made, prefix, middle = arranged(rope, low, high, form == "spm")
            out.append((n, form, prefix, middle, content(made), given))
        yield rows, out


def transformed(docs: DataFrame, s: Settings = Settings(), *, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with fim_n, fim_form, fim_prefix_chars, fim_middle_chars and fim_text, the document as a model is to read it."""
    names = ["fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"]
    docs = replaced(docs, names, key, column)
    given = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, out in _rows(batches, s):
            n, form, prefix, middle, text, _ = zip(*out)
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([t.decode() for t in text], pa.string())], ["row", *names])

    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {row}, fim_n long, fim_form string, fim_prefix_chars long, fim_middle_chars long, fim_text string").select("row.*", *names)


def originals(docs: DataFrame, *, column: str = "fim_text", form: str = "fim_form") -> DataFrame:
    """docs with restored_text, the text that column was made from; null where column or form is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in tx.slices(batches, "text"):
            buffer = raw.tobytes()
            given = zip(rows.column(0).is_null().to_pylist(), rows.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist())
            text = [None if null or kind is None else restored(buffer[b:e], kind).decode() for null, kind, b, e in given]
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(text, pa.string())], ["row", "restored_text"])

    docs = replaced(docs, ["restored_text"], column, form)
    given = docs.select(F.col(f"`{column}`").alias("text"), F.col(f"`{form}`").alias("form"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = given.schema["row"].dataType.simpleString()
    return given.mapInArrow(run, f"row {row}, restored_text string").select("row.*", "restored_text")


def digests(docs: DataFrame, s: Settings = Settings(), *, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text restored from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, out in _rows(batches, s):
            n, form, prefix, middle, text, _ = zip(*out)
            made = [hashlib.sha256(t).hexdigest() for t in text]
            back = [m if f == "plain" else hashlib.sha256(restored(t, f)).hexdigest() for t, f, m in zip(text, form, made)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(made), pa.array(back)], names)

    names = [key, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    given = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("text"))
    kind = given.schema[0].dataType.simpleString()
    return given.mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
