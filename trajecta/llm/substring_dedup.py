"""Exact removal of repeated word sequences with prefix-partitioned suffix trees.

A word goes if a window of `size` words that covers it also starts earlier: in a document with a smaller key, or earlier in its own.
`trajecta.llm.repeats` finds, without loss, which stretches can hold such windows and shards them. Within a shard the suffixes are
split by prefixes of variable length, lengthened until a prefix's suffixes fit in `memory` or are alike over `size` words; small prefixes share a group. Each group's subtree
is built by reading a range of words of all its open leaves at once, a range that grows as leaves close; its internal nodes of depth `size` and more are the repeats.

Defined results: null text has no words; texts with fewer than `size` words lose nothing; see `repeats` for repeated and null keys. Windows are judged
on the input. `remove` keeps other columns but for those with a new name, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import repeats
from trajecta.llm import text as tx
from trajecta.llm.tables import numbered, replaced


def prefix_groups(codes: np.ndarray, suffixes: np.ndarray, size: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Groups of at most `memory` suffixes (more only if alike over `size` words), each as suffixes, node numbers and depth: those with
    one node share a prefix of that depth. Suffixes whose prefix is theirs alone have no repeat and are left out."""
    work = [(suffixes, np.zeros(len(suffixes), np.int64), 0)]
    while work:
        at, node, depth = work.pop()
        order = np.lexsort((codes[at + depth], node))
        at, node, word = at[order], node[order], codes[at + depth][order]
        new = np.ones(len(at), bool)
        new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(at)))
        depth += 1
        for a, n in zip(begin[count > memory].tolist(), count[count > memory].tolist()):
            if depth < size:
                work.append((at[a : a + n], np.zeros(n, np.int64), depth))
            else:
                yield at[a : a + n], np.zeros(n, np.int64), depth
        fits = np.repeat((count > 1) & (count <= memory), count)
        rest, number = at[fits], np.cumsum(new)[fits]
        # Whole prefixes are packed one after another until a group is full.
        start = 0
        while start < len(rest):
            end = min(start + memory, len(rest))
            if end < len(rest):
                end = int(np.searchsorted(number, number[end], "left"))
            yield rest[start:end], number[start:end], depth
            start = end


def deep_nodes(codes: np.ndarray, at: np.ndarray, node: np.ndarray, depth: int, size: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and their internal nodes of depth `size`, of the subtree over the suffixes `at` that share nodes at `depth`."""
    while depth < size and len(at):
        reach = int(np.clip(budget // len(at), 1, size - depth))
        words = [codes[at + depth + d] for d in range(reach)]
        order = np.lexsort((*words[::-1], node))
        at, node = at[order], node[order]
        new = np.ones(len(at), bool)
        new[1:] = node[1:] != node[:-1]
        for w in words:
            w = w[order]
            new[1:] |= w[1:] != w[:-1]
        number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        at, node, depth = at[several], number[several], depth + reach
    return at, node


def later_windows(symbols: np.ndarray, at: np.ndarray, size: int, memory: int = 1 << 16) -> np.ndarray:
    """Places where a window of `size` words starts that starts at a smaller place too, within the parts that `at` bounds."""
    out = [np.zeros(0, np.int64)]
    count = np.maximum(np.diff(at) - size + 1, 0)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[:-1], count)
    codes = np.unique(symbols, return_inverse=True)[1]
    for leaves, node, depth in prefix_groups(codes, start, size, memory):
        leaves, node = deep_nodes(codes, leaves, node, depth, size, 4 * memory)
        if len(leaves):
            order = np.lexsort((leaves, node))
            leaves, node = leaves[order], node[order]
            out.append(leaves[1:][node[1:] == node[:-1]])
    return np.concatenate(out)


def unit(size: int) -> repeats.Unit:
    return repeats.Unit(repeats.as_words, repeats.as_word_numbers, repeats.word_bounds, size, max(1, size // 4))


def remove(docs: DataFrame, *, size: int = 20, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with kept (the words that stay, joined by one space), n_words and n_removed."""
    new = ["kept", "n_words", "n_removed"]
    docs = replaced(docs, [*new, *repeats.OWN], key, column)
    names = docs.columns
    known = repeats.identified(docs, key, column)
    spans = repeats.removed_spans(known, key, column, unit(size), lambda symbols, at: later_windows(symbols, at, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in tx.slices(batches, column):
            _, _, words_at = tx.word_bounds(raw, at)
            data = raw.tobytes()
            kept, words, removed = [], [], []
            for i, stays, _ in repeats.keep_masks(rows, words_at):
                found = data[at[i] : at[i + 1]].split()
                kept.append(b" ".join(found if stays.all() else [found[k] for k in np.flatnonzero(stays)]))
                words.append(len(found))
                removed.append(int(len(stays) - stays.sum()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], [*names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return repeats.applied(known, spans, names, run, f"{fields}, kept string, n_words long, n_removed long")


def cleaned(docs: DataFrame, *, size: int = 20, key: str = "doc_id", column: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with the words that stay as their text, and their number of code points in the column `length` if there is one."""
    plain, names = numbered(docs)
    found = remove(plain, size=size, key=names[key], column=names[column])
    new = {column: F.col("kept")}
    if length in names:
        new[length] = F.char_length("kept").cast(docs.schema[length].dataType)
    return found.select(*(new.get(old, F.col(at)).alias(old) for old, at in names.items()))


def digests(docs: DataFrame, *, size: int = 20, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256."""
    only = docs.select(F.col(key), F.col(column).alias("text"))
    return remove(only, size=size, key=key, column="text").select(key, "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
