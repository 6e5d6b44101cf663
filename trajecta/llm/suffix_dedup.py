"""Exact removal of repeated byte strings with suffix arrays built by external induced sorting.

A byte goes if a string of `size` bytes that covers it also starts earlier: in a document with a smaller key, or earlier in its own.
`trajecta.llm.repeats` finds, without loss, which stretches can hold such strings and shards them; each shard's suffix array and
common-prefix values come from `trajecta.llm.induced_sort`, and runs with common prefixes of `size` and more are the equal strings.

Defined results: null text is empty; texts shorter than `size` lose nothing; see `repeats` for repeated and null keys. Strings are judged on the input.
`remove` keeps other columns but for those with a new name, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import induced_sort, repeats
from trajecta.llm import text as tx
from trajecta.llm.tables import replaced


def later_windows(symbols: np.ndarray, at: np.ndarray, size: int, memory: int = 1 << 22) -> np.ndarray:
    """Places where a string of `size` bytes starts that starts at a smaller place too, within the parts that `at` bounds."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    # Parts end in 1, the whole in 0, bytes are 2 to 257.
    text = np.ones(len(symbols) + len(at), np.int16)
    part = np.repeat(np.arange(len(at) - 1), np.diff(at))
    text[np.arange(len(symbols)) + part] = symbols.astype(np.int16) + 2
    text[-1] = 0
    length = np.zeros(len(text), np.int64)
    length[np.arange(len(symbols)) + part] = at[part + 1] - np.arange(len(symbols))
    out = []
    for place, lcp in induced_sort.suffixes(text, size, memory):
        whole = length[place] >= size
        if not whole.any():
            continue
        new = lcp < size
        new[0] = True
        # A suffix with fewer bytes left stands alone: what it shares ends before `size`.
        begin = np.flatnonzero(new)
        first = np.minimum.reduceat(place, begin)
        first = np.repeat(first, np.diff(np.append(begin, len(place))))
        out.append(place[whole & (place != first)])
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return found - (np.searchsorted(at + np.arange(len(at)), found, "right") - 1)


def unit(size: int) -> repeats.Unit:
    return repeats.Unit(repeats.as_bytes, repeats.as_bytes, repeats.byte_bounds, size, max(1, size // 5))


def remove(docs: DataFrame, *, size: int = 100, key: str = "doc_id", column: str = "text") -> DataFrame:
    """docs with kept (binary: the bytes that stay), n_removed and n_spans."""
    new = ["kept", "n_removed", "n_spans"]
    docs = replaced(docs, [*new, *repeats.OWN], key, column)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in tx.slices(batches, column):
            kept, removed, runs = [], [], []
            for i, stays, n in repeats.keep_masks(rows, at):
                kept.append(raw[at[i] : at[i + 1]][stays].tobytes())
                removed.append(int(len(stays) - stays.sum()))
                runs.append(n)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], [*names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    known = repeats.identified(docs, key, column)
    spans = repeats.removed_spans(known, key, column, unit(size), lambda symbols, at: later_windows(symbols, at, size))
    return repeats.applied(known, spans, names, run, f"{fields}, kept binary, n_removed long, n_spans long")


def digests(docs: DataFrame, *, size: int = 100, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""
    only = docs.select(F.col(key), F.col(column).alias("text"))
    return remove(only, size=size, key=key, column="text").select(key, (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


