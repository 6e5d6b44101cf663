"""Structure repair of conversations at least cost, by dynamic programming that shared beginnings share.

The rows of a conversation, by turn, are reduced to a signature: one symbol a row for the first letter of its role and its first fault. Equal signatures
have equal edits, so only the distinct ones are solved. They are sorted and put into a prefix trie in that order: of the trie only the path to
the last signature is alive, a new signature adds the layers below the prefix that it shares with it, and an answer is read at
its end. A layer holds, for each of four states of the role pattern, the least cost of getting there and the rank of its edits among the states':
no two equal-cost ways into a state are prefixes of one another (which edit leads where is determined, and the last edit takes a row), so ranks alone settle
ties by the ASCII order of the whole string. Layers less their least cost, and without states too dear to matter, are few: each step between two of them is worked out once.

The edits then go back to the rows. Both passes over rows stream a conversation in order through one task and hold one batch and one signature, never its rows:
the hash of the repaired conversation is sequential by its definition. The text is shuffled once, for the second pass; the first needs a digest of it.

Defined results: null roles and texts are one space; null keys are a conversation of their own; rows of equal turn are ordered by role, the text's first 64 characters
and its digest, nulls of turn first. An empty role has no letter, and like any other letter than s, u and a it cannot be kept. Conversations without rows (all
dropped) give zeros, no edits, and the hash of the empty string. Repeated rows are duplicates. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajecta.llm import tables
from trajecta.llm.tables import stored

SPACES = " \t\n\x0b\x0c\r"
# Fixed values of the task: costs, and the pattern (s?(ua)+)? as states start, s, u, a with where each letter leads.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
# What one state can do, any other can with a system row deleted and a user and an assistant inserted: a state dearer by more than this is never on a cheapest way.
DOMINATED = 2 * INSERT + DELETE
NAMES = {"u": "user", "a": "assistant"}

ORDER = ("turn", "role", "head", "digest", "copy")
Layer = tuple[tuple[int, int] | None, ...]
START: Layer = ((0, 0), None, None, None)


def _other(state: int) -> tuple[str, int]:
    """The letter that user or assistant has to have in this state, and where it leads."""
    letter = "a" if state == 2 else "u"
    return letter, NEXT[state][letter]


class Trie:
    """Signatures in sorted order to (cost, edits). `layers` counts those made: one for each node of the trie."""

    def __init__(self):
        self.last, self.path, self.layers = "", [(START, 0, None)], 0
        self._steps: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}

    @staticmethod
    def _closed(layer: Layer) -> list[list[tuple[int, int, str, int]]]:
        """For each state the ways (cost, rank, edits, state before) into it with up to two insertions."""
        out = [[] for _ in layer]
        for state, entry in enumerate(layer):
            if entry is not None:
                cost, rank = entry
                at, edits = state, ""
                for _ in range(3):
                    out[at].append((cost, rank, edits, state))
                    at, edits, cost = _other(at)[1], edits + "I", cost + INSERT
        return out

    def _step(self, layer: Layer, symbol: str) -> tuple[Layer, int, tuple]:
        """The next layer less its least cost, that cost, and for each state the state before and the edits in between."""
        key = layer, symbol
        if key not in self._steps:
            ways = [[] for _ in layer]
            more, letter = TRUNCATED * symbol.isupper(), symbol.lower()
            for state, into in enumerate(self._closed(layer)):
                for cost, rank, edits, before in into:
                    ways[state].append((cost + DELETE, rank, edits + "D", before))
                    if letter != "d":
                        if letter in NEXT[state]:
                            ways[NEXT[state][letter]].append((cost + more, rank, edits + "K", before))
                        ways[_other(state)[1]].append((cost + REROLE + more, rank, edits + "R", before))
            best = [min(w) if w else None for w in ways]
            least = min(b[0] for b in best if b)
            best = [b if b and b[0] <= least + DOMINATED else None for b in best]
            ranks = {s: r for r, s in enumerate(sorted((s for s, b in enumerate(best) if b), key=lambda s: best[s][1:3]))}
            self._steps[key] = tuple((b[0] - least, ranks[s]) if b else None for s, b in enumerate(best)), least, tuple((b[3], b[2]) if b else None for b in best)
        return self._steps[key]

    def insert(self, signature: str) -> tuple[int, str]:
        shared = len(commonprefix([self.last, signature]))
        del self.path[shared + 1 :]
        for symbol in signature[shared:]:
            layer, cost, _ = self.path[-1]
            layer, more, back = self._step(layer, symbol)
            self.path.append((layer, cost + more, back))
            self.layers += 1
        self.last = signature
        closed = self._closed(self.path[-1][0])
        cost, _, edits, state = min(w for s in ACCEPTED for w in closed[s])
        parts = [edits]
        for _, _, back in reversed(self.path[1:]):
            state, edits = back[state]
            parts.append(edits)
        return cost + self.path[-1][1], "".join(reversed(parts))


def plain(conversations: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """conv, turn, role, text, copy and gone (false) of given rows."""
    given = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(f"`{key}`").alias("conv"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def damaged(conversations: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """The same after damage by a hash of key and turn: a row is dropped (gone), emptied, loses its sentence ends, is repeated, or becomes the user's."""
    rows = plain(conversations, key=key)
    name = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("kind", F.pmod(F.crc32(name.cast("binary")), F.lit(20)))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (F.col("kind") == 0).alias("gone"))


def _keyed(rows: DataFrame) -> DataFrame:
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumns({"head": F.left("text", F.lit(64)), "digest": digest})


def _ends(column: pa.Array, last: object, some: bool) -> np.ndarray:
    """Rows at which a conversation begins; `last` is the key before the batch, if there is one."""
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.append(True, code[1:] != code[:-1])
    new[0] = not some or column[0].as_py() != last
    return np.flatnonzero(new)


def signatures(rows: DataFrame) -> DataFrame:
    """conv, signature, gaps, blank, duplicate, truncated, illegal of every conversation of rows (conv, turn, role, text, copy, gone)."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    letter: Column = F.left("role", F.lit(1))
    there = _keyed(rows).select("conv", *ORDER, "gone", F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("letter"), last.alias("last")).repartition("conv")
    earlier = F.row_number().over(Window.partitionBy("conv", "gone", "digest").orderBy("turn", "copy")) > 1
    fault = F.when(F.col("last") == "", 1).when(earlier, 2).when(F.col("last").isin(".", "!", "?"), 0).otherwise(3)
    there = there.withColumn("fault", fault.cast("byte")).sortWithinPartitions("conv", "gone", *ORDER)
    there = there.select("conv", "turn", "letter", "fault", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None

        def close() -> None:
            if now is not None:
                gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
                done.append((now["conv"], b"".join(now["parts"]).decode(), gaps, *now["faults"].tolist(), now["illegal"]))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema.field(0).type), *(pa.array(c) for c in columns[1:])], schema=pa.schema([schema.field(0), *FACTS]))

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            turn, known = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            letter = np.frombuffer("".join(batch.column(2).to_pylist()).encode(), np.uint8)
            fault, gone = batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            symbol = np.where((fault == 1) | (fault == 2), ord("d"), np.where(fault == 3, letter - 32, letter)).astype(np.uint8)
            begin = _ends(batch.column(0), now and now["conv"], now is not None)
            for b, e in zip([0, *begin.tolist()] if not len(begin) or begin[0] else begin.tolist(), [*begin[begin > 0].tolist(), batch.num_rows]):
                if len(begin) and b in begin:
                    close()
                    now = {"conv": batch.column(0)[b].as_py(), "parts": [], "turns": 0, "low": None, "high": None, "faults": np.zeros(3, np.int64), "illegal": 0, "before": ""}
                e -= int(gone[b:e].sum())  # dropped rows are sorted to a conversation's end
                if e == b:
                    continue
                now["parts"].append(symbol[b:e].tobytes())
                now["faults"] += np.bincount(fault[b:e], minlength=4)[1:]
                pairs = now["before"] + letter[b:e].tobytes().decode()
                now["illegal"] += sum(pairs[i : i + 2] not in ("su", "ua", "au") for i in range(len(pairs) - 1))
                now["before"] = pairs[-1]
                turns = turn[b:e][known[b:e]]
                if len(turns):
                    now["turns"] += 1 + int((turns[1:] != turns[:-1]).sum()) - (now["high"] is not None and now["high"] == int(turns[0]))
                    now["low"], now["high"] = int(turns[0]) if now["low"] is None else now["low"], int(turns[-1])
            if len(done) >= 4096:
                yield batch_of()
        close()
        if done:
            yield batch_of()

    kind = there.schema["conv"].dataType
    return there.mapInArrow(run, T.StructType([T.StructField("conv", kind), T.StructField("signature", T.StringType()), *(T.StructField(n, T.LongType()) for n in COUNTS)]))


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
FACTS = [pa.field("signature", pa.string()), *(pa.field(n, pa.int64()) for n in COUNTS)]


def solved(found: DataFrame) -> DataFrame:
    """signature, cost, audit of all distinct signatures; each task has a range of them, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            given = batch.column(0).to_pylist()
            answers = [trie.insert(s) for s in given]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a[0] for a in answers], pa.int64()), pa.array([a[1] for a in answers], pa.string())], ["signature", "cost", "audit"])

    distinct = found.select("signature").distinct()
    return distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def audits(rows: DataFrame) -> DataFrame:
    """conv, the counts, cost and audit (the initials of the cheapest edits) of every conversation."""
    found = stored(signatures(rows), "signatures")
    answers = stored(solved(found), "audits")
    return stored(found.join(answers, "signature").select("conv", *COUNTS, "cost", "audit"), "audited")


def _edited(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of each conversation in order behind a first row that holds its audit and facts."""
    facts = facts.select("conv", F.lit(0).alias("kind"), F.struct(*COUNTS, "cost", "audit").alias("facts"))
    rows = _keyed(rows.where("NOT gone")).withColumn("kind", F.lit(1))
    both = facts.unionByName(rows.drop("gone"), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "kind", *ORDER).select("conv", "kind", "facts", "turn", "role", "text")


class Edits:
    """The audit of one conversation, followed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[str]:
        """Roles of the empty rows that come next."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            letter, self.state = _other(self.state)
            self.at += 1
            yield NAMES[letter]

    def role(self, given: str) -> str | None:
        """The role that the next row gets; None if it is deleted."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        letter = given[0] if edit == "K" else _other(self.state)[0]
        self.state = NEXT[self.state][letter]
        return given if edit == "K" else NAMES[letter]


def report(rows: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of plain() or damaged() rows."""
    edited = _edited(rows, audits(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = facts = edits = sha = None
        empty, done, schema = True, [], None

        def add(role: str, text: str) -> None:
            nonlocal empty
            sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False

        def close() -> None:
            if edits is not None:
                for role in edits.inserted():
                    add(role, "")
                done.append((conv, *(facts[c] for c in (*COUNTS, "cost", "audit")), sha.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], schema.field(0).type), *(pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(columns[1:]))], names)

        for batch in batches:
            schema = batch.schema
            for c, kind, f, _, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if not kind:
                    close()
                    conv, facts, edits, sha, empty = c, f, Edits(f["audit"]), hashlib.sha256(), True
                    continue
                for new in edits.inserted():
                    add(new, "")
                new = edits.role(role)
                if new is not None:
                    add(new, text)
            if len(done) >= 4096:
                yield batch_of()
        close()
        if done:
            yield batch_of()

    names = ["conv", *COUNTS, "cost", "audit", "repaired_sha256"]
    fields = [T.StructField("conv", edited.schema["conv"].dataType), *(T.StructField(n, T.LongType()) for n in names[1:7]), *(T.StructField(n, T.StringType()) for n in names[7:])]
    return edited.mapInArrow(run, T.StructType(fields)).withColumnRenamed("conv", key)


def repaired(rows: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """key, place (from 0), turn, role, text, edit (K, R or I) of all rows of the repaired conversations; an inserted row has no turn and an empty text."""
    edited = _edited(rows, audits(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = edits = None
        place, out, schema = 0, [], None

        def add(turn: int | None, role: str, text: str, edit: str) -> None:
            nonlocal place
            out.append((conv, place, turn, role, text, edit))
            place += 1

        def close() -> None:
            if edits is not None:
                for new in edits.inserted():
                    add(None, new, "", "I")

        def batch_of() -> pa.RecordBatch:
            c = list(zip(*out)) or [[]] * 6
            kinds = (schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names)

        for batch in batches:
            schema = batch.schema
            for c, kind, f, turn, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if not kind:
                    close()
                    conv, edits, place = c, Edits(f["audit"]), 0
                    continue
                for new in edits.inserted():
                    add(None, new, "", "I")
                edit = edits.audit[edits.at]
                new = edits.role(role)
                if new is not None:
                    add(turn, new, text, edit)
            yield batch_of()
        close()
        if schema is not None and out:
            yield batch_of()

    names = ["conv", "place", "turn", "role", "text", "edit"]
    fields = [T.StructField("conv", edited.schema["conv"].dataType), T.StructField("place", T.LongType()), T.StructField("turn", T.LongType()), *(T.StructField(n, T.StringType()) for n in names[3:])]
    return edited.mapInArrow(run, T.StructType(fields)).withColumnRenamed("conv", key)
