"""Conversation repair against a plain version with whole strings, and against all edit strings for short signatures."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from trajecta.llm import conversation_repair as cr

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) by trying, from the end, all edits in all states; rows are (role, text, fault)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        for _ in range(3):  # insertions chain at one place
            for state in ("", "s", "u", "a"):
                ways = [(0, "", [])] if i == len(rows) and state in ("", "a") else []
                for role in ("user", "assistant"):
                    to = step.get((state, role[0]))
                    if to and (i, to) in best:
                        c, e, r = best[i, to]
                        ways.append((c + 3, "I" + e, [(role, ""), *r]))
                if i < len(rows):
                    role, text, fault = rows[i]
                    if (i + 1, state) in best:
                        c, e, r = best[i + 1, state]
                        ways.append((c + 4, "D" + e, r))
                    if fault not in ("blank", "duplicate"):
                        more = 3 * (fault == "truncated")
                        for new, cost, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                            to = step.get((state, new[:1]))
                            if to and (i + 1, to) in best:
                                c, e, r = best[i + 1, to]
                                ways.append((c + cost + more, edit + e, [(new, text), *r]))
                if ways:
                    best[i, state] = min(ways, key=lambda w: w[:2])
    return best[0, ""]


def expected(conversations):
    """Rows of the contract's table from (conv, turn, role, text)."""
    by = {}
    for conv, turn, role, text in conversations:
        rows = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in by.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], digest(r)))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, *_ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, repaired = cheapest([(r[1], r[2], f) for r, f in zip(rows, faults)])
        assert PATTERN.fullmatch("".join(r[0][0] for r in repaired))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


def conversations(seed=4):
    rng = random.Random(seed)
    texts = ["Hi.", "Well?", "no end", "", " \n\t", "Yes!", "One. Two", "é。", "long " * 40 + ".", "long " * 40 + "?", None, "...", " ", "ends.\x0b\x0c "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "u"]
    rows = []
    for c in range(260):
        n = rng.choice([1, 2, 3, 5, 8, 8, 13])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2] if rng.random() < 0.75 else rng.choice(roles)
            rows.append((None if c == 9 else c, None if rng.random() < 0.05 else t + (t > 4) * rng.randint(0, 2), role, rng.choice(texts)))
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)]  # one conversation much longer than the others
    for c in range(2000, 2060):  # copies of one conversation
        rows += [(c, t, ("user", "assistant")[t % 2], f"Same {t}.") for t in range(6)]
    drop = next(t for t in range(99) if zlib.crc32(f"5000:{t}".encode()) % 20 == 0)
    return [*rows, (5000, drop, "user", "gone."), rows[3], rows[3], (5001, None, None, None)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equal_to_the_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", kind string, cost int").repartition(4)
    got = cr.report(cr.damaged(df))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found, want = sorted((tuple(r) for r in got.collect()), key=str), expected(rows)
    assert [f for f, w in zip(found, want) if f != w] == [] and len(found) == len(want)
    assert (5000, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found


def test_small_arrow_batches(spark):
    """A conversation that goes on over many batches."""
    rows = conversations(8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = cr.report(cr.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_repaired_rows_and_text_keys(spark):
    rows = [(str(c), t, r, x) for c, t, r, x in conversations(5)]
    df = spark.createDataFrame(rows, "name string, turn long, role string, text string")
    damaged = cr.damaged(df, key="name")
    got = cr.repaired(damaged, key="name")
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.name, r.place)):
        assert r.place == len(by.setdefault(r.name, [])) and (r.turn is None and r.text == "" if r.edit == "I" else r.edit in "KR")
        by[r.name].append(f"{r.role}:{r.text}")
    for r in cr.report(damaged, key="name").collect():
        assert hashlib.sha256("\n".join(by.get(r.name, [])).encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cr.report(cr.damaged(df)).collect() == [] and cr.repaired(cr.plain(df)).collect() == []


LETTERS = {"d": ("", "blank"), **{x: (x, "") for x in "suax"}, **{x.upper(): (x, "truncated") for x in "suax"}}


def test_trie_makes_each_layer_once():
    every = sorted("".join(s) for n in range(4) for s in itertools.product(LETTERS, repeat=n))
    trie = cr.Trie()
    answers = {s: trie.insert(s) for s in every}
    assert trie.layers == len(every) - 1
    for s, (cost, audit) in answers.items():
        want = cheapest([(LETTERS[x][0], "", LETTERS[x][1]) for x in s])
        assert (cost, audit) == want[:2], s


def test_long_signatures():
    rng = random.Random(6)
    base = ["".join(rng.choices("suaxSUAXd", [2, 5, 5, 1, 1, 2, 2, 1, 1], k=rng.randint(20, 90))) for _ in range(120)]
    base += [b[: rng.randint(1, len(b))] + rng.choice("uad") for b in base]
    trie, total = cr.Trie(), 0
    for s in sorted(base):
        total += len(s)
        assert trie.insert(s) == cheapest([(LETTERS[x][0], "", LETTERS[x][1]) for x in s])[:2]
    assert trie.layers < total and len(trie._steps) < 2000
    assert trie.insert("") == (0, "")
    big = cr.Trie()
    cost, audit = big.insert("ua" * 100_000)
    assert (cost, audit) == (0, "K" * 200_000)


@pytest.mark.parametrize("signature", ["", "d", "a", "xa", "Ua", "uu", "sas", "Aud"])
def test_all_edit_strings(signature):
    """Against every string of edits up to two insertions at each place."""
    step, found = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}, []
    for edits in itertools.product(*([("", "I", "II")] + [tuple(e + i for e in "DKR" for i in ("", "I", "II"))] * len(signature))):
        audit, state, cost, i, fits = "".join(edits), "", 0, 0, True
        for e in audit:
            letter, fault = ("", "") if e == "I" else LETTERS[signature[i]]
            i += e != "I"
            if e == "D":
                cost += 4
                continue
            if fault == "blank":
                fits = False
                break
            new = letter if e == "K" else "a" if state == "u" else "u"
            cost += 3 * (e != "K") + 3 * (fault == "truncated")
            state = step.get((state, new))
            if state is None:
                fits = False
                break
        if fits and state in ("", "a"):
            found.append((cost, audit))
    assert cr.Trie().insert(signature) == min(found)


def test_rows_are_streamed(spark):
    """No aggregate collects a conversation: its rows go through sorts and Arrow batches alone."""
    df = cr.signatures(cr.plain(spark.createDataFrame([(1, 1, "user", "x.")], SCHEMA)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and plan.count("Exchange hashpartitioning") == 1
