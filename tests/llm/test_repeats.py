"""Repeat removal against brute force, and the suffix structures on their own."""

import hashlib

import numpy as np
import pytest

from trajecta.llm import induced_sort, repeats, substring_dedup, suffix_dedup


def covered(sequences, size):
    """Flags of the symbols that go, by a plain scan in key order."""
    seen, out = set(), []
    for s in sequences:
        gone = [False] * len(s)
        for t in range(len(s) - size + 1):
            window = tuple(s[t : t + size])
            if window in seen:
                gone[t : t + size] = [True] * size
            seen.add(window)
        out.append(gone)
    return out


def expected_bytes(rows, size):
    rows = sorted(rows)
    data = [(t or "").encode() for _, t in rows]
    for (key, _), b, gone in zip(rows, data, covered(data, size)):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield key, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def expected_words(rows, size):
    rows = sorted(rows)
    data = [(t or "").encode().split() for _, t in rows]
    for (key, _), w, gone in zip(rows, data, covered(data, size)):
        yield key, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()


@pytest.mark.parametrize("size", [100, 30, 7])
def test_bytes(docs, size):
    got = [tuple(r) for r in suffix_dedup.digests(docs, size=size).orderBy("doc_id").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == list(expected_bytes(rows, size))


@pytest.mark.parametrize("size", [20, 8, 2])
def test_words(docs, size):
    got = [tuple(r) for r in substring_dedup.digests(docs, size=size).orderBy("doc_id").collect()]
    assert got == list(expected_words([(r.doc_id, r.text) for r in docs.collect()], size))


def test_columns_and_empty_tables(docs, empty):
    cleaned = substring_dedup.cleaned(docs)
    assert cleaned.schema == docs.schema
    assert all(r.n_removed == "mine" and r.n_chars == len(r.text) for r in cleaned.collect())
    assert suffix_dedup.remove(docs).columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_removed", "n_spans"]
    for f in (substring_dedup.digests, suffix_dedup.digests, substring_dedup.cleaned):
        assert f(empty).count() == 0


def test_repeated_and_null_keys(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_removed) for r in substring_dedup.digests(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 40)]
    assert sorted(((r.doc_id or 0), r.n_removed) for r in suffix_dedup.digests(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(t))]


def test_different_texts_under_one_key(spark):
    """Each row loses only what its own text repeats; the later of the two versions of a key sees the earlier one."""
    t, u, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuv")
    df = spark.createDataFrame([(1, t), (2, f"{t} {u}"), (2, v), (3, f"{v} {u}"), (3, v)], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.digests(df).where("doc_id < 3").collect()}
    assert got == {(1, 60): 0, (2, 120): 60, (2, 60): 0}
    assert {r.n_removed for r in substring_dedup.digests(df).where("doc_id = 3").collect()} == {120, 60}
    data = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.digests(df).where("doc_id < 3").collect()}
    assert data == {(1, len(t)): 0, (2, len(t) + len(u) + 1): len(t), (2, len(v)): 0}


@pytest.mark.parametrize("hot", [2, 5])
def test_hot_anchors_in_two_rounds(spark, monkeypatch, hot):
    """Anchors with more than `hot` places are dealt over several shards first."""
    plain = repeats.removed_spans
    monkeypatch.setattr(repeats, "removed_spans", lambda *a, **k: plain(*a, **k, hot=hot, shard_bytes=4096))
    rng = np.random.default_rng(hot)
    passage, base = [f"p{i}" for i in range(45)], [f"b{i}" for i in range(70)]
    rows = []
    for i in range(60):
        own = [f"w{rng.integers(10**6)}" for _ in range(int(rng.integers(0, 40)))]
        rows.append((i, " ".join(base if i % 3 == 0 else [*own, *passage[: int(rng.integers(15, 45))], *own[::-1]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [tuple(r) for r in substring_dedup.digests(df).orderBy("doc_id").collect()] == list(expected_words(rows, 20))
    assert [tuple(r) for r in suffix_dedup.digests(df).orderBy("doc_id").collect()] == list(expected_bytes(rows, 100))


def test_words_that_collide_modulo_powers_of_two(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{rest} {word}"), (2, f"{rest} {other}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.digests(df).collect()] == [0, 0]


def test_what_the_structures_decide(docs, monkeypatch):
    """Without them only contexts with the bytes of an earlier one go, which is part of what goes with them; hashes decide nothing."""
    for module, digests in ((suffix_dedup, suffix_dedup.digests), (substring_dedup, substring_dedup.digests)):
        with_them = {r.doc_id: r.n_removed for r in digests(docs).collect()}
        monkeypatch.setattr(module, "later_windows", lambda symbols, at, size: np.zeros(0, np.int64))
        without = {r.doc_id: r.n_removed for r in digests(docs).collect()}
        assert all(without[k] <= n for k, n in with_them.items()) and sum(without.values()) < 0.9 * sum(with_them.values())


def test_runs_of_one_symbol(spark):
    df = spark.createDataFrame([(1, "a" * 500), (2, "b" * 99), (3, "a" * 120)], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in suffix_dedup.digests(df).orderBy("doc_id").collect()] == [(500, 499, 1), (99, 0, 0), (120, 120, 1)]


@pytest.mark.parametrize("memory", [3, 20, 1 << 20])
def test_suffix_order(memory):
    rng = np.random.default_rng(memory)
    for trial in range(60):
        t = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 90)))
        if trial % 3 == 0:
            t = np.concatenate([t, t, t[::-1], t])
        text = np.append(t, 0).astype(np.int16)
        blocks = list(induced_sort.suffixes(text, 12, memory))
        order = np.concatenate([a for a, _ in blocks]).tolist()
        s = text.tolist()
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for a, b, lcp in zip(order, order[1:], np.concatenate([c for _, c in blocks]).tolist()[1:]):
            common = 0
            while common < 12 and max(a, b) + common < len(s) and s[a + common] == s[b + common]:
                common += 1
            assert common == lcp


@pytest.mark.parametrize("memory", [4, 64, 1 << 16])
def test_suffix_trees(memory):
    rng = np.random.default_rng(memory)
    for _ in range(40):
        parts = [rng.integers(0, 3, int(rng.integers(0, 30))).astype(np.uint64) for _ in range(5)]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        seen, want = set(), []
        for a, p in zip(at, parts):
            for t in range(len(p) - 4):
                w = tuple(p[t : t + 5].tolist())
                if w in seen:
                    want.append(int(a) + t)
                seen.add(w)
        assert sorted(substring_dedup.later_windows(np.concatenate(parts), at, 5, memory).tolist()) == want


def test_equal_windows_share_anchors():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 400).astype(np.uint8)
    y = np.concatenate([rng.integers(0, 256, 57).astype(np.uint8), x[100:300], rng.integers(0, 256, 31).astype(np.uint8)])
    both, at = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
    doc, h, first, last = repeats.anchors(both, at, 50, 10)
    of = {int(t): int(v) for v, a, b in zip(h, first, last) for t in range(a, b + 1)}
    assert all(of[100 + k] == of[400 + 57 + k] for k in range(151))
