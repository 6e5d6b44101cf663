import random
from collections import Counter, defaultdict

import pytest

from trajecta.llm import minhash_dedup
from trajecta.llm.minhash_dedup import Settings

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text):
    w = (text or "").encode().translate(FOLD).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = {k: shingle_set(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    having = defaultdict(list)
    for k, s in sets.items():
        shared = Counter(j for x in s for j in having[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(k), root(j)))
                parent[b] = a
        for x in s:
            having[x].append(k)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def check(df, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.label(df, Settings(percent=percent)).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], percent)


@pytest.mark.parametrize("percent", [85, 80])
def test_documents(docs, percent):
    check(docs, percent)


def test_chains_and_stars(spark):
    """Variants of one text whose links go over others, and a hub with many copies."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows, chain = [], list(base)
    for i in range(60):
        if i < 25:
            rows.append((500 - i, " ".join(base)))
        elif i < 40:
            chain[(i * 13) % 150] = f"c{i}"
            rows.append((500 - i, " ".join(chain)))
        else:
            edited = list(base)
            for k in rng.sample(range(150), rng.randint(1, 12)):
                edited[k] = f"e{i}-{k}"
            rows.append((500 - i, " ".join(edited)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 85)


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        edited = list(base)
        for k in rng.sample(range(80), rng.randint(0, 4)):
            edited[k] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(edited)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 85)


def test_keys(spark):
    t, u = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, t), (5, u), (7, u), (None, t), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in minhash_dedup.label(df).collect())
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]


def test_unique_keeps_columns(docs, empty):
    got = minhash_dedup.unique(docs)
    assert got.schema == docs.schema and 0 < got.count() < docs.count()
    assert minhash_dedup.label(empty).count() == 0 and minhash_dedup.unique(empty).count() == 0


def test_pruning_bounds():
    s = Settings()
    assert (1 - (s.percent / 100) ** s.rows) ** s.bands <= s.miss
    steps = s.least_matches()
    assert [n for n, _ in steps] == list(range(25, s.values + 1, 25)) and all(a[1] < b[1] for a, b in zip(steps, steps[1:]))
