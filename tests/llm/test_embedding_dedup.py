"""Near-duplicate vectors against brute force, with odd rows, ties, hot groups and small blocks."""

import numpy as np
import pytest

from trajecta.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep string, kept double"


def made(seed=3, n=400, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(25)] + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.3])
        rows.append([i * 3 + 1, [float(np.float32(x)) for x in v], int(rng.integers(3)), "x", None, 1.0])
    for i in range(90):  # one vector with a third of the rows of its label
        rows.append([5000 + i, rows[7][1], rows[7][2], None, "y", None])
    for i in range(40):  # a large group of near copies
        rows.append([7000 + i, [float(np.float32(x)) for x in np.array(rows[9][1]) * (1 + rng.normal(size=dim) * 0.01)], 1, "x", "y", 0.0])
    big = [float(np.float32(x * 1e36)) for x in rows[9][1]]
    tiny = [float(np.float32(x * 1e-36)) for x in rows[9][1]]
    odd = [
        [8000, None, 1],
        [8001, [], 1],
        [8002, [0.0] * dim, 1],
        [8003, [float("nan")] + [1.0] * (dim - 1), 1],
        [8004, [float("inf")] + [1.0] * (dim - 1), 1],
        [8005, [None] + [1.0] * (dim - 1), 1],
        [8006, rows[9][1], None],
        [8007, rows[9][1][:-1], 1],
        [8008, rows[9][1][:-1], 1],
        [8009, big, 1],
        [8010, tiny, 1],
        [rows[3][0], rows[3][1], rows[3][2]],
        [rows[4][0], rows[5][1], rows[5][2]],
        [None, rows[9][1], 1],
        [None, rows[0][1], 2],
        [None, None, None],
    ]
    return rows + [[*r, "x", "y", 2.0] for r in odd]


def brute(rows, threshold):
    """Links by row, components over rows; named by the least key that is not null."""

    def good(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    unit = {}
    for i, r in enumerate(rows):
        if good(r):
            v = np.array(r[1], np.float64)
            v /= np.abs(v).max()
            unit[i] = v / np.sqrt(v @ v)
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], names.get(find(i)), r[0] == names.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("threshold, block_bytes, tile", [(0.93, 1 << 20, 512), (0.93, 64 * 8 * 12, 7), (0.8, 64 * 8 * 12, 16), (0.99, 1, 64)])
def test_equal_to_brute_force(spark, threshold, block_bytes, tile):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = ed.label(df, ed.Settings(threshold, block_bytes, tile))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    want = brute(rows, threshold)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] for r in want) > 8000 and len({r[2] for r in want}) < len(want) - 150


def test_doubles_other_names_and_unique(spark):
    rows = [(n, [1.0, 1e-200 * n], "a", n) for n in range(4)] + [(9, [0.0, 1.0], "a", 1), (10, [0.0, 2e300], "a", 1)]
    df = spark.createDataFrame(rows, "id int, v array<double>, side string, vec_id int")
    got = ed.label(df, key="id", column="v", group="side")
    assert sorted(tuple(r) for r in got.collect()) == [(n, 3, 0, n == 0) for n in range(4)] + [(9, 1, 9, True), (10, 1, 9, False)]
    left = ed.unique(df, key="id", column="v", group="side")
    assert left.columns == df.columns and sorted(r.id for r in left.collect()) == [0, 9]


def test_empty_and_all_unusable(spark):
    df = spark.createDataFrame([(1, None, 3), (2, [0.0], 3)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in ed.label(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert ed.label(df.where("false")).collect() == []


def test_tiles_stop_early():
    """With vectors in few clusters, most tiles end after the leading coordinates, and bounds lose no pair."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64)) * np.linspace(3, 0.01, 64)
    v = base[rng.integers(6, size=300)] + rng.normal(size=(300, 64)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = ed.steps(64)
    norms = ed.suffix_norms(v, at)
    want = {(i, j) for i, j in zip(*np.nonzero(v @ v.T >= 0.93))}
    got = {(i, j) for i, j in zip(*ed.close(v, v, norms, norms, at, 0.93))}
    assert want <= got and at[0] == 4 and at[-1] == 64
    x, y = v[:1], -v[:50]
    assert not len(ed.close(x, y, norms[:, :1], ed.suffix_norms(y, at), at, 0.93)[0]) or (x @ y.T).max() > 0.9
