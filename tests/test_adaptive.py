"""Histograms with growing ranges against a version in plain numbers, and against the values themselves."""

import random

import numpy as np
import pytest

from trajecta.operators import adaptive


def grid(low, high, bins):
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def put(edges, v):
    i = sum(e <= v for e in edges) - 1
    return min(max(i, 0), len(edges) - 2)


def fresh(values, bins):
    low, high = min(values), max(values)
    edges, counts = grid(low - 1e-10, high + 1e-10, bins), [0] * bins
    for v in values:
        counts[put(edges, v)] += 1
    return low, high, edges, counts


def joined(a, b, bins):
    low, high = min(a[0], b[0]), max(a[1], b[1])
    edges, counts = grid(low, high, bins), [0] * bins
    for _, _, old, n in (a, b):
        for left, c in zip(old, n):
            counts[put(edges, left)] += c
    return low, high, edges, counts


def tree(states, bins, fan):
    """States by place, `fan` neighbours at a time."""
    while True:
        up = {}
        for place in sorted(states):
            up.setdefault(place // fan, []).append(states[place])
        states = {}
        for place, group in up.items():
            total = group[0]
            for s in group[1:]:
                total = joined(total, s, bins)
            states[place] = total
        if max(states) == 0:
            return states[0]


@pytest.mark.parametrize("bins, fan, batches", [(50, 16, 5), (20, 2, 9), (7, 3, 40)])
def test_equal_to_plain_numbers(spark, tmp_path, bins, fan, batches):
    rng = random.Random(bins)
    rows = [(b, [rng.gauss(0, 1 + b), 5.0, rng.choice([0.25, 0.5])]) for b in range(batches) if b != 3 for _ in range(rng.randint(2, 30))]
    df = spark.createDataFrame([*rows, (0, None), (3, None)], "batch int, v array<double>").repartition(3)
    got = adaptive.statistics(df, "v", f"file://{tmp_path}/states", "batch", (("a", 0.01), ("b", 0.5), ("c", 1.0)), bins, fan).orderBy("dim").collect()
    assert [r.dim for r in got] == [0, 1, 2]
    for d in range(3):
        of = {b: fresh([v[d] for x, v in rows if x == b], bins) for b, _ in rows}
        _, _, edges, counts = tree(of, bins, fan)
        assert sum(counts) == len(rows) == got[d].n
        for name, q in (("a", 0.01), ("b", 0.5), ("c", 1.0)):
            run = np.cumsum(counts)
            assert got[d][name] == pytest.approx(edges[int(np.argmax(run >= q * len(rows)))], abs=1e-12)
        values = np.array([v[d] for _, v in rows])
        assert (got[d]["min"], got[d]["max"]) == (values.min(), values.max())
        assert (got[d]["mean"], got[d]["std"]) == (pytest.approx(values.mean()), pytest.approx(values.std(), abs=1e-6))


def test_near_the_true_quantiles(spark, tmp_path):
    """Without batches: one pass over partitions, nothing shuffled but the states."""
    df = spark.range(40_000).selectExpr("array(cast(id as double), cast(-id * id as double)) AS v").repartition(7)
    got = adaptive.statistics(df, "v", f"file://{tmp_path}/states").orderBy("dim").collect()
    assert [r.n for r in got] == [40_000] * 2
    for d, f in enumerate((lambda x: x, lambda x: -x * x)):
        values = np.sort(f(np.arange(40_000.0)))
        width = (values[-1] - values[0]) / 5000
        for name, q in (("q01", 0.01), ("q99", 0.99)):
            assert abs(got[d][name] - values[int(q * 40_000)]) <= 20 * width
    read = spark.range(9).selectExpr("array(cast(id as double)) AS v")
    assert "Exchange" not in adaptive.states(read, {"v": "v"})._jdf.queryExecution().executedPlan().toString()


def test_states_of_bounded_size_and_round_trip():
    rng = np.random.default_rng(1)
    h = adaptive.Histogram.of(rng.normal(size=(1000, 14)))
    again = adaptive.Histogram.from_bytes(h.to_bytes())
    assert (again.counts == h.counts).all() and again.n == h.n and (again.edges == h.edges).all() and again.padded
    grown = h.merged(adaptive.Histogram.of(rng.normal(size=(1000, 14)) * 3))
    assert grown.counts.shape == h.counts.shape and grown.counts.sum() == 14 * 2000 and not grown.padded and len(grown.to_bytes()) < 14 * 5000 * 8
    same = h.merged(again)
    assert (same.counts == 2 * h.counts).all() and same.padded


def test_errors_and_empty(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "b int, v array<double>")
    for i, (rows, text) in enumerate([([(0, [1.0]), (0, [1.0, 2.0])], "lengths"), ([(0, [1.0]), (1, [1.0, 2.0])], "lengths"), ([(0, [1.0])], "two vectors"), ([(0, [float("nan")]), (0, [1.0])], "not finite"), ([(0, [None]), (0, [1.0])], "not finite"), ([(-1, [1.0])], "from 0")]):
        with pytest.raises(Exception, match=text):
            adaptive.statistics(make(rows), "v", f"file://{tmp_path}/e{i}", "b").collect()
    assert adaptive.statistics(make([(0, None)]), "v", f"file://{tmp_path}/none", "b").collect() == []
    assert adaptive.statistics(make([]), "v", f"file://{tmp_path}/empty").collect() == []
