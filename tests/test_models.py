"""Hosted models and codebooks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.functions import text
from trajecta.operators import codebook
from trajecta.operators.stats import NormStats
from trajecta.plans.host import Host
from trajecta.plans.pipeline import Config, Family, Model
from trajecta.streaming import sessions

STATS = {"state": NormStats([0.0] * 2, [1.0] * 2), "actions": NormStats([0.0] * 2, [1.0] * 2)}
CONFIG = Config("toy", None, Model(Family.FLOW, 2, 3, 8), default_prompt="go")


def test_the_host(spark):
    def load():
        return lambda state, tokens, mask, noise: noise + state[:, None, :] + mask.sum(axis=1)[:, None, None]

    df = spark.createDataFrame([(i, [float(i), 1.0], [[9.0] * 3] * 2) for i in range(10)], "step_id long, state array<double>, actions array<array<double>>")
    host = Host(CONFIG, STATS, load, batch_size=4, metadata={"name": "toy"})
    noise = sessions.noise(F.col("step_id"), F.lit(0), 6)
    got = host.infer(df, noise)
    assert got.columns == ["step_id", "actions", "policy_timing"]
    for r in got.collect():
        z = np.reshape(sessions.noise_values(r.step_id, 0, 6, 0), (2, 3)) + np.array([r.step_id, 1.0, 0.0]) + 4
        assert np.allclose(r.actions, z, atol=1e-4) and r.policy_timing.infer_ms >= 0
    first = host.model()
    host.reset()
    assert host.model() is not first and host.metadata == {"name": "toy"}
    with pytest.raises(Exception, match="no state"):
        host.infer(spark.createDataFrame([(1, None)], "step_id long, state array<double>")).collect()
    with pytest.raises(Exception, match="shape"):
        Host(CONFIG, STATS, lambda: lambda s, t, m, n: n[:, :1]).infer(df).collect()
    with pytest.raises(ValueError, match="tokens"):
        Host(Config("fast", None, Model(Family.FAST, 2, 3, 8)), STATS, load)


def test_tables_of_codebooks():
    assert codebook.bins("fsq", 2**10) == (8, 5, 5, 5) and codebook.bins("custom", 2**8) == (16, 16) and codebook.bins("lfq", 2**5) == (2,) * 5
    assert codebook.declared_size(2**10) == 1000 and codebook.declared_size(2**8) == 240
    grid = codebook.grid((3, 2))
    assert grid.tolist() == [[-1, -1], [0, -1], [1, -1], [-1, 1], [0, 1], [1, 1]]
    for kind, size in (("lfq", 12), ("fsq", 9), ("other", 256)):
        with pytest.raises(ValueError):
            codebook.bins(kind, size)


def test_nearest_codes(spark):
    rng = np.random.default_rng(2)
    codes = np.vstack([rng.normal(size=(40, 5)), np.zeros((2, 5))])
    given = [*rng.normal(size=(300, 5)).tolist(), [0.0] * 5, None, [None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 5]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(given)], "id int, v array<double>, code string").repartition(3)
    got = {r.id: r for r in codebook.nearest(df, "v", codes).collect()}
    for i, v in enumerate(given):
        if v is None or any(x is None or x != x for x in v):
            assert got[i].code is None and got[i].distance is None
        else:
            far = np.linalg.norm(codes - np.array(v), axis=1)
            assert (got[i].code, got[i].distance) == (far.argmin(), pytest.approx(far.min()))
    assert got[300].code == 40
    with pytest.raises(Exception, match="elements"):
        codebook.nearest(spark.createDataFrame([([1.0],)], "v array<double>"), "v", codes).collect()
    for bad in (np.zeros((0, 2)), np.full((2, 2), np.nan), np.zeros(3)):
        with pytest.raises(ValueError):
            codebook.nearest(df, "v", bad)
    with pytest.raises(ValueError, match="too large"):
        codebook.nearest(df, "v", np.zeros((1 << 20, 9)))


def test_vectors_and_actions(spark):
    codes = np.arange(8.0).reshape(4, 2)
    rows = [(0, [0, 3]), (1, []), (2, None), (3, [1, None]), (4, [4]), (5, [-1])]
    got = {r.id: r.vectors for r in codebook.vectors(spark.createDataFrame(rows, "id int, c array<int>"), "c", codes).collect()}
    assert got == {0: [0.0, 1.0, 6.0, 7.0], 1: [], 2: None, 3: None, 4: None, 5: None}
    good = codebook.vectors(spark.createDataFrame(rows[:1], "id int, c array<int>"), "c", codes).first()
    assert good.vectors == [0.0, 1.0, 6.0, 7.0]
    say = lambda codes: [ord(c) + 3 for c in "Action: "] + [1000 - 1 - 128 - c for c in codes] + [ord("|") + 3, 5]
    assert spark.range(1).select(text.characters(F.lit("Action: "))).first()[0] == say([])[:8]
    outputs = [say([1, 3]), say([1, 3, 0]), say([1]), say([1, 9]), say([1, 3])[1:], None, []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(outputs)], "id int, tokens array<int>")
    got = {r.id: r.actions for r in codebook.actions(df, "tokens", codes, 1000, 2, 2).collect()}
    zeros, made = [[0.0, 0.0]] * 2, [[2.0, 3.0], [6.0, 7.0]]
    assert got == {0: made, 1: made, 2: zeros, 3: zeros, 4: zeros, 5: zeros, 6: zeros}
