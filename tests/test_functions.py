"""Literal cases of vectors, text, images and messages."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajecta.functions import images, metrics, text, vector, wire
from trajecta.plans import queries_vectors


def one(spark, expression, **columns):
    kinds = {k: v[1] for k, v in columns.items()}
    df = spark.createDataFrame([tuple(v[0] for v in columns.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())) if columns else spark.range(1)
    return df.select(expression.alias("y")).first().y


STEPS = "array<array<double>>"
VECTOR = "array<double>"


def test_delta_and_absolute(spark):
    cols = {"state": ([1.0, 2.0, 3.0], VECTOR), "actions": ([[3.0, 4.0, 5.0], [5.0, 6.0, 7.0]], STEPS)}
    mask = [False, True]
    assert one(spark, vector.delta_actions(F.col("actions"), F.col("state"), mask), **cols) == [[3, 2, 5], [5, 4, 7]]
    assert one(spark, vector.absolute_actions(F.col("actions"), F.col("state"), mask), **cols) == [[3, 6, 5], [5, 8, 7]]
    assert one(spark, vector.delta_actions(F.col("actions"), F.col("state"), None), **cols) == cols["actions"][0]
    back = vector.absolute_actions(vector.delta_actions(F.col("actions"), F.col("state"), mask), F.col("state"), mask)
    assert one(spark, back, **cols) == cols["actions"][0]


def test_bool_mask():
    assert vector.bool_mask(2, -2, 2) == [True, True, False, False, True, True]
    assert vector.bool_mask(2, 0, 2) == [True] * 4


def test_scaling(spark):
    x = {"x": ([3.0], VECTOR)}
    assert one(spark, vector.normalize_z(F.col("x"), vector.literal([1]), vector.literal([2])), **x) == [2 / (2 + 1e-6)]
    assert one(spark, vector.normalize_quantile(vector.literal([1]), vector.literal([0]), vector.literal([2]))) == [1 / (2 + 1e-6) * 2 - 1]
    y = {"x": ([1.0, 2.0, 3.0], VECTOR)}
    assert one(spark, vector.unnormalize_z(F.col("x"), vector.literal([0, 0]), vector.literal([1, 1])), **y)[2] == 3.0 * (1 + 1e-6)
    assert one(spark, vector.unnormalize_quantile(F.col("x"), vector.literal([0, 0]), vector.literal([1, 1])), **y)[2] == 3.0


def test_discretize(spark):
    x = {"x": ([-2.0, -1.0, -1e-20, 0.0, 0.999, 1.0, 5.0, math.nan, None, math.inf], VECTOR)}
    assert one(spark, vector.discretize(F.col("x")), **x) == [-1, 0, 127, 128, 255, 255, 255, 255, None, 255]


def test_pad(spark):
    assert one(spark, vector.pad_to(vector.literal([1, 2, 3]), 5)) == [1, 2, 3, 0, 0]
    assert one(spark, vector.pad_to(vector.literal(range(6)), 5)) == [0, 1, 2, 3, 4, 5]


def test_radix(spark):
    bins = (8, 5, 5, 5)
    digits = F.array(*(F.lit(d) for d in (7, 4, 0, 2)))
    assert one(spark, vector.mixed_radix_encode(digits, bins)) == 439
    assert one(spark, vector.mixed_radix_decode(F.lit(439).cast("long"), bins)) == [7, 4, 0, 2]


def test_quaternion_identity(spark):
    assert one(spark, vector.quaternion_to_axis_angle(vector.literal([0, 0, 0, 1]))) == [0, 0, 0]
    half = math.sqrt(0.5)
    assert one(spark, vector.quaternion_to_axis_angle(vector.literal([half, 0, 0, half]))) == pytest.approx([math.pi / 2, 0, 0])


def test_zip_strict(spark):
    with pytest.raises(Exception, match="different length"):
        one(spark, vector.zip_strict(vector.literal([1]), vector.literal([1, 2])))


def test_prompts(spark):
    p = {"p": (" Pick_UP\nCup ", "string")}
    assert one(spark, text.clean_flow(F.col("p")), **p) == "Pick UP Cup"
    assert one(spark, text.clean_fast(F.col("p")), **p) == "pick up\ncup"


def test_token_lengths(spark):
    tokens, mask = text.encode_flow(F.lit("Hello, world!"), 10)
    assert len(one(spark, tokens)) == 10 and len(one(spark, mask)) == 10
    packed = text.pack_fast(text.fast_prefix(F.lit("hi"), F.array(F.lit(1))), F.array(F.lit(5)), 64)
    got = {k: one(spark, v) for k, v in packed.items()}
    assert {len(v) for v in got.values()} == {64}
    assert sum(got["loss_mask"]) == sum(got["ar_mask"]) == len("Action: ") + 1 + 1 + 1


def test_attention_blocks(spark):
    ar = F.array(*(F.lit(v) for v in (0, 0, 0, 1, 1, 1)))
    valid = F.array(*(F.lit(True) for _ in range(6)))
    got = one(spark, text.attention(ar, valid))
    assert [[j <= max(2, i) for j in range(6)] for i in range(6)] == got


def test_decode_without_marker(spark):
    assert one(spark, text.between_markers(F.lit("nothing"))) is None
    assert one(spark, text.decode_bins(F.lit(None).cast("array<int>"), 2, 2)) == [[0, 0], [0, 0]]


@pytest.mark.parametrize("shape, size", [((10, 10), (20, 20)), ((30, 30), (15, 15)), ((50, 50), (50, 50)), ((256, 320), (60, 80))])
def test_resize_zeros(shape, size):
    out = images.with_pad(np.zeros((*shape, 3), np.uint8), *size)
    assert out.shape == (*size, 3) and not out.any()


def test_image_layout(spark):
    x = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert images.channels_last(x.transpose(2, 0, 1)).tolist() == x.tolist()
    assert (images.flipped(images.flipped(x)) == x).all()
    assert images.swapped(x)[0, 0].tolist() == [2, 1, 0]
    df = spark.createDataFrame([((x.tobytes(), 2, 2, 3),), (None,)], f"i {images.IMAGE.replace(': ', ':')}")
    got = [r.y.data if r.y else None for r in df.select(images.kernel(images.flipped)(F.col("i")).alias("y")).collect()]
    assert bytes(got[0]) == images.flipped(x).tobytes() and got[1] is None


VALUES = [1, -5, 300, 70000, -70000, 1 << 40, 1.5, math.inf, True, False, None, "text", "x" * 300, b"raw", [1, [2, "a"]], {"a": {"b": [1.0]}}, {}, []]


@pytest.mark.parametrize("value", VALUES, ids=str)
def test_wire_plain(value):
    assert wire.unpack(wire.pack(value)) == value


@pytest.mark.parametrize("array", [np.arange(6, dtype=np.int32).reshape(2, 3), np.array(3.5), np.zeros((2, 0, 3)), np.array([True, False]), np.array(["ab", "c"]), np.array([math.nan, -math.inf]), np.float32(2.5), np.uint8(7)], ids=str)
def test_wire_arrays(array):
    got = wire.unpack(wire.pack({"x": array}))["x"]
    assert got.dtype == array.dtype and np.shape(got) == np.shape(array)
    np.testing.assert_array_equal(got, array)


def test_wire_rejects():
    with pytest.raises(ValueError):
        wire.pack(np.array([object()]))
    with pytest.raises(ValueError):
        wire.pack(np.array([1j]))


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text() | st.binary(), lambda c: st.lists(c) | st.dictionaries(st.text(), c)))
def test_wire_any(value):
    assert wire.unpack(wire.pack(value)) == value


def test_wire_vectors_at_once(spark):
    """Messages are those of `pack`, whatever the lengths; messages framed otherwise are read too."""
    vectors = [None, [], [1.5, -0.0, math.inf], [2.0] * 31, [0.5] * 40, [1.0] * 9000, [3.0]]
    got = wire.packed(pa.array([[9.0], *vectors], pa.list_(pa.float64())).slice(1)).to_pylist()
    assert got == [None if v is None else wire.pack(np.array(v, np.float64)) for v in vectors]
    others = [np.arange(6, dtype=np.int32).reshape(2, 3), np.array([1.0, 2.0], ">f8"), np.array([[1.0, 2.0]]), np.float32(2.5), 7]
    back = wire.unpacked(pa.array([*got, *map(wire.pack, others)], pa.binary())).to_pylist()
    assert back == [*vectors, [0, 1, 2, 3, 4, 5], [1, 2], [1, 2], [2.5], [7]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")
    assert dict(df.select("i", wire.unpack_vector(wire.pack_vector(F.col("v")))).collect()) == dict(enumerate(vectors))
    assert "ArrowEvalPython" in df.select(wire.pack_vector(F.col("v")))._jdf.queryExecution().toString()


def test_image_stacks(spark):
    """A stack gives what its images give one by one, and the queries deal their rows out before the pixel work."""
    rng = np.random.default_rng(0)
    for h, w, c in ((1, 1, 3), (4, 6, 3), (12, 6, 3), (37, 23, 1), (9, 30, 4)):
        x = rng.integers(0, 256, (5, h, w, c)).astype(np.uint8)
        for wrist in (False, True):
            assert (images.all_augmented(x, range(5), wrist) == [images.augmented(i, s, wrist) for s, i in enumerate(x)]).all()
        for body in (images.with_pad, images.with_pad_even, images.bicubic):
            assert (body(x, 8, 10) == [body(i, 8, 10) for i in x]).all()
    # Of the code before stacks.
    x = (np.arange(7 * 6 * 3).reshape(7, 6, 3) * 37 % 256).astype(np.uint8)
    assert hashlib.sha256(images.augmented(x, int(x.sum())).tobytes()).hexdigest() == "59be7c1ca5cc46d548304ec43e2139460e0644317f2f2965de09b2c5baae73bc"
    shapes = [(2, 3, 3), None, (4, 1, 3), (2, 3, 3), (1, 1, 4)]
    made = [None if s is None else rng.integers(0, 256, s).astype(np.uint8) for s in shapes]
    df = spark.createDataFrame([(i, x is not None and (x.tobytes(), *x.shape) or None) for i, x in enumerate(made)], f"n int, i {images.IMAGE}")
    got = {r.n: r.y for r in df.select("n", images.resize_with_pad(F.col("i"), 5, 5).alias("y")).collect()}
    for i, x in enumerate(made):
        assert got[i].data == (None if x is None else images.with_pad(x, 5, 5).tobytes())
    assert "Repartition" in queries_vectors.image_augment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_schedule_ends(spark):
    assert one(spark, metrics.cosine(F.lit(0))) == pytest.approx(2.5e-5 / 1001)
    assert one(spark, metrics.cosine(F.lit(1000))) == pytest.approx(2.5e-5)
    assert one(spark, metrics.cosine(F.lit(99_999))) == pytest.approx(2.5e-6)
