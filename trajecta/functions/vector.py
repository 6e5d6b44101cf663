"""Vector algebra on array columns. Every function takes and returns Columns; null elements and null arrays give null.

Expressions are built-in array functions, so they stay in the JVM. Numbers of dimensions and masks are plan-time Python values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def indexed(x: Column, body: Callable[[Column, Column], Column]) -> Column:
    return F.transform(x, body)


def literal(values: Sequence[float]) -> Column:
    """A constant double vector."""
    return F.array(*(F.lit(float(v)) for v in values))


def bool_mask(*runs: int) -> list[bool]:
    """Signed run lengths to flags: n > 0 gives n trues, n < 0 gives -n falses, 0 nothing."""
    return [r > 0 for r in runs for _ in range(abs(r))]


def pad_to(x: Column, size: int, value: float = 0.0) -> Column:
    """At least `size` elements, filled with `value` at the end; longer vectors are unchanged."""
    return F.concat(x, F.array_repeat(F.lit(float(value)), F.greatest(F.lit(size) - F.size(x), F.lit(0))))


def head(x: Column, n: int) -> Column:
    """The first n elements."""
    return F.slice(x, 1, n)


def stride(x: Column, step: int) -> Column:
    """Every step-th element, from the first."""
    return F.filter(x, lambda _, i: i % step == 0)


def normalize_z(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + 1e-6) by element; longer statistics are cut."""
    return indexed(x, lambda v, i: (v - F.get(mean, i)) / (F.get(std, i) + EPSILON))


def normalize_quantile(x: Column, low: Column, high: Column) -> Column:
    """Scaled so that low is -1 and high nearly 1."""
    return indexed(x, lambda v, i: (v - F.get(low, i)) / (F.get(high, i) - F.get(low, i) + EPSILON) * 2.0 - 1.0)


def unnormalize_z(x: Column, mean: Column, std: Column) -> Column:
    """Inverse of normalize_z; elements beyond the statistics have mean 0 and std 1."""
    return indexed(x, lambda v, i: v * (F.coalesce(F.get(std, i), F.lit(1.0)) + EPSILON) + F.coalesce(F.get(mean, i), F.lit(0.0)))


def unnormalize_quantile(x: Column, low: Column, high: Column) -> Column:
    """Inverse of normalize_quantile; elements beyond the statistics are unchanged."""
    return indexed(x, lambda v, i: F.when(i < F.size(low), (v + 1.0) / 2.0 * (F.get(high, i) - F.get(low, i) + EPSILON) + F.get(low, i)).otherwise(v))


def _shifted(actions: Column, state: Column, mask: Sequence[bool] | None, sign: int) -> Column:
    if mask is None:
        return actions
    flags = F.array(*(F.lit(bool(m)) for m in mask))
    return F.transform(actions, lambda step: indexed(step, lambda v, i: F.when(F.coalesce(F.get(flags, i), F.lit(False)), v + sign * F.get(state, i)).otherwise(v)))


def delta_actions(actions: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    """Actions [step][dim] less the state where the mask is true; dimensions beyond it are unchanged. No mask: unchanged."""
    return _shifted(actions, state, mask, -1)


def absolute_actions(actions: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    """Inverse of delta_actions."""
    return _shifted(actions, state, mask, 1)


def discretize(x: Column, bins: int = 256) -> Column:
    """Bin of each element among equal bins of [-1, 1] by their left edges: -1 below, bins - 1 above and for NaN, null for null."""
    half = bins // 2
    return F.transform(x, lambda v: F.when(v.isNull(), F.lit(None).cast("int")).when(F.isnan(v), bins - 1).otherwise(F.greatest(F.lit(-1), F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), v)) * half) + half))).cast("int"))


def clip(v: Column, low: float, high: float) -> Column:
    """v within bounds; null stays null."""
    return F.when(v.isNull(), None).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), v)))


def rescale(v: Column, low: float, high: float) -> Column:
    """low..high to 0..1."""
    return (v - low) / (high - low)


def unrescale(v: Column, low: float, high: float) -> Column:
    """0..1 to low..high."""
    return v * (high - low) + low


# Finger positions in metres and joint angles in radians of follower and leader grippers, linkage lengths, and the
# normalised range of encoder angles.
GRIPPER_RANGE = {"unit": (0.0, 1.0), "follower": (0.01844, 0.05800), "follower_joint": (-0.6213, 1.4910), "leader": (0.01244, 0.02417), "leader_joint": (-0.6842, 0.3083)}
ARM_LENGTH, HORN_RADIUS = 0.036, 0.022
ANGLE_RANGE = (0.5476, 1.6296)


def gripper_to_angular(v: Column) -> Column:
    """Normalised finger opening to normalised angle, by the law of cosines in the linkage."""
    metres = unrescale(v, *GRIPPER_RANGE["follower"])
    sine = (metres * metres + (HORN_RADIUS**2 - ARM_LENGTH**2)) / (metres * (2 * HORN_RADIUS))
    return rescale(F.asin(clip(sine, -1.0, 1.0)), *ANGLE_RANGE)


def gripper_from_angular(v: Column) -> Column:
    """Angle above the range's start to the robot's normalised joint; model outputs are in radians already."""
    return rescale(v + ANGLE_RANGE[0], *GRIPPER_RANGE["follower_joint"])


def gripper_from_angular_inverse(v: Column) -> Column:
    return unrescale(v, *GRIPPER_RANGE["follower_joint"]) - ANGLE_RANGE[0]


def gripper_convert(v: Column, source: str, target: str) -> Column:
    """Affine conversion between any two scales of GRIPPER_RANGE."""
    return unrescale(rescale(v, *GRIPPER_RANGE[source]), *GRIPPER_RANGE[target])


def gripper_velocity(v: Column, source: str) -> Column:
    """A velocity of fingers on the unit scale."""
    low, high = GRIPPER_RANGE[source]
    return v / (high - low)


# Joint signs between the two conventions, arm by arm.
JOINT_SIGNS = [1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1]


def flip_joints(x: Column) -> Column:
    """The two-arm vector with the joint signs of the other convention."""
    return F.zip_with(x, literal(JOINT_SIGNS), lambda a, b: a * b)


def at_grippers(x: Column, body: Callable[[Column], Column], places: Sequence[int] = (6, 13)) -> Column:
    """body on the gripper dimensions, others unchanged."""
    return indexed(x, lambda v, i: F.when(i.isin(*places), body(v)).otherwise(v))


def decode_state(x: Column, adapt: bool = True) -> Column:
    return at_grippers(flip_joints(x), gripper_to_angular) if adapt else x


def encode_actions(x: Column, adapt: bool = True) -> Column:
    return at_grippers(flip_joints(x), gripper_from_angular) if adapt else x


def encode_actions_inverse(x: Column, adapt: bool = True) -> Column:
    return at_grippers(flip_joints(x), gripper_from_angular_inverse) if adapt else x


def _arms(left: Column, right: Column, gripper: Callable[[Column], Column], place: int) -> Column:
    return F.concat(*(part for arm in (left, right) for part in (F.slice(arm, 1, 6), F.array(gripper(F.get(arm, F.lit(place)))))))


def two_arm_position(left: Column, right: Column) -> Column:
    """14 dimensions of the two followers' raw positions: six joints and the fingers (element 7) on the unit scale, arm by arm."""
    return _arms(left, right, lambda v: gripper_convert(v, "follower", "unit"), 7)


def two_arm_velocity(left: Column, right: Column) -> Column:
    """The same of raw velocities."""
    return _arms(left, right, lambda v: gripper_velocity(v, "follower"), 7)


def two_arm_effort(left: Column, right: Column) -> Column:
    """The first seven efforts of each arm."""
    return F.concat(F.slice(left, 1, 7), F.slice(right, 1, 7))


def two_arm_action(left: Column, right: Column) -> Column:
    """14 dimensions of the two leaders' joints, the gripper from its joint (element 6)."""
    return _arms(left, right, lambda v: gripper_convert(v, "leader_joint", "unit"), 6)


def quaternion_to_axis_angle(x: Column) -> Column:
    """[x, y, z, w] to a rotation vector; zero where the angle is (nearly) zero."""
    w = clip(F.get(x, 3), -1.0, 1.0)
    size = F.sqrt(1.0 - w * w)
    return F.transform(F.slice(x, 1, 3), lambda v: F.when(size < 1e-8, 0.0).otherwise(v * 2.0 * F.acos(w) / size))


def binarize_last(x: Column) -> Column:
    """The last element to 1 above 0.5, else 0; then all elements within [-1, 1]."""
    return indexed(x, lambda v, i: clip(F.when(i == F.size(x) - 1, F.when(v > 0.5, 1.0).otherwise(0.0)).otherwise(v), -1.0, 1.0))


# Quantiser bins by target codebook size.
FSQ_BINS = {"fsq": {2**8: (8, 6, 5), 2**10: (8, 5, 5, 5), 2**12: (7, 5, 5, 5, 5), 2**14: (8, 8, 8, 6, 5), 2**16: (8, 8, 8, 5, 5, 5)}, "custom": {2**8: (16, 16), 2**10: (32, 32), 2**12: (64, 64), 2**14: (128, 128), 2**16: (256, 256)}}


def place_values(bins: Sequence[int]) -> list[int]:
    return [math.prod(bins[:i]) for i in range(len(bins))]


def mixed_radix_encode(digits: Column, bins: Sequence[int]) -> Column:
    """Sum of digits times place values, the first digit the smallest."""
    places = F.array(*(F.lit(p).cast("long") for p in place_values(bins)))
    return F.aggregate(F.zip_with(digits, places, lambda d, p: d.cast("long") * p), F.lit(0).cast("long"), lambda a, b: a + b)


def mixed_radix_decode(code: Column, bins: Sequence[int]) -> Column:
    return F.array(*((F.floor(code / F.lit(p)) % F.lit(b)).cast("int") for p, b in zip(place_values(bins), bins)))


def fsq_quantize(v: Column, bins: int) -> Column:
    """tanh to one of `bins` levels, half to even."""
    return F.rint((F.tanh(v) + 1.0) * (bins - 1) / 2.0).cast("int")


def fsq_dequantize(d: Column, bins: int) -> Column:
    return d.cast("double") / (bins - 1) * 2.0 - 1.0


def sign_bits_encode(x: Column) -> Column:
    """Lookup-free quantiser: bit i is set where element i is nearer to 1 than to -1 (ties are not)."""
    bits = indexed(x, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda a, b: a + b)


def sign_bits_decode(code: Column, n: int) -> Column:
    return F.array(*(F.when(code.bitwiseAND(F.lit(1 << i)) != 0, 1.0).otherwise(-1.0) for i in range(n)))


def lerp(a: Column, b: Column, steps: int) -> Column:
    """`steps` vectors from a to b, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.zip_with(a, b, lambda x, y: x + (y - x) * k / F.lit(float(max(steps - 1, 1)))))


def sincos_embedding(v: Column, size: int, shortest: float, longest: float) -> Column:
    """size/2 sines, then size/2 cosines, with periods in geometric progression."""
    half = size // 2
    periods = [shortest * (longest / shortest) ** (k / (half - 1) if half > 1 else 0.0) for k in range(half)]
    return F.array(*(f(v * F.lit(2 * math.pi / p)) for f in (F.sin, F.cos) for p in periods))


def sincos_embedding_2d(y: Column, x: Column, size: int, longest: float = 10_000.0) -> Column:
    """Sines and cosines of x, then of y, at size / 4 geometric periods from 1 to `longest`; size is a multiple of 4, 8 at least."""
    if size % 4 or size < 8:
        raise ValueError("the size is a multiple of 4, and 8 at least")
    rates = [longest ** -(i / (size // 4 - 1)) for i in range(size // 4)]
    return F.array(*(f(v * F.lit(r)) for v in (x, y) for f in (F.sin, F.cos) for r in rates))


def flow_mix(actions: Column, noise: Column, t: Column) -> tuple[Column, Column]:
    """Point t of the way from actions to noise, and the direction noise - actions."""
    return F.zip_with(actions, noise, lambda a, n: t * n + (1.0 - t) * a), F.zip_with(actions, noise, lambda a, n: n - a)


def flow_time(u: Column) -> Column:
    """A uniform number to the training time, Beta(1.5, 1) scaled into (0.001, 1]."""
    return F.pow(u, F.lit(1 / 1.5)) * 0.999 + 0.001


def zip_strict(a: Column, b: Column) -> Column:
    """Pairs by position; an error if the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(F.raise_error(F.lit("vectors of different length")))
