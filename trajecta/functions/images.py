"""Image geometry as arithmetic Columns, and pixel kernels as Arrow UDFs over struct<data binary, h int, w int, c int> (rows, columns, channels; 8 bits).

Pixel functions take one image [h, w, c]; those that say so also stacks [n, h, w, c] of images of one shape. Kernels come after all filters. A null image gives null; a size that does not fit the data is an error.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE = "struct<data: binary, h: int, w: int, c: int>"
# Numbers in a stack.
STACK = 1 << 20


def padded_geometry(h: Column, w: Column, height: int, width: int) -> dict[str, Column]:
    """Size after scaling without distortion, rounded down, and the top and left padding."""
    ratio = F.greatest(w / F.lit(float(width)), h / F.lit(float(height)))
    rh, rw = F.floor(h / ratio).cast("int"), F.floor(w / ratio).cast("int")
    return {"rh": rh, "rw": rw, "top": F.greatest(F.lit(0), F.floor((F.lit(height) - rh) / 2)).cast("int"), "left": F.greatest(F.lit(0), F.floor((F.lit(width) - rw) / 2)).cast("int")}


def scaled(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with a support that widens when shrinking, in doubles; also of stacks."""

    def taps(n: int, m: int) -> np.ndarray:
        scale = n / m
        support = max(scale, 1.0)
        center = (np.arange(m) + 0.5) * scale
        weight = np.maximum(0.0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - center[:, None]) / support))
        return weight / weight.sum(axis=1, keepdims=True)

    rows = np.einsum("ij,...jkc->...ikc", taps(x.shape[-3], height), x.astype(np.float64))
    return np.einsum("ij,...kjc->...kic", taps(x.shape[-2], width), rows)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """The same in bytes, rounded half up."""
    return np.clip(np.floor(scaled(x, height, width) + 0.5), 0, 255).astype(np.uint8)


def bicubic(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic (a = -0.5) with a support that widens when shrinking, columns first, with 22 bits of fraction and bytes between the passes; also of stacks."""

    def taps(n: int, m: int) -> np.ndarray:
        scale = n / m
        wide = max(scale, 1.0)
        out = np.zeros((m, n), np.int64)
        for k in range(m):
            center = (k + 0.5) * scale
            low, high = max(0, int(center - 2 * wide + 0.5)), min(n, int(center + 2 * wide + 0.5))
            d = np.abs((np.arange(low, high) - center + 0.5) / wide)
            w = np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))
            w = w / w.sum() * (1 << 22)
            out[k, low:high] = np.trunc(w + np.where(w < 0, -0.5, 0.5))
        return out

    bytes_of = lambda v: np.clip((v + (1 << 21)) >> 22, 0, 255)
    h, w, _ = x.shape[-3:]
    v = x.astype(np.int64)
    if w != width:
        v = bytes_of(np.einsum("ij,...kjc->...kic", taps(w, width), v))
    if h != height:
        v = bytes_of(np.einsum("ij,...jkc->...ikc", taps(h, height), v))
    return v.astype(np.uint8)


def with_pad(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Scaled without distortion and centred on zeros; unchanged if it has the size; also of stacks."""
    h, w, c = x.shape[-3:]
    if (h, w) == (height, width):
        return x
    ratio = max(w / width, h / height)
    rh, rw = int(h / ratio), int(w / ratio)
    out = np.zeros((*x.shape[:-3], height, width, c), np.uint8)
    top, left = max(0, (height - rh) // 2), max(0, (width - rw) // 2)
    if rh and rw:
        out[..., top : top + rh, left : left + rw, :] = resized(x, rh, rw)
    return out


def with_pad_even(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """The training side's convention: bytes are rounded half to even and padded with 0; 32-bit floats are cut to [-1, 1] and padded with -1; an odd
    pixel of padding is at the end. Always scaled, also to the size it has; also of stacks."""
    if x.dtype not in (np.uint8, np.float32):
        raise ValueError(f"an image of bytes or 32-bit floats, not of {x.dtype}")
    h, w, c = x.shape[-3:]
    ratio = max(w / width, h / height)
    rh, rw = int(h / ratio), int(w / ratio)
    whole = x.dtype == np.uint8
    out = np.full((*x.shape[:-3], height, width, c), 0 if whole else -1, x.dtype)
    if rh and rw:
        v = scaled(x, rh, rw)
        top, left = (height - rh) // 2, (width - rw) // 2
        out[..., top : top + rh, left : left + rw, :] = np.clip(np.rint(v), 0, 255) if whole else np.clip(v, -1, 1)
    return out


def _cropped(n: int) -> int:
    return max(1, int(n * 0.95))


@functools.lru_cache(1 << 14)
def _drawn(seed: int, h: int, w: int, wrist: bool) -> tuple[float, ...]:
    """Top and left of the crop, cosine and sine of the turn (0 for wrist cameras), brightness, contrast, saturation."""
    rng = np.random.default_rng(seed)
    out: list[float] = [0, 0, 0, 0]
    if not wrist:
        out[:2] = rng.integers(0, h - _cropped(h) + 1), rng.integers(0, w - _cropped(w) + 1)
        a = np.deg2rad(rng.uniform(-5, 5))
        out[2:] = np.cos(a), np.sin(a)
    return *out, rng.uniform(0.7, 1.3), rng.uniform(0.6, 1.4), rng.uniform(0.5, 1.5)


def augmented(x: np.ndarray, seed: int, wrist: bool = False) -> np.ndarray:
    """Seeded crop to 95 % and rotation within 5 degrees (not for wrist cameras), then brightness, contrast and saturation."""
    return all_augmented(x[None], [seed], wrist)[0]


def all_augmented(x: np.ndarray, seeds: Sequence[int], wrist: bool = False) -> np.ndarray:
    """The same of a stack, a seed for each image."""
    n, h, w, _ = x.shape
    top, left, cos, sin, light, contrast, colour = np.array([_drawn(seed, h, w, wrist) for seed in seeds]).T[:, :, None, None]
    each = np.arange(n)[:, None, None]
    if not wrist:
        ch, cw = _cropped(h), _cropped(w)
        x = resized(x[each, top.astype(int) + np.arange(ch)[:, None], left.astype(int) + np.arange(cw)], h, w)
        yy, xx = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
        sy, sx = np.rint(cos * yy - sin * xx + (h - 1) / 2).astype(int), np.rint(sin * yy + cos * xx + (w - 1) / 2).astype(int)
        inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
        x = np.where(inside[..., None], x[each, np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 0)
    mean = lambda v: v.reshape(n, -1).mean(axis=1)[:, None, None, None]
    v = x / 255.0 * light[..., None]
    v = (v - mean(v)) * contrast[..., None] + mean(v)
    gray = v.mean(axis=3, keepdims=True)
    return np.clip(((v - gray) * colour[..., None] + gray) * 255, 0, 255).astype(np.uint8)


def from_float(values: np.ndarray) -> np.ndarray:
    """[0, 1] floats to bytes, cut."""
    return (255 * values).astype(np.uint8)


def to_float(x: np.ndarray) -> np.ndarray:
    """Bytes to [-1, 1]."""
    return x.astype(np.float32) / 255.0 * 2.0 - 1.0


def channels_last(x: np.ndarray) -> np.ndarray:
    """[3, h, w] to [h, w, 3]; other shapes unchanged."""
    return x.transpose(1, 2, 0) if x.ndim == 3 and x.shape[0] == 3 else x


def channels_first(x: np.ndarray) -> np.ndarray:
    """[h, w, c] to [c, h, w]."""
    return x.transpose(2, 0, 1)


def flipped(x: np.ndarray) -> np.ndarray:
    """Turned by 180 degrees."""
    return x[::-1, ::-1]


def swapped(x: np.ndarray) -> np.ndarray:
    """Blue, green, red and perhaps alpha to red, green, blue."""
    return x[..., 2::-1]


def stack_kernel(body: Callable[[np.ndarray], Iterable[np.ndarray]]) -> Callable[[Column], Column]:
    """A function of a stack of images of one shape, which gives an image for each, as a function of an image column."""

    @F.arrow_udf(IMAGE)
    def run(images: pa.Array) -> pa.Array:
        pixels, *sizes = images.flatten()
        data, shapes = pixels.to_pylist(), np.stack([x.fill_null(0).to_numpy(zero_copy_only=False) for x in sizes], axis=1)
        rows = np.flatnonzero(pixels.is_valid().to_numpy(zero_copy_only=False))
        if any(not x.take(pa.array(rows)).is_valid().to_numpy(zero_copy_only=False).all() for x in sizes):
            raise ValueError("an image without a size")
        out: list[tuple] = [(None, None, None, None)] * len(data)
        kinds, kind = np.unique(shapes[rows], axis=0, return_inverse=True)
        order = np.argsort(kind.ravel(), kind="stable")
        for (h, w, c), same in zip(kinds.tolist(), np.split(rows[order], np.cumsum(np.bincount(kind.ravel()))[:-1]) if len(rows) else []):
            step = max(1, STACK // max(1, h * w * c))
            for i in range(0, len(same), step):
                part = same[i : i + step].tolist()
                stack = np.stack([np.frombuffer(data[row], np.uint8).reshape(h, w, c) for row in part])
                for row, x in zip(part, body(stack), strict=True):
                    out[row] = (x.tobytes(), *x.shape)
        kinds_of = (pa.binary(), pa.int32(), pa.int32(), pa.int32())
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, kinds_of)], ["data", "h", "w", "c"])

    return run


def kernel(body: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """An image function as a function of an image column."""
    return stack_kernel(lambda stack: map(body, stack))


def resize_with_pad(image: Column, height: int, width: int) -> Column:
    return stack_kernel(lambda x: with_pad(x, height, width))(image)


def resize_with_pad_even(image: Column, height: int, width: int) -> Column:
    return stack_kernel(lambda x: with_pad_even(x, height, width))(image)


def picked(images: Column, camera: str, side: str = "left") -> Column:
    """The picture of the first camera, in order of names, whose name contains the id and the side, with red first and without alpha; null if there is none."""
    fits = F.map_filter(images, lambda k, _: F.contains(k, F.lit(camera)) & F.contains(k, F.lit(side)))
    return kernel(swapped)(F.try_element_at(fits, F.array_min(F.map_keys(fits))))


def observed(images: Column, cameras: Sequence[str], height: int = 224, width: int = 224) -> Column:
    """A map of pictures as a policy is sent them: without depth cameras, scaled and padded, channels first (h, w and c are the new shape). Cameras that a record lacks stay absent."""
    shaped = stack_kernel(lambda x: map(channels_first, with_pad(x, height, width)))
    made = F.create_map(*(x for c in cameras if "_depth" not in c for x in (F.lit(c), shaped(F.try_element_at(images, F.lit(c))))))
    return F.map_filter(made, lambda _, v: v["data"].isNotNull())


def recorded(image: Column, height: int = 180, width: int = 320) -> Column:
    """A camera's blue, green, red picture as a dataset stores it: red first, bicubic to its size."""
    return stack_kernel(lambda x: bicubic(swapped(x), height, width))(image)


def zero_image(h: int = 224, w: int = 224, c: int = 3) -> Column:
    return F.struct(F.lit(bytes(h * w * c)).alias("data"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.lit(c).alias("c"))
