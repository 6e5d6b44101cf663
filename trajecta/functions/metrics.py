"""Learning-rate schedules as Columns of a step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _warm(step: Column, warmup: int, peak: float) -> Column:
    first = peak / (warmup + 1)
    return F.lit(first) + F.lit(peak - first) * step / F.lit(max(warmup, 1))


def cosine(step: Column, warmup: int = 1_000, peak: float = 2.5e-5, decay: int = 30_000, end: float = 2.5e-6) -> Column:
    """Linear warm-up from peak / (warmup + 1), then a half cosine to `end` at step `decay`."""
    share = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, decay - warmup))))
    return F.when(step < warmup, _warm(step, warmup, peak)).otherwise(F.lit(end) + F.lit(peak - end) * 0.5 * (1.0 + F.cos(share * math.pi)))


def inverse_root(step: Column, warmup: int = 1_000, peak: float = 5e-5, timescale: float = 10_000) -> Column:
    """Linear warm-up, then peak / sqrt((timescale + steps since) / timescale)."""
    return F.when(step < warmup, _warm(step, warmup, peak)).otherwise(F.lit(peak) / F.sqrt((F.lit(timescale) + step - warmup) / timescale))
