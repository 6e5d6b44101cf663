"""Statistics of a named configuration: what scales its state and actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from trajecta.operators import adaptive, sampling, structure
from trajecta.operators.stats import BINS, NormStats
from trajecta.plans.pipeline import Config

FIELDS = ("state", "actions")


def config_statistics(config: Config, frames: DataFrame, path: str, stored: bool = False, max_frames: tuple[str, int] | None = None, batch: str | None = None, bins: int = BINS) -> DataFrame:
    """field (state or actions), dim, n, mean, std, min, max, q01, q99 of frames after the robot's transforms and deltas, before scaling and padding; one scan for all.

    frames have the robot's own names, or, with `stored`, those of its dataset. Every step of an action chunk counts. max_frames: a key column and a number of
    frames, drawn by the key's hash. Images are never read: the plan prunes what only they need. The batches' states go to `path`, a new one."""
    steps = [lambda df: structure.repack(df, config.stored)] if stored and config.stored else []
    steps += [lambda df: structure.repack(df, config.repack)] if config.repack else []
    if max_frames is not None:
        key, n = max_frames
        frames = sampling.truncated(sampling.positioned(frames, key, 0, "_position"), "_position", n, 1).drop("_position")
    ready = structure.compose(*steps, *config.data_group().inputs)(frames.withColumnRenamed(batch, "batch_id") if batch else frames)
    there = [f for f in FIELDS if f in ready.columns]
    return adaptive.statistics(ready, {f: f for f in there}, path, "batch_id" if batch else None, bins=bins)


def norm_stats(rows: DataFrame, fields: Sequence[str] = FIELDS) -> dict[str, NormStats]:
    """As a configuration's transforms take them; a row for each dimension goes to the driver."""
    found = sorted(rows.collect(), key=lambda r: r["dim"])
    return {f: NormStats(*([r[c] for r in found if r["field"] == f] for c in ("mean", "std", "q01", "q99"))) for f in fields if any(r["field"] == f for r in found)}
