"""A model hosted in a pipeline: records are prepared, go through the model in batches, and come back in the robot's own units.

The model itself is the caller's: a function that loads it, once for each Python worker, and returns what turns a batch of arrays into actions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.operators.stats import NormStats
from trajecta.plans.pipeline import Config, Family

Model = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
OUTPUT = T.StructType([T.StructField("actions", T.ArrayType(T.DoubleType())), T.StructField("infer_ms", T.DoubleType())])


@dataclass
class Host:
    """load() gives the model: (state [n, D], tokens [n, L], mask [n, L], noise [n, H, D]) to actions [n, H, D].

    `metadata` is told to whoever asks before the first request. reset() forgets the loaded model: the next job loads it again."""

    config: Config
    stats: dict[str, NormStats]
    load: Callable[[], Model]
    batch_size: int = 64
    metadata: dict = field(default_factory=dict)
    _udf: Callable | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.config.model.family is Family.FAST:
            raise ValueError("a model that puts out tokens is decoded by Config.inference_outputs; this host takes one that puts out actions")

    def reset(self) -> None:
        self._udf = None

    def model(self) -> Callable:
        """The model as a function of columns. Workers keep what they loaded for it."""
        if self._udf is None:
            m, load = self.config.model, self.load

            def make():
                import time

                model = load()

                def predict(state: np.ndarray, tokens: np.ndarray, mask: np.ndarray, noise: np.ndarray) -> dict[str, np.ndarray]:
                    start = time.monotonic()
                    actions = np.asarray(model(state, tokens, mask > 0, noise), np.float64)
                    if actions.shape != noise.shape:
                        raise ValueError(f"the model gave actions of shape {actions.shape}, not {noise.shape}")
                    return {"actions": actions.reshape(len(state), -1), "infer_ms": np.full(len(state), (time.monotonic() - start) * 1000.0)}

                return predict

            self._udf = predict_batch_udf(make, return_type=OUTPUT, batch_size=self.batch_size, input_tensor_shapes=[[m.dim], [m.tokens], [m.tokens], [m.horizon, m.dim]])
        return self._udf

    def infer(self, df: DataFrame, noise: Column | None = None) -> DataFrame:
        """df's keys (columns that end in _id, episode, t), actions [H][D of the robot], and policy_timing.infer_ms, the time of the row's batch.

        noise: H * D numbers for each row, such as sessions.noise; zeros without it. Rows without a state are an error of the record, not of the model."""
        m = self.config.model
        given = noise if noise is not None else F.array_repeat(F.lit(0.0), m.horizon * m.dim)
        rows = df.select("*", given.alias("_noise_id")) if "actions" not in df.columns else df.drop("actions").select("*", given.alias("_noise_id"))
        ready = rows.transform(self.config.training(self.stats))
        state = F.coalesce("state", F.raise_error(F.lit("a record has no state")).cast("array<double>"))
        answer = self.model()(state, F.col("tokenized_prompt"), F.transform("tokenized_prompt_mask", lambda x: x.cast("int")), F.col("_noise_id"))
        keys = [c for c in ready.columns if c != "_noise_id" and (c.endswith("_id") or c in ("episode", "t"))]
        out = ready.select(*keys, "state", answer.alias("_answer"))
        steps = F.transform(F.sequence(F.lit(0), F.lit(m.horizon - 1)), lambda k: F.slice("_answer.actions", k * m.dim + 1, F.lit(m.dim)))
        out = out.select(*keys, "state", steps.alias("actions"), F.struct(F.col("_answer.infer_ms").alias("infer_ms")).alias("policy_timing"))
        return out.transform(self.config.inference_outputs(self.stats)).select(*keys, "actions", "policy_timing")
