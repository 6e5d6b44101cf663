"""Episode datasets as Parquet with JSON side tables, and other recorded sources and sinks."""

from __future__ import annotations

import importlib.util
import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import lookup, timed
from trajecta.operators.stats import NormStats, from_json, to_json


def _read_text(spark: SparkSession, path: str) -> str:
    """One small file, whole, by any file system that Spark knows; a missing path is an error."""
    return spark.read.text(path, wholetext=True).first()[0]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_episodes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict]:
    """Frames, tasks (task_index, task) and the info record of a dataset folder."""
    info = json.loads(_read_text(spark, f"{root}/meta/info.json"))
    tasks = spark.read.schema("task_index long, task string").json(f"{root}/meta/tasks.jsonl")
    return spark.read.parquet(f"{root}/data"), tasks, info


def write_episodes(frames: DataFrame, root: str, fps: float, tasks: DataFrame | None = None, episode: str = "episode_index", frame: str = "frame_index", chunk: int = 1000) -> None:
    """Frames of an episode together and in order, in folders of `chunk` episodes; what was there is replaced."""
    spark = frames.sparkSession
    placed = frames.withColumn("chunk", F.floor(F.col(episode) / chunk).cast("int"))
    placed.repartition(episode).sortWithinPartitions(episode, frame).write.mode("overwrite").partitionBy("chunk").parquet(f"{root}/data")
    _write_text(spark, f"{root}/meta/info.json", json.dumps({"fps": fps, "features": {f.name: f.dataType.simpleString() for f in frames.schema.fields}}, indent=2))
    if tasks is not None:
        tasks.select("task_index", "task").write.mode("overwrite").json(f"{root}/meta/tasks.jsonl")


def training_frames(spark: SparkSession, root: str, horizon: int, keys: Sequence[str] = ("actions",), tolerance: float = timed.TOLERANCE, miss: str = "error", prompt_from_task: bool = False, episode: str = "episode_index", ts: str = "timestamp") -> DataFrame:
    """A dataset's frames with chunks of `horizon` elements in place of the action columns, at the recording's own rate; with the task's text as prompt.

    Frames are found by time, so a dropped frame is not taken for the next one (see timed.time_chunks)."""
    frames, tasks, info = read_episodes(spark, root)
    chunked = timed.time_chunks(frames, {k: k for k in keys}, episode, ts, horizon, info["fps"], tolerance, miss)
    return lookup.required(chunked, tasks, "task_index", "task", "prompt", "has no task") if prompt_from_task else chunked


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that a job makes on its way: below spark.checkpoint.dir, which all executors share; a local folder only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='trajecta-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_stats(spark: SparkSession, folder: str) -> dict[str, NormStats]:
    return from_json(_read_text(spark, f"{folder}/norm_stats.json"))


def write_stats(spark: SparkSession, folder: str, stats: dict[str, NormStats]) -> None:
    _write_text(spark, f"{folder}/norm_stats.json", to_json(stats))


def read_ranges(spark: SparkSession, path: str, episode: str = "episode") -> DataFrame:
    """episode, start, end of a JSON map from episode to half-open ranges."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<array<int>>>").alias("m"))
    ranges = rows.select(F.explode("m").alias(episode, "_r")).select(episode, F.explode("_r").alias("_r"))
    return ranges.select(episode, F.get("_r", F.lit(0)).alias("start"), F.get("_r", F.lit(1)).alias("end"))


def append_ranges(ranges: DataFrame, path: str) -> None:
    """Finished episodes' ranges, added to those of earlier runs; resume with lookup.unfinished."""
    ranges.write.mode("append").parquet(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """episode, instruction of a JSON map from episode to records with language_instruction1."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, map<string, string>>").alias("m"))
    return rows.select(F.explode("m").alias("episode", "_r")).select("episode", F.col("_r")["language_instruction1"].alias("instruction"))


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, length, modified of all files below a folder, sorted by path; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy("path")


def synthetic(spark: SparkSession, n: int, fields: dict[str, tuple[str, int]], seed: int = 0) -> DataFrame:
    """n rows of vectors by name: ("float", size) in [-1, 1), ("int", size) in [0, 2048), else zeros. Row i depends on i alone."""

    def element(name: str, kind: str) -> object:
        salt = sum(ord(c) * (k + 1) for k, c in enumerate(name)) + seed

        def value(k: Column) -> Column:
            h = F.pmod(F.pmod(F.pmod(F.col("id") * 1_000_003 + k, F.lit(3_000_000_000)) * 2_654_435_761 + salt * 97, F.lit(4_294_967_296)) * 48_271, F.lit(2_147_483_647))
            return (h / 2_147_483_647.0 * 2.0 - 1.0) if kind == "float" else (h % 2048).cast("int") if kind == "int" else F.lit(0)

        return value

    return spark.range(n).select("id", *(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), element(name, kind)).alias(name) for name, (kind, size) in fields.items()))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """path, dtype, shape and bytes of the arrays in a stored parameter file (.npz), or in all such files below a folder; a last part `value` that all paths
    share is cut off. Only the arrays' headers are unpacked; an array of objects is an error."""

    def run(batches):
        import io
        import zipfile

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as file:
                    for name in file.namelist():
                        with file.open(name) as part:
                            major, _ = np.lib.format.read_magic(part)
                            shape, _, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(part)
                        if kind.hasobject:
                            raise ValueError(f"{name} is an array of objects")
                        rows.append((name.removesuffix(".npy"), kind.name, list(shape), int(np.prod(shape, dtype=np.int64)) * kind.itemsize))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()))], ["path", "dtype", "shape", "bytes"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path)
    found = files.select("content").mapInArrow(run, "path string, dtype string, shape array<long>, bytes long")
    shared = found.agg(F.every(F.endswith("path", F.lit("/value"))).alias("_shared"))
    cut = F.when(F.col("_shared"), F.regexp_replace("path", "/value$", "")).otherwise(F.col("path"))
    return found.join(F.broadcast(shared)).withColumn("path", cut).drop("_shared")


def write_timings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def needs(library: str) -> None:
    """Readers of HDF5, TFRecord and MP4 depend on libraries that need not be there."""
    if importlib.util.find_spec(library) is None:
        raise ImportError(f"this source needs {library}")


def read_hdf5_steps(spark: SparkSession, root: str, datasets: Sequence[str]) -> DataFrame:
    """path, t and one array<double> column for each dataset of every HDF5 file below root; a dataset that a file lacks is null.

    Files are read on executors, one row of bytes each; needs h5py."""
    needs("h5py")

    def run(batches):
        import io

        import h5py
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with h5py.File(io.BytesIO(content)) as f:
                    arrays = {d: np.asarray(f[d], np.float64) if d in f else None for d in datasets}
                    n = max((len(a) for a in arrays.values() if a is not None), default=0)
                    yield pd.DataFrame({"path": path, "t": range(n)} | {d: [None] * n if a is None else [np.atleast_1d(v).tolist() for v in a] for d, a in arrays.items()})

    schema = ", ".join(f"`{d}` array<double>" for d in datasets)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.h*5").load(root)
    return found.select("path", "content").mapInPandas(run, f"path string, t int, {schema}")
