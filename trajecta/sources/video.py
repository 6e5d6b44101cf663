"""Video files as tables of frames, and recordings of many cameras read in step.

The index of a file is parsed inside Arrow batches, a file at a time; Spark reads the bytes, by any file system it knows. Frames stay encoded: an image decoder is a
function of the caller's over the `data` column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajecta.functions import mp4

FRAMES = "track int, codec string, width int, height int, frame long, offset long, size long, time double, key boolean, data binary, error string"
BATCH = 4096


def frames(files: DataFrame, content: str = "content", keys: Sequence[str] = ("path",), data: bool = False) -> DataFrame:
    """keys, track, codec, width, height, frame (from 0, as shown), offset, size, time in seconds, key (it stands alone), data (its bytes, if asked for) and error of all frames.

    A file that cannot be read gives one row with the error and nulls, a null content none, a track without frames none."""

    def rows(value: bytes) -> Iterator[tuple]:
        try:
            found = mp4.tracks(value)
        except ValueError as e:
            yield (*[None] * 10, str(e))
            return
        for i, t in enumerate(found):
            for n, (offset, size, time, key) in enumerate(zip(t.offset.tolist(), t.size.tolist(), t.time.tolist(), t.key.tolist())):
                yield i, t.codec, t.width, t.height, n, offset, size, time, key, value[offset : offset + size] if data else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                if not value.is_valid:
                    continue
                made = list(rows(value.as_py()))
                for at in range(0, len(made), BATCH):
                    part = made[at : at + BATCH]
                    own = [batch.column(k).slice(i, 1).take(pa.array([0] * len(part))) for k in range(len(keys))]
                    columns = [pa.array(c, k) for c, k in zip(zip(*part), kinds)]
                    yield pa.RecordBatch.from_arrays([*own, *columns], [*keys, *names])

    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.binary(), pa.string())
    names = [f.split()[0] for f in FRAMES.split(", ")]
    own = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)
    return files.select(*keys, F.col(content).alias("_content")).mapInArrow(run, f"{own}, {FRAMES}")


def read_videos(spark: SparkSession, root: str, pattern: str = "*.mp4", data: bool = False) -> DataFrame:
    """frames() of all files below a folder whose name fits the pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return frames(files.select("path", "content"), data=data)


def by_camera(found: DataFrame, cameras: dict[str, str], skip: str = "stereo", path: str = "path") -> DataFrame:
    """found with `camera`, the type of the first id (in order of the map) that the file's name contains; names that contain `skip` go, as do others."""
    name = F.element_at(F.split(path, "/"), -1)
    kind = F.coalesce(*(F.when(F.contains(name, F.lit(i)), F.lit(t)) for i, t in cameras.items()))
    return found.where(~F.contains(name, F.lit(skip))).withColumn("camera", kind).where("camera IS NOT NULL")


def lockstep(given: DataFrame, episode: str, camera: str, index: str, value: str, cameras: Sequence[str], ok: str | None = None, block: int = 4096) -> DataFrame:
    """episode, index and a column for each camera: frame 0, 1, ... of all cameras side by side, up to the first one that any of them lacks or that is not ok.

    An episode without one of the cameras has no frames. Recorded steps count as a camera. Of repeated frames the one with the least value counts. Positions are looked at in blocks, so that
    an episode of any length is spread over tasks; only a row a block is looked at by episode."""
    rows = given.where(F.col(camera).isin(*cameras) & F.col(index).isNotNull() & (F.col(index) >= 0))
    rows = rows.select(F.col(episode).alias("_e"), F.col(camera).alias("_c"), F.col(index).cast("long").alias("_i"), F.col(value).alias("_v"), (F.col(ok) if ok else F.lit(True)).alias("_ok"))
    good = rows.where("_ok").groupBy("_e", "_c", "_i").agg(F.min("_v").alias("_v"))
    b, n = F.floor(F.col("_i") / block), F.lit(block)
    place = F.row_number().over(Window.partitionBy("_e", "_c", "_b").orderBy("_i")) - 1
    numbered = good.withColumn("_b", b).withColumn("_gap", F.col("_i") - F.col("_b") * n != place)
    blocks = numbered.groupBy("_e", "_c", "_b").agg(F.sum(F.when(~F.col("_gap"), 1).otherwise(0)).alias("_whole"))
    late = F.row_number().over(Window.partitionBy("_e", "_c").orderBy("_b")) - 1
    seen = blocks.withColumn("_late", late)
    end = F.when(F.col("_b") != F.col("_late"), F.col("_late") * n).when(F.col("_whole") < n, F.col("_b") * n + F.col("_whole")).otherwise(None)
    ends = seen.groupBy("_e", "_c").agg(F.coalesce(F.min(end), (F.max("_b") + 1) * n).alias("_end"))
    stops = ends.groupBy("_e").agg(F.min("_end").alias("_stop"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(set(cameras))).select(F.col("_e").alias("_of"), "_stop")
    kept = good.join(stops, F.col("_e").eqNullSafe(F.col("_of"))).where("_i < _stop")
    side = kept.groupBy("_e", "_i").agg(*(F.min(F.when(F.col("_c") == c, F.col("_v"))).alias(c) for c in cameras))
    return side.withColumnsRenamed({"_e": episode, "_i": index})
