"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, as in tests, a local folder that is then set for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='trajecta-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, so that a lost executor costs no recomputation.

    The shuffle files of the write are deleted when it ends, as the table stands in for them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trajecta-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def replaced(docs: DataFrame, new: list[str], *used: str) -> DataFrame:
    """docs without columns that have one of the new names (whatever their case), which the operator's own replace; the columns it uses must not be among them."""
    names = {n.lower() for n in new}
    if clash := names & {u.lower() for u in used}:
        raise ValueError(f"an input column has an output's name: {sorted(clash)}")
    return docs.drop(*(c for c in docs.columns if c.lower() in names))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns _c0, _c1, ..., so that no name can clash, and the new name of each old one."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
