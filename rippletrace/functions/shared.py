"""Tables in the folder that a cluster shares: they end a lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Spark removes the shuffle files of a query when it ends; where it is off they stay until the driver's next collection of garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """A name not used before in the folder of spark.checkpoint.dir (a temporary one only on one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "rippletrace-shared")
    return f"{folder.rstrip('/')}/rippletrace-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed(spark: SparkSession):
    """Shuffle files of queries that run here go when these end, so they do not add up on disk."""
    was = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, was)


def cut(df: DataFrame, *more: DataFrame) -> DataFrame:
    """The rows, of several tables one after another, written to a new folder and read back; what was shuffled for a table is removed with its end."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    for part in (df, *more):
        with freed(spark):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of a table as the planner takes them to be."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `cut` wrote and that nothing reads any more."""
    folders = {os.path.basename(os.path.dirname(file)) for table in tables for file in table.inputFiles()}
    for spark, path in [w for w in _written if os.path.basename(w[1]) in folders]:
        _remove(spark, path)
        _written.remove((spark, path))


@atexit.register
def clear() -> None:
    """Remove what `cut` wrote; results that are not computed yet need it, so this waits for the end of the program."""
    for spark, path in _written:
        _remove(spark, path)
    _written.clear()
