"""Session helpers of the operators: reading tables, shared folders, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from . import _bytes as B

#: Rows in one Arrow batch; long texts would make the usual 10,000 too large for a worker.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the memory of Arrow batches of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for all its machines; a temporary one only on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = os.path.join(tempfile.gettempdir(), "rippletrace-shared")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there, and lost executors cost no more than their tasks.

    A compressed columnar table takes a fraction of the space of a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rippletrace-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def clear() -> None:
    """Remove the tables that `cut` wrote; results that are not computed yet need them, so this waits for the end of the program."""
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone already
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written.clear()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_names(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """The frame under positional names, so that no added column can clash; and the new name of `column`."""
    return df.toDF(*[f"in_{i}" for i in range(len(df.columns))]), f"in_{df.columns.index(column)}"


def arrow_map(df: DataFrame, work, schema: str | StructType) -> DataFrame:
    """`mapInArrow` whose tasks give their memory back at the end: a Python worker lives on with other work."""

    def lean(batches):
        try:
            yield from work(batches)
        finally:
            B.release()

    return df.mapInArrow(lean, schema)


def extended(schema: StructType, added: str) -> StructType:
    """The fields of a schema, as they are, and those of a DDL text."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])
