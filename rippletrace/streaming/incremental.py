"""Diffs as a stream: each micro-batch is analysed against known files and appended to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rippletrace.plans.analyze import Options, analyze
from rippletrace.schemas import DIFF_INPUT


def read_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files of diffs."""
    return spark.readStream.schema(DIFF_INPUT).parquet(folder)


def analyze_stream(diffs: DataFrame, files: DataFrame, out: str, checkpoint: str, *, options: Options = Options(), tables: tuple[str, ...] = ("changes", "risks", "summary")) -> StreamingQuery:
    """Start a query that writes `tables` below `out`.

    A batch goes to a folder of its own number and overwrites it, so a batch that
    runs again after a failure leaves its rows once. Only the analyses of a batch
    are computed; there is no state between batches.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        wanted = files.join(batch.select("analysis_id").distinct(), "analysis_id", "left_semi")
        found = analyze(wanted, batch, options=options)
        for name in tables:
            found[name].write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}/batch={number}")

    return diffs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
