"""First-wins helpers: every table carries its order, and these keep it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.shared import cut


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order (null keys are equal)."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def numbered(df: DataFrame, name: str, partition: list[str], *order: str | Column) -> DataFrame:
    """Numbers from 1 in the given order within each partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def totals_before(df: DataFrame, partition: list[str], order: list[str | Column], **values: Column) -> DataFrame:
    """For each value, its sum over the rows that come earlier in the order, within each partition of any size.

    Rows are dealt by ranges of the order, and written, so that a row keeps its range; sums
    run inside a range and over the totals of the ranges, so no task holds a partition.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(ranges, *map(F.col, partition), *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*partition, "_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    earlier = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"_of_{c}") for c in partition], F.col("_range").alias("_of_range"), *[zero(F.sum(f"_{k}").over(earlier)).alias(f"_{k}") for k in values])
    same = ranged["_range"] == F.col("_of_range")
    for c in partition:
        same &= ranged[c].eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy("_range", *partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(totals, same).select(*df.columns, "_range", *[f"_{k}" for k in values])
    return joined.withColumns({k: F.col(f"_{k}") + zero(F.sum(v).over(inside)) for k, v in values.items()}).drop("_range", *[f"_{k}" for k in values])


def numbered_widely(df: DataFrame, name: str, partition: list[str], *order: str | Column) -> DataFrame:
    """As `numbered`, for partitions that may hold very many rows.

    Rows are dealt once, by ranges of the order, and written in order with their places in the range. A number is a place less that of the
    partition's first row there, after the rows of earlier ranges; so rows are not dealt again to be counted.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, partition), *order]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = cut(df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_range"), place.alias("_place")))
    starts = ranged.groupBy(*partition, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*partition).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    starts = cut(starts.select(*[F.col(c).alias(f"_of_{c}") for c in partition], F.col("_range").alias("_of_range"), start.alias("_start")))
    same = ranged["_range"] == F.col("_of_range")
    for c in partition:
        same &= ranged[c].eqNullSafe(F.col(f"_of_{c}"))
    return ranged.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_place") + 1).cast("int").alias(name))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys, for work that is heavy for their bytes: a small file of many rows is else one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ordered_list(value: Column, *order: str) -> Column:
    """Aggregate: values as an array in the given order."""
    packed = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], value.alias("_value"))
    return F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["_value"])
