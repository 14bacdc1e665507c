"""Points in intervals by an equi join on bins of doubling sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _shifted(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value.cast("long"), level)


def within(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """`points` joined with the `ranges` of equal keys that hold them (start <= at <= end); the columns of both, keys once.

    A range goes to the level whose bins are longer than it but at most twice as long, and lies in one or two of
    them. A point looks into one bin of each level that the ranges of its keys use (64 at most), where ranges
    are about as long as the bin; so what is compared grows with points and matches, not with points times ranges.
    Columns must have different names but for the keys; null points and ranges match nothing.
    """
    long = F.col(end).cast("long") - F.col(start).cast("long")
    level = F.when(long == 0, 0).otherwise(F.length(F.bin(long)))
    ranges = ranges.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    levels = ranges.select(*keys, "_level").distinct()
    ranges = ranges.withColumn("_bin", F.explode(F.sequence(_shifted(F.col(start), F.col("_level")), _shifted(F.col(end), F.col("_level")))))
    looked = points.join(levels, keys).withColumn("_bin", _shifted(F.col(at), F.col("_level")))
    return looked.join(ranges, [*keys, "_level", "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_level", "_bin")
