"""Sums over scored risks read them once, and only what they need."""

from pyspark.sql import functions as F

from rippletrace.operators import scoring


def test_scored_risks_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = F.col("id")
    rows = spark.range(200).select(F.lit("a").alias("analysis_id"), n.alias("risk_seq"), F.lit("high").alias("severity"), F.lit(0.5).alias("confidence"), (n % 90).cast("int").alias("score"))
    scored, analyses = rows.mapInArrow(count, rows.schema), spark.createDataFrame([("a",), ("b",)], "analysis_id string")
    got = {r.analysis_id: (r.risks, r.critical, r.high) for r in scoring.summary(analyses, analyses, analyses, scored).collect()}
    assert got == {"a": (200, 0, 200), "b": (0, 0, 0)} and read.value == 200
    read.value = 0
    assert {r.analysis_id: r.risks for r in scoring.overall(scored, analyses).collect()} == {"a": 200, "b": 0} and read.value == 200
