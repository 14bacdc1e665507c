"""The interval join against brute force, and a long file with many ranges."""

import random

from pyspark.sql import functions as F

from rippletrace.functions.intervals import within


def test_against_brute_force(spark):
    rng = random.Random(4)
    ranges = [(rng.choice("ab"), k, s, s + rng.choice([-1, 0, 1, 2, 3, 7, 8, 60, 1000])) for k, s in enumerate(rng.randrange(-50, 400) for _ in range(300))] + [("a", 900, None, 5), (None, 901, 0, 9)]
    points = [(rng.choice(["a", "b", "c", None]), k, rng.randrange(-60, 500)) for k in range(400)] + [("a", 900, None)]
    p, r = spark.createDataFrame(points, "f string, p int, no int"), spark.createDataFrame(ranges, "f string, r int, s int, e int")
    got = sorted((x.p, x.r) for x in within(p, r, ["f"], "no", "s", "e").collect())
    want = sorted((b, d) for a, b, no in points for c, d, s, e in ranges if a is not None and a == c and None not in (no, s) and s <= no <= e)
    assert got == want and len(got) > 1000


def test_a_long_file_is_no_product(spark):
    lines = spark.range(100_000).select(F.lit("f").alias("f"), F.col("id").cast("int").alias("no"))
    ranges = spark.range(20_000).select(F.lit("f").alias("f"), F.col("id").alias("r"), (F.col("id") * 5).cast("int").alias("s"), (F.col("id") * 5 + F.col("id") % 4).cast("int").alias("e"))
    found = within(lines, ranges, ["f"], "no", "s", "e")
    assert found.count() == 20_000 * (1 + 2 + 3 + 4) // 4
