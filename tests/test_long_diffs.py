"""Diffs given as lines: equal to whole diffs, in every state, and spread over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from rippletrace.operators import diff

LINES = ["diff --git a/x.ts b/x.ts", "diff --git a/a/y b/b/y", "new file mode 100644", "deleted file mode 100644", "rename from p", "rename to q", "--- a/x.ts", "+++ b/x.ts", "+++ /dev/null", "@@ -1,3 +1 @@", "@@ -7 +9,2 @@ f", "@@ bad", "+a", "-b", " c", "", "\\ No newline", "---x", "+++x", "text"]


@pytest.mark.parametrize("strict", [False, True])
def test_equal_to_whole_diffs(spark, strict):
    rng = random.Random(3)
    texts = [(f"a{k}", "\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 60)))) for k in range(120)] + [("none", "")]
    whole = spark.createDataFrame(texts, "analysis_id string, diff string")
    lines = whole.select("analysis_id", F.posexplode(F.split("diff", "\n")).alias("pos", "line")).repartition(7)
    want = diff.parse_lines(whole, strict=strict)
    got = diff.parse_long(lines, strict=strict)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 300


def test_one_hunk_of_very_many_lines(spark):
    n = 400_000
    head = spark.createDataFrame([("big", 0, "diff --git a/f b/f"), ("big", 1, "@@ -5,9 +6,9 @@")], "analysis_id string, pos long, line string")
    body = spark.range(n).select(F.lit("big").alias("analysis_id"), (F.col("id") + 2).alias("pos"), F.concat(F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.col("id") % 3 + 1).cast("int")), F.col("id").cast("string")).alias("line"))
    rows = diff.parse_long(head.unionByName(body))
    assert rows.agg(F.count(F.lit(1)), F.max("old_line"), F.max("new_line")).first()[:] == (n, 5 + 2 * n // 3 - 1, 6 + 2 * n // 3)
    last = rows.where(F.col("pos") == n + 1).first()  # an added line
    assert (last.type, last.old_line, last.content) == ("added", None, str(n - 1))
