"""Heavy work on the rows of one small partition is dealt to all tasks."""

from pyspark.sql import functions as F

from rippletrace.operators import changes, graph, ts_scan, usage
from rippletrace.schemas import SYMBOL_META


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_partition_is_work_for_all_tasks(spark):
    n = F.col("id").cast("string")
    files = spark.range(0, 200, 1, 1).select(F.lit("a").alias("analysis_id"), F.col("id").cast("int").alias("file_seq"), F.concat(F.lit("f"), n, F.lit(".ts")).alias("path"), F.lit("export const f = (u: User) => { return u.a; };\n").alias("content"))
    scanned = ts_scan.scan(files)
    assert tasks(scanned) == 4 and ts_scan.symbols(scanned).count() == 200
    codes = spark.range(0, 200, 1, 1).select(F.lit("a").alias("analysis_id"), F.col("id").alias("symbol_seq"), F.lit("function").alias("type"), n.alias("name"), F.lit("function f(u: User) { return u.a; }").alias("code"))
    assert tasks(usage.with_variables(codes)) == 4
    used = usage.with_usages(codes)
    assert tasks(used) == 4 and {r.f for r in used.select(F.col("usages")[0]["field"].alias("f")).collect()} == {"User.a"}


def test_symbols_of_one_analysis_are_numbered_by_several_tasks(spark):
    n = F.col("id")
    ts = spark.range(0, 400, 1, 1).select(F.lit("a").alias("analysis_id"), (400 - n).cast("int").alias("file_seq"), F.lit(0).alias("kind_rank"), F.lit(0).alias("pos"), n.alias("id"))
    numbered = graph.sequence_symbols(ts, ts.limit(0))
    assert tasks(numbered) > 1 and {(r.id, r.symbol_seq) for r in numbered.collect()} == {(k, 400 - k) for k in range(400)}


def test_lines_of_one_partition_meet_their_symbols_in_all_tasks(spark):
    n = F.col("id").cast("int")
    text = lambda v, name: F.lit(v).alias(name)
    lines = spark.range(0, 200, 1, 1).select(text("a", "analysis_id"), text(0, "file_seq"), text(0, "hunk_seq"), n.alias("pos"), text("f.ts", "old_path"), text("f.ts", "new_path"), text("modified", "status"), text("added", "type"), text("x", "content"), F.lit(None).cast("int").alias("old_line"), n.alias("new_line"))
    symbols = spark.range(0, 3, 1, 1).select(text("a", "analysis_id"), F.col("id").alias("symbol_seq"), F.col("id").cast("string").alias("id"), text("S", "name"), text("function", "type"), text("f.ts", "file_path"), text(0, "start_line"), text(199, "end_line"), F.lit(None).cast(SYMBOL_META).alias("metadata"))
    found = changes.lines_in_symbols(lines, symbols)
    assert tasks(found) == 4 and found.select("pos", "symbol_seq").distinct().count() == found.count() == 600
