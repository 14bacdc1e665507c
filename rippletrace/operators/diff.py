"""Unified diffs as tables: line classes, running counters and file states by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions import shared
from rippletrace.functions.exprs import IDENT, WS, clean_diff_path, trim_ws
from rippletrace.functions.ordering import totals_before

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HEADER = r"^diff --git a/(.+?) b/(.+)$"
PROPERTY = rf"^(?:readonly{WS}+)?({IDENT})(\?)?{WS}*:{WS}*([^;]+);?$"


def hunk_header(line: Column) -> Column:
    """struct<old_start, old_count, new_start, new_count>, null where the line is no hunk header."""
    part = lambda i: F.regexp_extract(line, HUNK, i)
    count = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("1")).try_cast("int")
    fields = F.struct(part(1).try_cast("int").alias("old_start"), count(2).alias("old_count"), part(3).try_cast("int").alias("new_start"), count(4).alias("new_count"))
    return F.when(line.rlike(HUNK), fields)


def ts_property(line: Column) -> Column:
    """struct<name, type> of an interface property line; the type of an optional one starts with `?`."""
    t = trim_ws(line)
    kind = F.concat(F.regexp_extract(t, PROPERTY, 2), trim_ws(F.regexp_extract(t, PROPERTY, 3)))
    return F.when(t.rlike(PROPERTY), F.struct(F.regexp_extract(t, PROPERTY, 1).alias("name"), kind.alias("type")))


def line_class(line: Column) -> Column:
    """How a view colours a diff line."""
    return F.when(line.startswith("@@"), "hunk").when(line.startswith("-") & ~line.startswith("---"), "removed").when(line.startswith("+") & ~line.startswith("+++"), "added").otherwise("plain")


def _kind(line: Column, strict: bool) -> Column:
    """What a line is, from its text, `header` and `hunk_seq`."""
    outside = F.col("hunk_seq") == 0 if strict else F.lit(True)
    return (
        F.when(line.startswith("diff --git "), "file")
        .when(line.startswith("new file mode"), "new")
        .when(line.startswith("deleted file mode"), "deleted")
        .when(line.startswith("rename from "), "rename_from")
        .when(line.startswith("rename to "), "rename_to")
        .when(line.startswith("--- ") & outside, "minus")
        .when(line.startswith("+++ ") & outside, "plus")
        .when(line.startswith("@@"), F.when(F.col("header").isNotNull(), "hunk").otherwise("skip"))
        .when(F.col("hunk_seq") == 0, "skip")
        .when(line.startswith("+") & (~line.startswith("+++") | F.lit(strict)), "added")
        .when(line.startswith("-") & (~line.startswith("---") | F.lit(strict)), "removed")
        .when(line.startswith("\\"), "skip")
        .otherwise("context")
    )


def _classified(diffs: DataFrame, strict: bool) -> DataFrame:
    lines = diffs.select("analysis_id", F.posexplode(F.split(F.coalesce("diff", F.lit("")), "\n")).alias("pos", "line"))
    so_far = Window.partitionBy("analysis_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_file = Window.partitionBy("analysis_id", "file_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    lines = lines.withColumn("file_seq", F.sum(line.startswith("diff --git ").cast("int")).over(so_far).cast("int")).where("file_seq > 0")
    lines = lines.withColumn("header", hunk_header(line))
    lines = lines.withColumn("hunk_seq", F.sum(F.col("header").isNotNull().cast("int")).over(in_file).cast("int"))
    return lines.withColumn("kind", _kind(line, strict))


def _files(lines: DataFrame) -> DataFrame:
    line, kind = F.col("line"), F.col("kind")
    rest = F.when(kind.isin("minus", "plus"), F.substring(line, 5, 2**31 - 1)).when(kind == "rename_from", F.substring(line, 13, 2**31 - 1)).when(kind == "rename_to", F.substring(line, 11, 2**31 - 1))
    lines = lines.where(kind.isin("file", "new", "deleted", "rename_from", "rename_to", "minus", "plus")).withColumn("rest", rest)
    old = F.when(kind == "file", F.regexp_extract("line", HEADER, 1)).when((kind == "rename_from") | (kind == "minus") & (F.col("rest") != "/dev/null"), clean_diff_path(F.col("rest")))
    new = F.when(kind == "file", F.regexp_extract("line", HEADER, 2)).when((kind == "rename_to") | (kind == "plus") & (F.col("rest") != "/dev/null"), clean_diff_path(F.col("rest")))
    status = F.when(kind == "file", "modified").when(kind == "new", "added").when(kind == "deleted", "deleted").when(kind.isin("rename_from", "rename_to"), "renamed")
    last = lambda value, name: F.max_by(value, F.when(value.isNotNull(), F.col("pos"))).alias(name)
    return lines.groupBy("analysis_id", "file_seq").agg(last(old, "old_path"), last(new, "new_path"), last(status, "status"))


def parse_files(diffs: DataFrame, *, strict: bool = False) -> DataFrame:
    """(analysis_id, file_seq, old_path, new_path, status), also for files without hunks."""
    return _files(_classified(diffs, strict))


def parse_lines(diffs: DataFrame, *, strict: bool = False) -> DataFrame:
    """Lines inside hunks with their old and new numbers.

    Faithful mode reads `--- ` and `+++ ` inside hunks as headers and other `---x`
    as context; `strict` treats them as removed and added lines.
    """
    lines = _classified(diffs, strict)
    inside = lines.where(F.col("kind").isin("hunk", "added", "removed", "context"))
    hunk = Window.partitionBy("analysis_id", "file_seq", "hunk_seq").orderBy("pos")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    start = F.first("header").over(hunk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    count = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("int")).over(before), F.lit(0)).cast("int")
    inside = inside.withColumn("start", start).withColumn("old_no", F.col("start.old_start") + count("removed", "context")).withColumn("new_no", F.col("start.new_start") + count("added", "context"))
    return _shaped(inside.where("kind <> 'hunk'"), lines)


def _shaped(inside: DataFrame, lines: DataFrame) -> DataFrame:
    kind, line = F.col("kind"), F.col("line")
    cut = F.substring(line, 2, 2**31 - 1)
    rows = inside.select(
        "analysis_id", "file_seq", "hunk_seq", "pos", F.col("start.old_start").alias("old_start"), F.col("start.old_count").alias("old_count"),
        F.col("start.new_start").alias("new_start"), F.col("start.new_count").alias("new_count"), kind.alias("type"),
        F.when(kind.isin("added", "removed") | line.startswith(" "), cut).otherwise(line).alias("content"),
        F.when(kind != "added", F.col("old_no")).alias("old_line"), F.when(kind != "removed", F.col("new_no")).alias("new_line"),
    )
    return rows.join(_files(lines), ["analysis_id", "file_seq"])


def parse_long(lines: DataFrame, *, strict: bool = False) -> DataFrame:
    """The rows of `parse_lines` for diffs given as lines (analysis_id, pos, line), of any length.

    Where a line stands, its file, hunk and numbers, are counts of lines before it: running totals over ranges of
    lines, less their values where its file and its hunk begin. So no task holds a diff, a file or a hunk.
    """
    line, key = F.col("line"), ["analysis_id", "file_seq"]
    opens = line.startswith("diff --git ").cast("int")
    lines = lines.select("analysis_id", "pos", "line", hunk_header(line).alias("header"))
    begins = F.col("header").isNotNull().cast("int")
    lines = totals_before(lines, ["analysis_id"], ["pos"], files=opens, hunks=begins)
    lines = lines.withColumn("file_seq", (F.col("files") + opens).cast("int")).where("file_seq > 0")
    base = lines.where(opens == 1).select(*key, F.col("hunks").alias("base"))
    lines = lines.join(base, key).withColumn("hunk_seq", (F.col("hunks") + begins - F.col("base")).cast("int"))
    lines = shared.cut(lines.withColumn("kind", _kind(line, strict)).drop("files", "hunks", "base"))
    inside = lines.where(F.col("kind").isin("hunk", "added", "removed", "context"))
    is_in = lambda *kinds: F.col("kind").isin(*kinds).cast("int")
    inside = shared.cut(totals_before(inside, ["analysis_id"], ["pos"], olds=is_in("removed", "context"), news=is_in("added", "context")))
    start = inside.where("kind = 'hunk'").select(*key, "hunk_seq", F.col("header").alias("start"), F.col("olds").alias("olds_0"), F.col("news").alias("news_0"))
    inside = inside.where("kind <> 'hunk'").join(start, [*key, "hunk_seq"])
    number = lambda side: (F.col(f"start.{side}_start") + F.col(f"{side}s") - F.col(f"{side}s_0")).cast("int").alias(f"{side}_no")
    return _shaped(inside.select(*key, "hunk_seq", "pos", "line", "kind", "start", number("old"), number("new")), lines)
