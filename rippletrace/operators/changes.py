"""Changed symbols: diff lines joined with the line ranges of head-side symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.exprs import EDGE, HIGH_IMPACT, STRUCTURAL_TYPES, change_type, field_id, last_dotted, normal_path, trim_ws
from rippletrace.functions.intervals import within
from rippletrace.functions.ordering import first_by, numbered, ordered_list, spread
from rippletrace.operators.diff import ts_property


def _with_path(lines: DataFrame) -> DataFrame:
    return lines.withColumn("path_key", normal_path(F.when(F.col("status") == "deleted", F.col("old_path")).otherwise(F.col("new_path"))))


def _touched(lines: DataFrame) -> DataFrame:
    """Removed lines by their old number and added lines by their new one."""
    keyed = _with_path(lines).where(F.col("type").isin("added", "removed")).withColumn("no", F.when(F.col("type") == "removed", F.col("old_line")).otherwise(F.col("new_line")))
    return keyed.select("analysis_id", "path_key", "file_seq", "hunk_seq", "pos", F.col("type").alias("line_type"), "content", "no")


def _placed(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("path_key", normal_path(F.col("file_path")))


SPAN = ["analysis_id", "path_key", "start_line", "end_line"]


def lines_in_symbols(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Removed lines by their old number and added lines by their new one, inside symbols of the same file.

    Lines meet the different spans of a file by bins, so a long file with many symbols is no product of both; the
    symbols come to the matches of their span. Numbers of both sides are held against the ranges of the head side.
    A line has a row for each symbol around it, so lines are dealt to all tasks before they meet the symbols.
    """
    placed = _placed(symbols)
    touched = spread(_touched(lines), "analysis_id", "path_key", "file_seq", "hunk_seq", "pos")
    hit = within(touched, placed.select(*SPAN).distinct(), ["analysis_id", "path_key"], "no", "start_line", "end_line")
    return hit.join(placed, SPAN)


def _sides(lines: DataFrame, spans: DataFrame, trimmed: bool, named: bool = False) -> DataFrame:
    """One row for each of `spans` touched by a file: before and after texts joined by line feeds.

    Symbols of one span share these texts, so they are put together once. `named`: only lines that name the `word` of the span.
    """
    hit = within(_touched(lines), spans.distinct(), ["analysis_id", "path_key"], "no", "start_line", "end_line")
    if named:
        hit = hit.where(F.call_function("regexp_like", F.col("content"), F.concat(F.lit(EDGE), F.col("word"), F.lit(EDGE))))
    text = trim_ws(F.col("content")) if trimmed else F.col("content")
    side = lambda t: F.array_join(ordered_list(F.when(F.col("line_type") == t, text), "hunk_seq", "pos"), "\n").alias(t)
    return hit.groupBy(*spans.columns, "file_seq").agg(side("removed"), side("added"))


def _finish(symbols: DataFrame, sides: DataFrame, kind: int, node) -> DataFrame:
    sides = sides.withColumns({"change_type": change_type(F.col("removed"), F.col("added")), "digest": _digest(F.col("removed"), F.col("added"))})
    rows = symbols.join(sides, [c for c in sides.columns if c in (*SPAN, "word")])
    return rows.select(
        "analysis_id", "file_seq", F.lit(kind).alias("kind"), F.col("symbol_seq").cast("long").alias("a"), F.lit(0).alias("b"), node.alias("node_id"), "name", "type", "file_path",
        "change_type", F.nullif("removed", F.lit("")).alias("before"), F.nullif("added", F.lit("")).alias("after"), "digest",
    )


def _digest(before, after):
    """Equal for equal pairs of texts; a null is an empty text."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(b).cast("string"), F.lit(":"), b, a), 256))


def _stored(symbols: DataFrame) -> DataFrame:
    return _placed(symbols.where("type = 'database_field'")).withColumn("word", last_dotted(F.col("name")))


def _prisma_sides(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    return _sides(lines.where(_path_of().endswith(".prisma")), _stored(symbols).select(*SPAN, "word"), True, named=True)


def prisma_field_changes(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Database fields whose recorded line is touched by a diff line that names them."""
    return _finish(_stored(symbols), _prisma_sides(lines, symbols), 0, field_id(F.col("name"))).drop("digest")


def _path_of():
    return F.when(F.col("status") == "deleted", F.col("old_path")).otherwise(F.col("new_path"))


def enclosing_type(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """`points` (analysis_id, path_key, no, …) with the smallest interface or type around the line; the earlier symbol on ties.

    Each line number of a file is looked up once, among the different spans of the file.
    """
    keys = ["analysis_id", "path_key"]
    typed = symbols.where(F.col("type").isin("interface", "type")).select("analysis_id", normal_path(F.col("file_path")).alias("path_key"), F.col("start_line").alias("_start"), F.col("end_line").alias("_end"), F.struct("symbol_seq", F.col("name").alias("name"), "file_path").alias("s"))
    spans = typed.groupBy(*keys, "_start", "_end").agg(F.min("s").alias("s"))
    hit = within(points.select(*keys, "no").distinct(), spans, keys, "no", "_start", "_end")
    found = hit.groupBy(*keys, "no").agg(F.min(F.struct((F.col("_end") - F.col("_start")).alias("span"), "s")).alias("t"))
    return points.join(found, [*keys, "no"]).select(*points.columns, F.col("t.s.name").alias("parent"), F.col("t.s.file_path").alias("file_path"))


def ts_field_changes(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Properties removed and added under one name in a hunk, inside an interface or type; unpaired ones yield nothing."""
    keyed = _with_path(lines.where(_path_of().rlike(r"\.(tsx?|jsx?)$"))).withColumn("p", ts_property(F.col("content"))).where("p IS NOT NULL").withColumn("prop", F.col("p.name"))
    hunk = ["analysis_id", "file_seq", "hunk_seq", "prop"]
    added = keyed.where("type = 'added'").groupBy(*hunk).agg(F.min_by(F.col("content"), F.col("pos")).alias("new_text"))
    pairs = keyed.where("type = 'removed'").select(*hunk, "path_key", "pos", F.col("content").alias("old_text"), F.col("old_line").alias("no")).join(added, hunk)
    found = enclosing_type(pairs, symbols).withColumn("name", F.concat_ws(".", "parent", "prop"))
    return found.select(
        "analysis_id", "file_seq", F.lit(1).alias("kind"), F.col("hunk_seq").cast("long").alias("a"), F.col("pos").alias("b"), field_id(F.col("name")).alias("node_id"), "name", F.lit("type").alias("type"), "file_path",
        change_type(F.col("old_text"), F.col("new_text")).alias("change_type"), trim_ws(F.col("old_text")).alias("before"), trim_ws(F.col("new_text")).alias("after"),
    )


def _plain(symbols: DataFrame) -> DataFrame:
    return _placed(symbols.where(~F.col("type").isin(*STRUCTURAL_TYPES)))


def symbol_changes(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions, classes, variables and routes with touched lines; structural symbols have their own operators."""
    return _finish(_plain(symbols), _sides(lines, _plain(symbols).select(*SPAN), False), 2, F.col("id")).drop("digest")


def detect(lines: DataFrame, symbols: DataFrame, *, signatures: bool = False) -> DataFrame:
    """(analysis_id, change_seq, node_id, name, type, file_path, change_type, before, after), first of each (node, file, before, after).

    Changes are compared by digests of their texts, and the texts come to those that stay.
    `signatures` marks functions whose changed lines hold their signature as signature_changed.
    """
    stored, plain = _prisma_sides(lines, symbols), _sides(lines, _plain(symbols).select(*SPAN), False)
    typed = ts_field_changes(lines, symbols).withColumn("digest", _digest(F.col("before"), F.col("after")))
    every = _finish(_stored(symbols), stored, 0, field_id(F.col("name"))).unionByName(typed).unionByName(_finish(_plain(symbols), plain, 2, F.col("id"))).drop("before", "after")
    first = first_by(every, ["analysis_id", "node_id", "file_path", "digest"], "file_seq", "kind", "a", "b", "node_id")
    side = lambda df, before, after: df.select("analysis_id", F.nullif(before, F.lit("")).alias("before"), F.nullif(after, F.lit("")).alias("after"))
    texts = side(stored, "removed", "added").unionByName(side(typed, "before", "after")).unionByName(side(plain, "removed", "added"))
    texts = texts.groupBy("analysis_id", _digest(F.col("before"), F.col("after")).alias("digest")).agg(F.first("before").alias("before"), F.first("after").alias("after"))
    found = first.join(texts, ["analysis_id", "digest"], "left").drop("digest")
    if signatures:
        own = symbols.where(F.col("type").isin("function", "class", "api_route")).groupBy("analysis_id", F.col("id").alias("node_id")).agg(F.element_at(F.split(F.min_by("signature", "symbol_seq"), "\n"), 1).alias("_head"))
        found = found.join(own, ["analysis_id", "node_id"], "left")
        moved = F.col("change_type").isin("type_changed", "modified") & F.coalesce(F.col("after").contains(F.col("_head")) & ~F.coalesce(F.col("before"), F.lit("")).contains(F.col("_head")), F.lit(False))
        found = found.withColumn("change_type", F.when(moved, "signature_changed").otherwise(F.col("change_type"))).drop("_head")
    found = numbered(found, "change_seq", ["analysis_id"], "file_seq", "kind", "a", "b", "node_id")
    return found.select("analysis_id", "node_id", "name", "type", "file_path", "change_type", "before", "after", "change_seq")


def by_type(changes: DataFrame, *types: str) -> DataFrame:
    return changes.where(F.col("type").isin(*types))


def high_impact(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change_type").isin(*HIGH_IMPACT))


def dedupe_semantic(changes: DataFrame) -> DataFrame:
    """One change for each (name, before, after): the database declaration if any, at the place of the first."""
    place = ["analysis_id", F.col("name").alias("_name"), F.coalesce("before", F.lit("")).alias("_before"), F.coalesce("after", F.lit("")).alias("_after")]
    other = F.coalesce(F.col("type") != "database_field", F.lit(True))
    rest = [c for c in changes.columns if c not in ("analysis_id", "change_seq")]
    found = changes.groupBy(*place).agg(F.min_by(F.struct(*rest), F.struct(other.alias("other"), "change_seq")).alias("_c"), F.min("change_seq").alias("change_seq"))
    return found.select(*[F.col(f"_c.{c}").alias(c) if c in rest else F.col(c) for c in changes.columns])
