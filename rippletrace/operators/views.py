"""Datasets behind the views: cards, summaries, playback times and the drawn graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.exprs import percent, score_label
from rippletrace.functions.ordering import numbered, ordered_list, totals_before
from rippletrace.functions.shared import cut
from rippletrace.operators.graph import induced

MAX_NODES, SWEEPS, FAR = 60, 6, 5
COLUMN, ROW = 280, 110
STEP_MS, BETWEEN_MS, EVIDENCE_SHOWN = 850, 700, 4


def risk_cards(ranked: DataFrame) -> DataFrame:
    """What a card of each risk shows."""
    source = F.when(F.col("source") == "static", "Static").when(F.col("source") == "ai", "AI").otherwise("Hybrid")
    return ranked.select(
        "analysis_id", "rank", "severity", F.replace("category", F.lit("_"), F.lit(" ")).alias("category"), "title", "description", "score", "failure_path",
        F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, EVIDENCE_SHOWN).alias("evidence"), "suggested_fix", percent(F.col("confidence")).alias("percent"), source.alias("source_label"),
    )


def summary_cards(summary: DataFrame) -> DataFrame:
    return summary.withColumn("label", score_label(F.col("score")))


def playback(ranked: DataFrame, order: dict[str, Callable] | None = None) -> DataFrame:
    """(analysis_id, playback_seq, step, name, at_ms, is_last): when each step of each failure path lights up.

    `order` has columns with F.asc or F.desc: risks that are scored but not ranked are numbered here only.
    """
    order = order or {"rank": F.asc}
    kept = ranked.where(F.size("failure_path") >= 2).select("analysis_id", *order, "failure_path", F.size("failure_path").alias("steps"))
    kept = totals_before(kept, ["analysis_id"], [way(c) for c, way in order.items()], playback_seq=F.lit(1), begin=F.col("steps") * STEP_MS + BETWEEN_MS)
    rows = kept.select("analysis_id", (F.col("playback_seq") + 1).cast("int").alias("playback_seq"), "steps", "begin", F.posexplode("failure_path").alias("step", "name"))
    return rows.select("analysis_id", "playback_seq", "step", "name", (F.col("begin") + F.col("step") * STEP_MS).cast("long").alias("at_ms"), (F.col("step") == F.col("steps") - 1).alias("is_last"))


def step_state(step: Column, current: Column) -> Column:
    """How a step looks while `current` plays: earlier ones are active."""
    return F.when(step < current, "active").when(step == current, "current").otherwise("waiting")


#: Before every edge.
NEVER = -(2**63)


def _together(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def _improved(found: DataFrame, parts: list[DataFrame], value: str, leads: DataFrame | None = None) -> DataFrame:
    """Rows of `found` (analysis_id, id, value) whose value is less than all before; `parts` are put together when they are many.

    With `leads` (analysis_id, id), a row also says whether it is the first of its node and whether that node is one of these;
    later rows of the others are left out, as nothing follows from them.
    """
    if len(parts) > 8:
        parts[:] = [cut(_together(parts).groupBy("analysis_id", "id").agg(F.min(value).alias(value)))]
    known = _together([p.select("analysis_id", "id", value) for p in parts]).groupBy("analysis_id", "id").agg(F.min(value).alias("_known"))
    found = found.join(known, ["analysis_id", "id"], "left").where(F.col("_known").isNull() | (F.col(value) < F.col("_known")))
    if leads is not None:
        found = found.join(leads.withColumn("leads", F.lit(True)), ["analysis_id", "id"], "left").withColumns({"leads": F.coalesce("leads", F.lit(False)), "new": F.col("_known").isNull()}).where("leads OR new")
    return cut(found.drop("_known"))


def joining_times(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(analysis_id, id, joined): when each node joins the set that one sweep over the edges in order grows from the chosen nodes.

    An edge lets its ends join if one of them is inside when it is read. So a node joins at the least number
    of an edge whose other end joined before that edge; these minima are followed to
    their fixpoint, a written step for each hop. Chosen nodes have joined before every edge. Edges are written once; a step
    reads only those after the first that its nodes joined by.
    """
    edges = cut(edges.select("analysis_id", "source", "target", F.col("edge_seq").cast("long").alias("edge_seq")))
    both = lambda a, b: edges.select("analysis_id", F.col(a).alias("id"), F.col(b).alias("other"), "edge_seq")
    ends = both("source", "target").unionByName(both("target", "source"))
    level = cut(chosen.select("analysis_id", "id").distinct().withColumn("joined", F.lit(NEVER).cast("long")))
    parts = [level]
    while (first := level.agg(F.min("joined")).first()[0]) is not None:
        step = level.join(ends.where(F.col("edge_seq") > first), ["analysis_id", "id"]).where(F.col("edge_seq") > F.col("joined"))
        level = _improved(step.groupBy("analysis_id", F.col("other").alias("id")).agg(F.min("edge_seq").alias("joined")), parts, "joined")
        parts.append(level)
    return _together(parts).groupBy("analysis_id", "id").agg(F.min("joined").alias("joined"))


def neighbourhood(edges: DataFrame, chosen: DataFrame, *, exact: bool = False) -> DataFrame:
    """(analysis_id, id): chosen nodes and their neighbours; `exact`: all that join in the single growing sweep over the edges in order."""
    if exact:
        return joining_times(edges, chosen).select("analysis_id", "id")
    pairs = edges.select("analysis_id", F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select("analysis_id", F.col("target").alias("id"), F.col("source").alias("other")))
    near = pairs.join(chosen.select("analysis_id", "id").distinct(), ["analysis_id", "id"]).select("analysis_id", F.col("other").alias("id"))
    return chosen.select("analysis_id", "id").unionByName(near).distinct()


def shown_nodes(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """The first nodes, in node order, that are in the neighbourhood."""
    kept = nodes.join(near, ["analysis_id", "id"], "left_semi")
    return numbered(kept, "shown_seq", ["analysis_id"], "node_seq").where(F.col("shown_seq") <= MAX_NODES)


def upstream(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(analysis_id, id): the nodes and all that they depend on, over any number of edges; one written step for each."""
    links = edges.select("analysis_id", F.col("source").alias("id"), "target")
    seen = level = cut(ids.select("analysis_id", "id").distinct())
    while not level.isEmpty():
        step = cut(level.join(links, ["analysis_id", "id"]).select("analysis_id", F.col("target").alias("id")).distinct())
        known = seen.join(step, ["analysis_id", "id"], "left_semi")
        level = cut(step.join(known, ["analysis_id", "id"], "left_anti"))
        seen = seen.unionByName(level)
    return seen


def depths(edges: DataFrame, changed: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(analysis_id, id, depth): distance to a changed node as `SWEEPS` sweeps over the edges in order find it, each using what it found itself.

    Such sweeps find a path, read from the changed node, if its edge numbers fall at most `SWEEPS` - 1 times; the
    depth is the length of the shortest one found. A node may be reached by more edges but fewer falls, so each
    has labels (falls, last edge) that get less as depths grow; only a lesser label goes on. One written step for each depth.
    Edges are written once. A node that nothing depends on leads nowhere, so only its first label is kept.
    With `of` (analysis_id, id), depths are found for these nodes: they and what they depend on hold every path to them.
    """
    if of is not None:
        edges = edges.join(upstream(edges, of).withColumnRenamed("id", "source"), ["analysis_id", "source"], "left_semi")
    links = cut(edges.select("analysis_id", F.col("target").alias("id"), "source", F.col("edge_seq").cast("long").alias("edge_seq")))
    leads = cut(links.select("analysis_id", "id").distinct())
    level = changed.select("analysis_id", "id").distinct().withColumn("label", F.struct(F.lit(0).alias("falls"), F.lit(NEVER).cast("long").alias("edge")))
    found, parts, depth = [level.select("analysis_id", "id", F.lit(0).alias("depth"))], [level], 0
    while not level.isEmpty():
        depth += 1
        falls = F.col("label.falls") + (F.col("edge_seq") <= F.col("label.edge")).cast("int")
        step = level.join(links, ["analysis_id", "id"]).select("analysis_id", F.col("source").alias("id"), F.struct(falls.alias("falls"), F.col("edge_seq").alias("edge")).alias("label")).where(F.col("label.falls") < SWEEPS)
        kept = _improved(step.groupBy("analysis_id", "id").agg(F.min("label").alias("label")), parts, "label", leads)
        parts.append(kept.select("analysis_id", "id", "label"))
        found.append(kept.where("new").select("analysis_id", "id", F.lit(depth).alias("depth")))
        level = kept.where("leads")
    return _together(found)  # a node is new once


def layout(shown: DataFrame, depth: DataFrame, changed: DataFrame, affected: DataFrame) -> DataFrame:
    """Places and classes of drawn nodes: a column for each depth, rows in node order."""
    flag = lambda df, name: df.select("analysis_id", "id").distinct().withColumn(name, F.lit(True))
    rows = shown.join(depth, ["analysis_id", "id"], "left").join(flag(changed, "is_changed"), ["analysis_id", "id"], "left").join(flag(affected, "is_affected"), ["analysis_id", "id"], "left")
    rows = rows.withColumn("depth", F.coalesce("depth", F.lit(FAR)))
    at = F.row_number().over(Window.partitionBy("analysis_id", "depth").orderBy("node_seq")) - 1
    kind = F.when(F.coalesce("is_changed", F.lit(False)), "changed").when(F.coalesce("is_affected", F.lit(False)), "affected").otherwise("other")
    return rows.select("analysis_id", "id", "name", "depth", (F.col("depth") * COLUMN).alias("x"), (at * ROW).alias("y"), kind.alias("node_class"))


def drawn_edges(edges: DataFrame, shown: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges among drawn nodes, turned so that they point at what depends; animated where they leave a changed node."""
    kept = induced(edges, shown)
    hot = changed.select("analysis_id", F.col("id").alias("target")).distinct().withColumn("_hot", F.lit(True))
    kept = kept.join(hot, ["analysis_id", "target"], "left")
    return kept.select("analysis_id", "id", F.col("target").alias("source"), F.col("source").alias("target"), F.col("type").alias("label"), F.coalesce("_hot", F.lit(False)).alias("animated"))


def id_lists(changes: DataFrame, affected: DataFrame) -> DataFrame:
    """(analysis_id, changed_ids, affected_ids) in order."""
    c = changes.groupBy("analysis_id").agg(ordered_list(F.col("node_id"), "change_seq").alias("changed_ids"))
    a = affected.groupBy("analysis_id").agg(ordered_list(F.col("node_id"), "out_seq").alias("affected_ids"))
    return c.join(a, "analysis_id", "full")
