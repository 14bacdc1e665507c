"""Bounded reverse traversal of dependency graphs, all seeds at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.ordering import numbered_widely
from rippletrace.functions.shared import cut, discard, size_of

MAX_DEPTH = 4
#: Edges of more bytes than this are joined in slices, each of all keys of one hash, so what is shuffled at once is a share; that many slices at most, as each reads its inputs again.
SLICE, SLICES = 1 << 28, 4
#: What the planner says of tables whose size it cannot tell.
UNKNOWN = 1 << 60


def _links(edges: DataFrame, nodes: DataFrame | None, slices: int) -> DataFrame:
    """(analysis_id, at, source, edge_seq): written once where they were joined with the nodes."""
    links = edges.select("analysis_id", F.col("target").alias("at"), "source", F.col("edge_seq").cast("long").alias("edge_seq"))
    if nodes is None:
        return links
    known = nodes.select("analysis_id", F.col("id").alias("source"))
    return cut(*[some[0].join(some[1], ["analysis_id", "source"], "left_semi").select(links.columns) for some in _sliced(slices, "source", links, known)])


def _slices(edges: DataFrame) -> int:
    size = size_of(edges)
    return 1 if size > UNKNOWN else min(size // SLICE + 1, SLICES)


def _sliced(slices: int, key: str, *tables: DataFrame) -> list[list[DataFrame]]:
    """The tables by slices of a key."""
    return [[t if slices == 1 else t.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k) for t in tables] for k in range(slices)]


def _joined(level: DataFrame, links: DataFrame, slices: int) -> DataFrame:
    """Where a level leads; written, where it took several slices."""
    parts = [at.join(out, ["analysis_id", "at"]).drop("at") for at, out in _sliced(slices, "at", level, links)]
    return parts[0] if slices == 1 else cut(*parts)


def _start(seeds: DataFrame) -> DataFrame:
    none = F.array().cast("array<bigint>")
    return seeds.select("analysis_id", "seed_seq", F.col("seed").alias("node_id"), F.array().cast("array<string>").alias("way"), none.alias("order_key"))


def dependents(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, nodes: DataFrame | None = None, *, paths: bool = True) -> DataFrame:
    """(analysis_id, seed_seq, seed, node_id, depth, path, order_key) of all that reaches a seed within `max_depth` edges.

    `seeds` has (analysis_id, seed_seq, seed); with `nodes`, edges from unknown
    nodes lead nowhere. Breadth first: among parents of one level the earlier one
    wins, then the earlier edge. `order_key` is the list of edge numbers along the
    path; within a level its order is discovery order, so no level is ever
    numbered and the best arrival is a plain minimum. A level holds the way to a node
    without the node (without `paths` its seed only, and there is no path in the result).
    """
    slices = _slices(edges)
    links, level = _links(edges, nodes, slices), _start(seeds)
    seen, levels = level, []
    for depth in range(1, max_depth + 1):
        way = F.array("node_id") if depth == 1 else F.array_append("way", F.col("node_id")) if paths else F.col("way")
        step = _joined(level.select("analysis_id", "seed_seq", F.col("node_id").alias("at"), way.alias("way"), "order_key"), links, slices)
        found = []
        for new, old in _sliced(slices, "node_id", step.withColumnRenamed("source", "node_id"), seen.select("analysis_id", "seed_seq", "node_id")):
            new = new.select("analysis_id", "seed_seq", "node_id", F.struct(F.array_append("order_key", F.col("edge_seq")).alias("order_key"), "way").alias("b"))
            new = new.join(old, ["analysis_id", "seed_seq", "node_id"], "left_anti").groupBy("analysis_id", "seed_seq", "node_id").agg(F.min("b").alias("b"))
            found.append(new.select("analysis_id", "seed_seq", "node_id", "b.way", "b.order_key"))
        level = cut(*found) if depth < max_depth or slices > 1 else found[0]
        if depth < max_depth:
            seen = seen.unionByName(level)
        if slices > 1:
            discard(step)
        levels.append(level.withColumn("depth", F.lit(depth)))
    if slices > 1 and nodes is not None:
        discard(links)
    done = levels[0]
    for found in levels[1:]:
        done = done.unionByName(found)
    path = [F.array_append("way", F.col("node_id")).alias("path")] if paths else []
    return done.select("analysis_id", "seed_seq", F.col("way")[0].alias("seed"), "node_id", "depth", *path, "order_key")


def _radius(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int, *, paths: bool) -> tuple[DataFrame, DataFrame]:
    """(seeds that are nodes, what reaches them)."""
    known = seeds.join(nodes.select("analysis_id", F.col("id").alias("seed")), ["analysis_id", "seed"], "left_semi")
    return known.select("analysis_id", "seed_seq", "seed"), dependents(edges, known, max_depth, nodes, paths=paths).drop("seed")


def blast_radius(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(analysis_id, seed_seq, seed, position, node_id, depth, path): one row for each node in the radius of each seed that is a node.

    A seed without dependents has one row, with null node and position; `radius_totals` sums up without numbering the rows.
    """
    known, found = _radius(edges, nodes, seeds, max_depth, paths=True)
    placed = numbered_widely(found, "position", ["analysis_id", "seed_seq"], "depth", "order_key").drop("order_key")
    return known.join(placed, ["analysis_id", "seed_seq"], "left").select("analysis_id", "seed_seq", "seed", "position", "node_id", "depth", "path")


def radius_totals(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(analysis_id, seed_seq, seed, total_affected, first, last): nodes in each radius, the first and the last of them; one grouping."""
    known, found = _radius(edges, nodes, seeds, max_depth, paths=False)
    at = F.struct("depth", "order_key")
    totals = found.groupBy("analysis_id", "seed_seq").agg(F.count(F.lit(1)).alias("total_affected"), F.min_by("node_id", at).alias("first"), F.max_by("node_id", at).alias("last"))
    out = known.join(totals, ["analysis_id", "seed_seq"], "left")
    return out.select("analysis_id", "seed_seq", "seed", F.coalesce("total_affected", F.lit(0)).cast("long").alias("total_affected"), "first", "last")


def combine(found: DataFrame) -> DataFrame:
    """(analysis_id, out_seq, node_id, depth, path, seed): each node once, at its least depth; the earlier seed wins ties.

    Order: depth, then first appearance over all seeds in order.
    """
    won = found.groupBy("analysis_id", "node_id").agg(F.min(F.struct("depth", "seed_seq", "seed", "path")).alias("w"), F.min(F.struct("seed_seq", "depth", "order_key")).alias("first"))
    won = won.select("analysis_id", "node_id", F.col("w.depth").alias("depth"), F.col("w.path").alias("path"), F.col("w.seed").alias("seed"), "first")
    out = numbered_widely(won, "out_seq", ["analysis_id"], "depth", F.col("first.seed_seq"), F.col("first.depth"), F.col("first.order_key"))
    return out.select("analysis_id", "out_seq", "node_id", "depth", "path", "seed")


def combined(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, nodes: DataFrame | None = None) -> DataFrame:
    """The rows of `combine(dependents(...))`, by few arrivals at each node instead of one for each seed that reaches it.

    A row is made of a node's nearest arrival (of the earlier seed) and of its earliest seed's. An arrival after one of an earlier
    seed is neither, and where it leads the earlier seed comes too, as near. So a level keeps the earliest seed of each node, if none that
    is earlier came before, and goes on only from nodes with dependents. The earlier seed misses one node, its own: if one comes back
    there, all radii are found in full.
    """
    slices = _slices(edges)
    links, level, found = _links(edges, nodes, slices), _start(seeds), []
    none = lambda *names: [F.lit(None).cast(kind).alias(name) for name, kind in names]
    kind = level.schema["seed_seq"].dataType
    targets = cut(*[some[0].distinct() for some in _sliced(slices, "node_id", links.select("analysis_id", F.col("at").alias("node_id")))])
    own, before, leads = ("own", kind), ("before", kind), ("leads", "boolean")
    marks = seeds.select("analysis_id", F.col("seed").alias("node_id"), F.col("seed_seq").alias("own"), *none(before, leads))
    marks = marks.unionByName(targets.select("analysis_id", "node_id", *none(own, before), F.lit(True).alias("leads")))
    for depth in range(1, max_depth + 1):
        step = _joined(level.select("analysis_id", "seed_seq", F.col("node_id").alias("at"), F.array_append("way", F.col("node_id")).alias("way"), "order_key"), links, slices)
        best = F.struct("seed_seq", F.array_append("order_key", F.col("edge_seq")).alias("order_key"), "way")
        new = step.select("analysis_id", F.col("source").alias("node_id"), best.alias("b"), *none(own, before, leads))
        new = new.unionByName(marks.withColumn("b", F.lit(None).cast(new.schema["b"].dataType)))
        home, on = F.col("b.seed_seq").between(F.col("own"), F.col("last_own")), F.col("own").isNull() | (F.col("b.seed_seq") < F.col("own"))
        parts = []
        for (some,) in _sliced(slices, "node_id", new):
            some = some.groupBy("analysis_id", "node_id").agg(F.min("b").alias("b"), F.min("own").alias("own"), F.max("own").alias("last_own"), F.min("before").alias("before"), F.max("leads").alias("leads"))
            some = some.where("b IS NOT NULL AND (before IS NULL OR b.seed_seq < before)")
            parts.append(some.select("analysis_id", "node_id", "b.*", F.lit(depth).alias("depth"), F.col("before").isNotNull().alias("again"), F.coalesce(home, F.lit(False)).alias("home"), (F.coalesce("leads", F.lit(False)) & on).alias("leads")))
        level = cut(*parts)
        if slices > 1:
            discard(step)
        if not level.where("home").isEmpty():
            discard(targets, level, *found)
            return combine(dependents(edges, seeds, max_depth, nodes))
        found.append(level)
        marks = marks.unionByName(level.select("analysis_id", "node_id", *none(own), F.col("seed_seq").alias("before"), *none(leads)))
        level = level.where("leads")
        if level.isEmpty():
            break
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    won, again, first = rows.where("NOT again"), rows.where("again"), F.struct("seed_seq", "depth", "order_key")
    if again.isEmpty():
        won = won.withColumn("first", F.when(F.lit(False), first))
    else:
        won = won.join(again.groupBy("analysis_id", "node_id").agg(F.min(first).alias("first")), ["analysis_id", "node_id"], "left")
    won = won.select("analysis_id", "node_id", "depth", "seed_seq", "way", "order_key", "first")
    at = lambda name: F.coalesce(F.col(f"first.{name}"), F.col(name))
    out = numbered_widely(won, "out_seq", ["analysis_id"], "depth", at("seed_seq"), at("depth"), at("order_key"))
    return out.select("analysis_id", "out_seq", "node_id", "depth", F.array_append("way", F.col("node_id")).alias("path"), F.col("way")[0].alias("seed"))
