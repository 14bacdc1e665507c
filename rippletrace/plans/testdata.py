"""Star-schema and event tables as inputs of the engine's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippletrace.functions.ordering import ordered_list
from rippletrace.operators.graph import EDGE_META
from rippletrace.operators.rules import RISK_META

STAR = "star"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(table: str, *columns: str):
    return F.concat(F.lit(f"{table}:"), F.concat_ws("-", *columns))


def lineage_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analysis_id, node_seq, id, name, type, file_path): one node for each row of the star schema."""
    t = lambda name: read(spark, sf_dir, name)
    parts = [
        t("region").select(F.col("r_regionkey").cast("long").alias("node_seq"), _key("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("type")),
        t("nation").select((F.col("n_nationkey") + F.lit(1 << 40)).alias("node_seq"), _key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("type")),
        t("customer").select((F.col("c_custkey") + F.lit(2 << 40)).alias("node_seq"), _key("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("type")),
        t("supplier").select((F.col("s_suppkey") + F.lit(3 << 40)).alias("node_seq"), _key("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type")),
        t("part").select((F.col("p_partkey") + F.lit(4 << 40)).alias("node_seq"), _key("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("type")),
        t("orders").select((F.col("o_orderkey") + F.lit(5 << 40)).alias("node_seq"), _key("orders", "o_orderkey").alias("id"), _key("orders", "o_orderkey").alias("name"), F.lit("orders").alias("type")),
        t("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber") + F.lit(6 << 40)).alias("node_seq"), _key("lineitem", "l_orderkey", "l_linenumber").alias("id"), _key("lineitem", "l_orderkey", "l_linenumber").alias("name"), F.lit("lineitem").alias("type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(STAR).alias("analysis_id"), "*", F.concat("type", F.lit(".tbl")).alias("file_path"))


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analysis_id, edge_seq, id, source, target, type, metadata): rows depend on the rows their keys name."""
    t = lambda name: read(spark, sf_dir, name)
    item = t("lineitem").withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("s", _key("lineitem", "l_orderkey", "l_linenumber"))
    parts = [
        t("nation").select((F.col("n_nationkey") + F.lit(0)).cast("long").alias("edge_seq"), _key("nation", "n_nationkey").alias("source"), _key("region", "n_regionkey").alias("target")),
        t("customer").select((F.col("c_custkey") + F.lit(1 << 40)).alias("edge_seq"), _key("customer", "c_custkey").alias("source"), _key("nation", "c_nationkey").alias("target")),
        t("supplier").select((F.col("s_suppkey") + F.lit(2 << 40)).alias("edge_seq"), _key("supplier", "s_suppkey").alias("source"), _key("nation", "s_nationkey").alias("target")),
        t("orders").select((F.col("o_orderkey") + F.lit(3 << 40)).alias("edge_seq"), _key("orders", "o_orderkey").alias("source"), _key("customer", "o_custkey").alias("target")),
        item.select((F.col("k") + F.lit(4 << 40)).alias("edge_seq"), F.col("s").alias("source"), _key("orders", "l_orderkey").alias("target")),
        item.select((F.col("k") + F.lit(5 << 40)).alias("edge_seq"), F.col("s").alias("source"), _key("part", "l_partkey").alias("target")),
        item.select((F.col("k") + F.lit(6 << 40)).alias("edge_seq"), F.col("s").alias("source"), _key("supplier", "l_suppkey").alias("target")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(STAR).alias("analysis_id"), "edge_seq", F.concat("source", F.lit("->"), "target", F.lit(":depends_on")).alias("id"), "source", "target", F.lit("depends_on").alias("type"), F.lit(None).cast(EDGE_META).alias("metadata"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analysis_id, file_seq, path, content): a module for each nation, a file for each customer that uses it, a schema for each supplier."""
    n, c, s = (F.col(x).cast("string") for x in ("n_nationkey", "c_custkey", "s_suppkey"))
    home, call = F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 40).cast("string")
    file = lambda seq, path, *text: [F.lit("tree").alias("analysis_id"), F.col(seq).cast("int").alias("file_seq"), F.concat(*path).alias("path"), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]).alias("content")]
    modules = read(spark, sf_dir, "nation").select(*file("n_nationkey", (F.lit("src/n"), n, F.lit(".ts")), "export interface N", n, " {\n  label: string;\n}\nexport type A", n, " = {\n  size: number;\n};\nexport const g", n, " = () => {\n  return ", n, ";\n};\n"))
    users = read(spark, sf_dir, "customer").select(*file("c_custkey", (F.lit("src/c"), c, F.lit(".ts")), "import { N", home, " } from './n", home, "';\nexport function f", c, "(u: N", home, ") {\n  g", call, "();\n  return u.label.trim();\n}\nclass K", c, " {\n  run() {\n    return 1;\n  }\n}\n"))
    stored = read(spark, sf_dir, "supplier").select(*file("s_suppkey", (F.lit("db/s"), s, F.lit(".prisma")), "model M", s, " {\n  id Int @id\n  note String?\n}\n"))
    return modules.unionByName(users).unionByName(stored)


def region_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.lit(STAR).alias("analysis_id"), F.col("r_regionkey").alias("seed_seq"), _key("region", "r_regionkey").alias("seed"))


def event_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(analysis_id, diff): the events of each user as the diff of one file; a signup opens a hunk."""
    e = read(spark, sf_dir, "events")
    n = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("@@ -"), n, F.lit(",1 +"), n, F.lit(",2 @@")))
        .when(F.col("event_type") == "error", F.concat(F.lit("-e"), n))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("+p"), n))
        .otherwise(F.concat(F.lit(" c"), n))
    )
    u = F.col("user_id").cast("string")
    head = F.concat(F.lit("diff --git a/u"), u, F.lit(".ts b/u"), u, F.lit(".ts\n"), F.when(F.col("user_id") % 3 == 0, F.lit("new file mode 100644\n")).otherwise(F.lit("")), F.lit("--- a/u"), u, F.lit(".ts\n+++ b/u"), u, F.lit(".ts\n@@ -1,3 +1 @@\n"))
    grouped = e.groupBy("user_id").agg(F.array_join(ordered_list(line, "event_id"), "\n").alias("body"))
    return grouped.select(u.alias("analysis_id"), F.concat(head, F.col("body")).alias("diff"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes from events in order of each user: before and after are the values of successive events."""
    e = read(spark, sf_dir, "events")
    by = Window.partitionBy("user_id").orderBy("event_id")
    text = F.when(F.col("event_type") == "error", F.lit("")).when(F.col("event_type") == "purchase", F.concat(F.lit("v: "), F.col("event_id") % 7)).otherwise(F.concat(F.lit("v "), (F.col("event_id") % 5).cast("string")))
    kinds = F.when(F.col("event_type") == "click", "function").when(F.col("event_type") == "view", "database_field").when(F.col("event_type") == "signup", "variable").otherwise("type")
    rows = e.withColumn("after", text).withColumn("before", F.lag("after").over(by)).withColumn("change_seq", F.row_number().over(by))
    return rows.select(F.col("user_id").cast("string").alias("analysis_id"), "change_seq", F.concat(F.lit("field:f"), (F.col("event_id") % 3).cast("string")).alias("node_id"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("name"), kinds.alias("type"), F.concat("event_type", F.lit(".ts")).alias("file_path"), "before", "after")


def part_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a changed field; its size decides how it changed."""
    p, size = read(spark, sf_dir, "part"), F.col("p_size")
    after = F.when(size % 4 == 0, F.concat("p_type", F.lit("?"))).when(size % 4 == 2, F.lit(None).cast("string")).otherwise(F.col("p_type"))
    kind = F.when(size % 4 == 0, "type_changed").when(size % 4 == 2, "deleted").when(size % 4 == 1, "signature_changed").otherwise("modified")
    return p.select(F.lit(STAR).alias("analysis_id"), F.col("p_partkey").cast("int").alias("change_seq"), _key("part", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.lit("database_field").alias("type"), F.lit("part.tbl").alias("file_path"), kind.alias("change_type"), F.col("p_type").alias("before"), after.alias("after"))


def usage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as uses of part fields by suppliers; the line number decides the kind of use."""
    l, n = read(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("l_orderkey") % len(names) + 1).cast("int"))
    kind = F.when(n % 4 == 0, F.lit(None).cast("string")).when(n % 4 == 1, "method_call").when(n % 4 == 2, "argument").otherwise("property_access")
    method = F.when(n % 4 == 1, pick("trim", "push", "split"))
    callee = F.when(n % 4 == 2, pick("send", "store"))
    meta = F.struct(F.lit(None).cast("int").alias("line"), kind.alias("usage_kind"), method.alias("method"), callee.alias("callee"), F.lit(None).cast("string").alias("expression"), F.lit(None).cast("string").alias("field")).cast(EDGE_META)
    return l.select(F.lit(STAR).alias("analysis_id"), (((F.col("l_orderkey") * 8 + n) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("edge_seq"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), _key("supplier", "l_suppkey").alias("source"), _key("part", "l_partkey").alias("target"), F.when(n % 4 == 0, "calls").otherwise("uses_field").alias("type"), meta.alias("metadata"))


def item_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders as risks, one analysis for each order priority."""
    i, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    n = F.col("l_linenumber")
    pick = lambda value, *names: F.element_at(F.array(*map(F.lit, names)), (value % len(names) + 1).cast("int"))
    rows = i.join(o, i["l_orderkey"] == o["o_orderkey"])
    s = F.lit(None).cast("string")
    return rows.select(
        F.col("o_orderpriority").alias("analysis_id"), (((F.col("l_orderkey") * 8 + n) * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("risk_seq"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.concat(F.lit(" Risk of "), F.col("l_returnflag"), F.col("l_linestatus")).alias("title"), F.lit("d").alias("description"),
        pick(F.col("l_partkey"), "security", "runtime", "type", "dependency", "performance", "other").alias("category"), pick(F.col("l_suppkey"), "critical", "high", "medium", "low").alias("severity"),
        F.when(n == 1, F.col("l_discount") * 1000).otherwise(F.col("l_discount") * 10).alias("confidence"), pick(n, "static", "ai", "hybrid", "manual").alias("source"),
        F.when(n % 2 == 0, F.concat(F.lit("part:"), (F.col("l_partkey") % 20).cast("string"))).alias("changed_node_id"), F.concat(F.lit("supplier:"), (F.col("l_suppkey") % 10).cast("string")).alias("affected_node_id"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("changed_symbol"), F.lit("s").alias("affected_symbol"), F.lit("f.ts").alias("file_path"), F.lit(None).cast("int").alias("line"),
        F.when(n < 7, n).alias("dependency_depth"), F.when(n > 1, F.array(F.lit("a"), F.col("l_returnflag"), F.col("l_linestatus"))).otherwise(F.array(F.lit("a"))).alias("failure_path"),
        F.array(F.col("l_returnflag"), F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string"))).alias("evidence"), s.alias("suggested_fix"), F.lit(None).cast(RISK_META).alias("metadata"),
    )


def text_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states (analysis_id, path, content) of each document as a file of its own analysis.

    The number of a document decides whether it is only in the first state, only in the second, moved
    as it is, moved and edited, or edited: lines by their places are dropped, changed and added.
    """
    n = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select(n, F.concat(F.lit("d"), n.cast("string")).alias("analysis_id"), F.concat(F.lit("t/"), n.cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    edit = lambda line, i: F.when((i + n) % 7 == 3, F.array().cast("array<string>")).otherwise(F.array(F.when((i + n) % 5 == 2, F.concat(line, F.lit("!"))).otherwise(line)))
    more = lambda i: F.when((i + n) % 11 == 4, F.array(F.concat(F.lit("new "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    lines = F.flatten(F.transform(F.split("content", "\n"), lambda line, i: F.concat(edit(line, i), more(i))))
    moved = F.concat(F.lit("moved/"), n.cast("string"), F.lit(".txt"))
    head = docs.where(n % 13 != 5).select("analysis_id", F.when((n % 13).isin(7, 8), moved).otherwise(F.col("path")).alias("path"), F.when(n % 13 == 7, F.col("content")).otherwise(F.array_join(lines, "\n")).alias("content"))
    return docs.where(n % 13 != 6).select("analysis_id", "path", "content"), head


def order_commits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(commits, pairs): the orders of each customer as a history that forks and joins, and its last two orders."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("analysis_id"), F.col("o_orderkey").cast("string").alias("commit"), *(F.lag(F.col("o_orderkey").cast("string"), k).over(by).alias(f"p{k}") for k in (1, 2, 3)), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))).alias("age"), "o_orderkey")
    parents = F.when(F.col("o_orderkey") % 3 == 0, F.array("p1", "p3")).when(F.col("o_orderkey") % 3 == 1, F.array("p2")).otherwise(F.array("p1"))
    pairs = o.where("age <= 2").groupBy("analysis_id").agg(F.min_by("commit", "age").alias("base"), F.max_by("commit", "age").alias("head"))
    return o.select("analysis_id", "commit", F.array_compact(parents).alias("parents")), pairs
