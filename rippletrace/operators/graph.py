"""The dependency graph: nodes, contains, imports, calls and uses_field edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.exprs import clean_callee, dirname, edge_id, field_id, join_path, normal_path, symbol_id, without_extension
from rippletrace.functions.ordering import first_by, numbered, numbered_widely
from rippletrace.operators.usage import interface_fields, with_usages
from rippletrace.schemas import SYMBOL_META

EDGE_META = "struct<line:int,usage_kind:string,method:string,callee:string,expression:string,field:string>"
LOCATION = "struct<file_path:string,start_line:int,end_line:int>"
NODE_META = "struct<model:string,field:string,field_type:string,nullable:boolean,attributes:string,semantic_field:boolean,parent_type:string>"


def sequence_symbols(ts: DataFrame, prisma: DataFrame) -> DataFrame:
    """All symbols in order: TypeScript files first, then Prisma files; numbered over ranges and written once, as edges read them several times."""
    both = ts.withColumn("src_rank", F.lit(0)).unionByName(prisma.withColumn("src_rank", F.lit(1)))
    return numbered_widely(both, "symbol_seq", ["analysis_id"], "src_rank", "file_seq", "kind_rank", "pos").drop("src_rank", "file_seq", "kind_rank", "pos")


def sequence_files(files: DataFrame) -> DataFrame:
    """Files in the order in which the graph sees them: TypeScript first, then Prisma."""
    return numbered(files.withColumn("_prisma", F.col("path").endswith(".prisma").cast("int")), "file_rank", ["analysis_id"], "_prisma", "file_seq").drop("_prisma")


def field_declarations(symbols: DataFrame) -> DataFrame:
    """Field nodes before dedupe: properties of interfaces and type aliases, and database fields, in symbol order."""
    typed = interface_fields(symbols).select("analysis_id", "symbol_seq", "pos", F.col("field").alias("field_name"), F.lit("type").alias("type"), "file_path", F.col("name").alias("parent_type"), F.lit(None).cast(SYMBOL_META).alias("metadata"))
    stored = symbols.where("type = 'database_field'").select("analysis_id", "symbol_seq", F.lit(-1).alias("pos"), F.col("name").alias("field_name"), "type", "file_path", F.lit(None).cast("string").alias("parent_type"), "metadata")
    return typed.unionByName(stored)


def nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(analysis_id, node_seq, id, name, type, file_path, location, metadata); the first of each id stays.

    Order: each file and its symbols, file by file, then fields in symbol order.
    """
    def meta(semantic, parent):
        return F.struct(*[F.col(f"metadata.{f}").alias(f) for f in ("model", "field", "field_type", "nullable", "attributes")], semantic.alias("semantic_field"), parent.alias("parent_type")).cast(NODE_META)

    order = lambda g, a, b, c: [F.lit(g).alias("g"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("int").alias("c")]
    zero, nowhere, none = F.lit(0), F.lit(None).cast(LOCATION).alias("location"), F.lit(None)
    path = F.col("path")
    file_nodes = files.select("analysis_id", *order(0, F.col("file_rank"), zero, zero), symbol_id(path, F.lit("file"), path).alias("id"), path.alias("name"), F.lit("file").alias("type"), path.alias("file_path"), nowhere, none.cast(NODE_META).alias("metadata"))
    rank = files.select("analysis_id", path.alias("file_path"), "file_rank")
    own = F.when(F.col("metadata").isNotNull(), meta(none.cast("boolean"), none.cast("string"))).alias("metadata")
    place = F.struct("file_path", "start_line", "end_line").cast(LOCATION).alias("location")
    symbol_nodes = symbols.join(rank, ["analysis_id", "file_path"]).select("analysis_id", *order(0, F.col("file_rank"), F.col("symbol_seq"), zero), "id", "name", "type", "file_path", place, own)
    fields = field_declarations(symbols)
    field_nodes = fields.select("analysis_id", *order(1, zero, F.col("symbol_seq"), F.col("pos")), field_id(F.col("field_name")).alias("id"), F.col("field_name").alias("name"), "type", "file_path", nowhere, meta(F.lit(True), F.col("parent_type")).alias("metadata"))
    every = file_nodes.unionByName(symbol_nodes).unionByName(field_nodes)
    return numbered(first_by(every, ["analysis_id", "id"], "g", "a", "b", "c"), "node_seq", ["analysis_id"], "g", "a", "b", "c").drop("g", "a", "b", "c")


def resolve_imports(files: DataFrame, imports: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(analysis_id, file_path, import_seq, line, target_path): relative imports and the first file that they can mean.

    `aliases` maps prefixes such as `@/` to folders; without it such imports stay unresolved.
    """
    source = F.col("source")
    for prefix, folder in (aliases or {}).items():
        source = F.when(source.startswith(prefix), F.concat(F.lit("./"), F.lit(folder), F.substring(source, len(prefix) + 1, 2**31 - 1))).otherwise(source)
    aliased = F.lit(False)
    for prefix in aliases or {}:
        aliased = aliased | F.col("source").startswith(prefix)
    wanted = imports.withColumn("_s", source).where(F.col("_s").startswith("."))
    wanted = wanted.withColumn("wanted", normal_path(join_path(F.when(aliased, F.lit(".")).otherwise(dirname(F.col("file_path"))), F.col("_s"))))
    path = normal_path(F.col("path"))
    bare = without_extension(path)
    keys = F.array_distinct(F.array(path, bare, F.when(bare.endswith("/index"), F.regexp_replace(bare, "/index$", "")).otherwise(bare)))
    known = files.select("analysis_id", F.explode(keys).alias("wanted"), F.col("path").alias("target_path"), "file_rank")
    known = known.groupBy("analysis_id", "wanted").agg(F.min_by("target_path", "file_rank").alias("target_path"))
    return wanted.join(known, ["analysis_id", "wanted"]).select("analysis_id", "file_path", "import_seq", "line", "target_path")


def resolve_calls(symbols: DataFrame) -> DataFrame:
    """(analysis_id, symbol_seq, source, call_seq, line, target): calls whose last name is some symbol's name."""
    calls = symbols.select("analysis_id", "symbol_seq", F.col("id").alias("source"), F.posexplode("calls").alias("call_seq", "call"))
    calls = calls.select("analysis_id", "symbol_seq", "source", "call_seq", F.col("call.line").alias("line"), clean_callee(F.col("call.name")).alias("name"))
    first = symbols.groupBy("analysis_id", "name").agg(F.min_by("id", "symbol_seq").alias("target"))
    return calls.join(first, ["analysis_id", "name"]).drop("name")


def edges(files: DataFrame, imports: DataFrame, symbols: DataFrame, found_nodes: DataFrame, *, aliases: dict[str, str] | None = None) -> DataFrame:
    """(analysis_id, edge_seq, id, source, target, type, metadata); self-loops go, the first of each id stays."""
    file_node = lambda p: symbol_id(p, F.lit("file"), p)
    rank = files.select("analysis_id", F.col("path").alias("file_path"), "file_rank")
    none = F.lit(None).cast("string")

    def shaped(df, group, a, b, source, target, kind, line=None, usage=None, id_=None):
        u = (lambda f: F.col(f"{usage}.{f}")) if usage else (lambda f: none)
        meta = F.struct((F.lit(None) if line is None else line).cast("int").alias("line"), u("kind").alias("usage_kind"), u("method").alias("method"), u("callee").alias("callee"), u("expression").alias("expression"), u("field").alias("field")).cast(EDGE_META)
        kind = F.lit(kind)
        return df.select("analysis_id", F.lit(group).alias("g"), a.cast("long").alias("a"), b.cast("int").alias("b"), (edge_id(source, target, kind) if id_ is None else id_).alias("id"), source.alias("source"), target.alias("target"), kind.alias("type"), meta.alias("metadata"))

    contains = shaped(symbols, 0, F.col("symbol_seq"), F.lit(0), file_node(F.col("file_path")), F.col("id"), "contains")
    resolved = resolve_imports(files, imports, aliases).join(rank, ["analysis_id", "file_path"])
    imported = shaped(resolved, 1, F.col("file_rank"), F.col("import_seq"), file_node(F.col("file_path")), file_node(F.col("target_path")), "imports", F.col("line"))
    called = shaped(resolve_calls(symbols), 2, F.col("symbol_seq"), F.col("call_seq"), F.col("source"), F.col("target"), "calls", F.col("line"))
    used = with_usages(symbols).select("analysis_id", "symbol_seq", F.col("id").alias("source"), F.posexplode("usages").alias("pos", "u"))
    used = used.withColumn("target", field_id(F.col("u.field")))
    fields = found_nodes.where(F.col("id").startswith("field:")).select("analysis_id", F.col("id").alias("target"))
    used = used.join(fields, ["analysis_id", "target"], "left_semi")
    suffix = F.concat_ws(":", F.col("u.kind"), F.coalesce("u.method", "u.callee", F.lit("access")))
    uses = shaped(used, 3, F.col("symbol_seq"), F.col("pos"), F.col("source"), F.col("target"), "uses_field", None, "u", F.concat(edge_id(F.col("source"), F.col("target"), F.lit("uses_field")), F.lit(":"), suffix))
    every = contains.unionByName(imported).unionByName(called).unionByName(uses)
    return numbered(dedupe_edges(every, "g", "a", "b"), "edge_seq", ["analysis_id"], "g", "a", "b").drop("g", "a", "b")


def dedupe_edges(found: DataFrame, *order: str) -> DataFrame:
    """Edges without self-loops, the first of each id."""
    return first_by(found.where("source <> target"), ["analysis_id", "id"], *order)


def induced(found_edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among `chosen` (analysis_id, id)."""
    ends = lambda name: chosen.select("analysis_id", F.col("id").alias(name)).distinct()
    return found_edges.join(ends("source"), ["analysis_id", "source"], "left_semi").join(ends("target"), ["analysis_id", "target"], "left_semi")


def lookup_nodes(ids: DataFrame, found_nodes: DataFrame) -> DataFrame:
    """`ids` (analysis_id, id) with their nodes; unknown ids drop out."""
    return ids.join(found_nodes, ["analysis_id", "id"])


def direct_dependents(found_edges: DataFrame, found_nodes: DataFrame, targets: DataFrame, *, rows_per_edge: bool = False) -> DataFrame:
    """Nodes that depend directly on `targets` (analysis_id, target); each once, or one row for each edge."""
    hit = found_edges.join(targets, ["analysis_id", "target"]).select("analysis_id", "target", "edge_seq", F.col("source").alias("id"))
    if rows_per_edge:
        return hit.join(found_nodes, ["analysis_id", "id"])
    return hit.select("analysis_id", "target", "id").distinct().join(found_nodes, ["analysis_id", "id"])


def find_symbols(symbols: DataFrame, key: str, wanted: DataFrame, *, every: bool = False) -> DataFrame:
    """Symbols whose `key` (id or name) is in `wanted`; the first in order, or all."""
    hit = symbols.join(wanted.select("analysis_id", key).distinct(), ["analysis_id", key])
    return hit if every else first_by(hit, ["analysis_id", key], "symbol_seq")
