"""Breakage rules: changes joined with the edges that depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.exprs import became_nullable, is_dangerous_method
from rippletrace.functions.ordering import numbered_widely
from rippletrace.operators.changes import dedupe_semantic

RISK_META = "struct<reason:string>"
RISK_COLUMNS = (
    "analysis_id", "id", "title", "description", "category", "severity", "confidence", "source", "changed_node_id", "affected_node_id", "changed_symbol",
    "affected_symbol", "file_path", "line", "dependency_depth", "failure_path", "evidence", "suggested_fix", "metadata",
)


def _text(template: str) -> Column:
    """{c}: the changed symbol, {a}: the affected one, {m}: method, {f}: callee, {e}: expression, {b}, {n}: before and after."""
    names = {"c": F.col("c.name"), "a": F.col("n.name"), "m": F.col("method"), "f": F.col("callee"), "e": F.col("expression"), "b": F.coalesce("c.before", F.lit("unknown")), "n": F.coalesce("c.after", F.lit("unknown"))}
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if brace:
            parts.append(names[tail[0]])
            rest = tail[2:]
        else:
            rest = ""
    return F.concat(*parts)


#: name: (category, severity, confidence, title, description, evidence, fix, last step of the failure path)
_RULES = {
    "method": ("runtime", "critical", 0.99, "Null may be dereferenced in {a}", "{a} calls {m}() on {c}, which may now be null, so the call can throw.", ("{c} was required and is now nullable.", "{a} runs {e}.", "{m}() fails on a null value."), "Test {c} for null before {m}(), or handle its absence in {a}.", "{e}"),
    "argument": ("type", "high", 0.94, "{f} may receive a null value", "{a} hands {c} to {f} although it may now be null.", ("{c} was required and is now nullable.", "{a} has {e}."), "Test {c} before the call of {f}, or let {f} accept null.", "{f}"),
    "access": ("business_logic", "medium", 0.78, "{a} reads {c}, now nullable", "{a} reads {c} directly, and it may now be null.", ("{c} was required and is now nullable.", "{a} refers to the field."), "Check what {a} does when {c} is null.", None),
    "deleted": ("dependency", "critical", 0.99, "{a} needs {c}, now deleted", "{c} is gone, and {a} still depends on it.", ("{c} was deleted.", "{a} keeps a dependency on it."), "Take the dependency on {c} out of {a}, or replace it.", None),
    "signature": ("api_breaking_change", "high", 0.94, "{a} may call {c} by its old signature", "The signature of {c} changed, and {a} calls it.", ("Before: {b}", "After: {n}"), "Bring the call of {c} in {a} in line with the new signature.", None),
}


def _risks(joined: DataFrame, rule: str, id_prefix: Column) -> DataFrame:
    category, severity, confidence, title, description, evidence, fix, last = _RULES[rule]
    path = [F.col("c.name"), F.col("n.name")] + ([_text(last)] if last else [])
    return joined.select(
        F.col("c.analysis_id").alias("analysis_id"), F.col("c.change_seq").alias("change_seq"), F.col("e.edge_seq").alias("edge_seq"),
        F.concat_ws(":", F.lit("static"), id_prefix, F.col("c.node_id"), F.col("n.id")).alias("id"), _text(title).alias("title"), _text(description).alias("description"),
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit("static").alias("source"),
        F.col("c.node_id").alias("changed_node_id"), F.col("n.id").alias("affected_node_id"), F.col("c.name").alias("changed_symbol"), F.col("n.name").alias("affected_symbol"),
        F.col("n.file_path").alias("file_path"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("dependency_depth"), F.array(*path).alias("failure_path"),
        F.array(*map(_text, evidence)).alias("evidence"), _text(fix).alias("suggested_fix"), F.lit(None).cast(RISK_META).alias("metadata"),
    )


def _joined(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each change with the edges that end in it and the nodes these start from."""
    c, e, n = changes.alias("c"), edges.alias("e"), nodes.alias("n")
    hit = c.join(e, (F.col("c.analysis_id") == F.col("e.analysis_id")) & (F.col("c.node_id") == F.col("e.target")))
    hit = hit.join(n, (F.col("e.analysis_id") == F.col("n.analysis_id")) & (F.col("e.source") == F.col("n.id")))
    meta = "e.metadata"
    method, callee, expression = (F.col(f"{meta}.{x}") for x in ("method", "callee", "expression"))
    default = F.when(method.isNotNull(), F.concat(F.col("c.name"), F.lit("."), method, F.lit("()"))).otherwise(F.concat(callee, F.lit("("), F.col("c.name"), F.lit(")")))
    return hit.withColumn("usage_kind", F.col(f"{meta}.usage_kind")).withColumn("method", method).withColumn("callee", callee).withColumn("expression", F.coalesce(expression, default))


def usage_edges(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'uses_field'")


def nullable_method(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A dangerous method is called on a field that became nullable; other methods yield nothing."""
    hit = _joined(changes.where(became_nullable(F.col("before"), F.col("after"))), usage_edges(edges), nodes).where((F.col("usage_kind") == "method_call") & is_dangerous_method(F.col("method")))
    return _risks(hit, "method", F.concat(F.lit("nullable-method-"), F.col("method")))


def nullable_argument(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    hit = _joined(changes.where(became_nullable(F.col("before"), F.col("after"))), usage_edges(edges), nodes).where((F.col("usage_kind") == "argument") & F.col("callee").isNotNull())
    return _risks(hit, "argument", F.concat(F.lit("nullable-argument-"), F.col("callee")))


def nullable_access(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    hit = _joined(changes.where(became_nullable(F.col("before"), F.col("after"))), usage_edges(edges), nodes).where("usage_kind = 'property_access'")
    return _risks(hit, "access", F.lit("nullable-property-access"))


def deleted_symbol(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _risks(_joined(changes.where("change_type = 'deleted'"), edges, nodes), "deleted", F.lit("deleted-symbol"))


def signature_change(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _risks(_joined(changes.where("change_type = 'signature_changed'"), edges.where("type = 'calls'"), nodes), "signature", F.lit("signature-change"))


def dedupe_rule_risks(risks: DataFrame, *order: str) -> DataFrame:
    """The most confident risk of each (category, changed, affected, title); the first on ties, at the place of the first."""
    group = ("analysis_id", "category", "changed_symbol", "affected_symbol", "title")
    strongest = F.struct(F.col("confidence").isNull().alias("unknown"), (-F.col("confidence")).alias("weakness"), *order)
    best = F.min_by(F.struct(*[c for c in risks.columns if c not in group]), strongest).alias("_r")
    found = risks.groupBy(*group).agg(best, F.min(F.struct(*order)).alias("_first"))
    return found.select(*[F.col(c if c in group else f"_r.{c}").alias(c) for c in risks.columns], "_first")


def run(changes: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(risk_seq, …): all rules over semantically deduplicated changes; nullable uses, then deletions, then signatures, per change."""
    changes = dedupe_semantic(changes)
    rank = lambda df, k: df.withColumn("rule_rank", F.lit(k))
    every = rank(nullable_method(changes, edges, nodes), 0).unionByName(rank(nullable_argument(changes, edges, nodes), 0)).unionByName(rank(nullable_access(changes, edges, nodes), 0))
    every = every.unionByName(rank(deleted_symbol(changes, edges, nodes), 1)).unionByName(rank(signature_change(changes, edges, nodes), 2))
    kept = dedupe_rule_risks(every, "change_seq", "rule_rank", "edge_seq")
    return numbered_widely(kept, "risk_seq", ["analysis_id"], "_first").select("analysis_id", "risk_seq", *RISK_COLUMNS[1:])
