"""The whole analysis: files and diffs in, tables of graph, changes, risks and scores out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.ordering import ordered_list
from rippletrace.functions.shared import cut
from rippletrace.operators import changes as change_ops
from rippletrace.operators import diff, enrich, graph, prisma, rules, scoring, traverse, ts_scan
from rippletrace.sources.files import json_fragments, select_files, to_json_result


@dataclass(frozen=True)
class Options:
    """Faithful by default; each flag mends one known deviation."""

    prisma_line_fix: bool = False
    strict_diff: bool = False
    base_side_symbols: bool = False
    detect_signature_change: bool = False
    validate_enrichment: bool = False
    aliases: dict[str, str] = field(default_factory=dict)
    max_depth: int = traverse.MAX_DEPTH


def parse(files: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with file_rank, imports, symbols with symbol_seq)."""
    files = graph.sequence_files(select_files(files))
    scanned = cut(ts_scan.scan(files.where(~F.col("path").endswith(".prisma"))))  # read for symbols and for imports
    symbols = graph.sequence_symbols(ts_scan.symbols(scanned), prisma.symbols(files.where(F.col("path").endswith(".prisma")), line_fix=options.prisma_line_fix))
    return files, ts_scan.imports(scanned), symbols


def analyze(files: DataFrame, diffs: DataFrame, *, base_files: DataFrame | None = None, client: enrich.RiskClient | None = None, options: Options = Options()) -> dict[str, DataFrame]:
    """All tables of the analyses in `files` (analysis_id, file_seq, path, content) and `diffs` (analysis_id, …, diff).

    With `base_side_symbols`, removed lines are held against the symbols of `base_files`.
    """
    files, imports, symbols = parse(files, options)
    symbols = cut(symbols)
    nodes = graph.nodes(files, symbols)
    edges = cut(graph.edges(files, imports, symbols, nodes, aliases=options.aliases or None))
    lines = diff.parse_lines(diffs, strict=options.strict_diff)
    changed = change_ops.detect(lines, symbols, signatures=options.detect_signature_change)
    if options.base_side_symbols and base_files is not None:
        _, _, old = parse(base_files, options)
        gone = old.join(symbols.select("analysis_id", "id"), ["analysis_id", "id"], "left_anti")
        removed = change_ops.detect(lines.where("type = 'removed'"), gone)
        top = changed.groupBy("analysis_id").agg(F.max("change_seq").alias("_top"))
        removed = removed.join(top, "analysis_id", "left").withColumn("change_seq", (F.col("change_seq") + F.coalesce("_top", F.lit(0))).cast("int")).drop("_top")
        changed = changed.unionByName(removed)
    changed = cut(changed)
    seeds = changed.groupBy("analysis_id", F.col("node_id").alias("seed")).agg(F.min("change_seq").alias("seed_seq"))
    affected = traverse.combined(edges, seeds, options.max_depth, nodes)
    found = rules.run(changed, edges, nodes)
    if client is not None:
        prompts = enrich.enrichment_prompts(found, changed, affected, nodes, symbols)
        found = enrich.enrich(found, enrich.enrichment_rows(enrich.ask(prompts, client, "enrich")), validate=options.validate_enrichment)
    ranked = scoring.rank(scoring.score(scoring.dedupe(found)))
    return {
        "files": files, "imports": imports, "symbols": symbols, "nodes": nodes, "edges": edges, "diff_files": diff.parse_files(diffs, strict=options.strict_diff), "diff_lines": lines,
        "changes": changed, "affected": affected, "risks": ranked, "summary": scoring.summary(diffs, changed, affected, ranked),
    }


#: The lists of a result document, and the order of each.
LISTS = (("changes", "change_seq"), ("affected", "out_seq"), ("risks", "rank"), ("nodes", "node_seq"), ("edges", "edge_seq"))


def _head(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["summary"].select("analysis_id", F.struct("changed", "affected", "risks", "critical", "high").alias("summary"), F.col("score").alias("blastRadiusScore"))


def result_fragments(tables: dict[str, DataFrame]) -> DataFrame:
    """The documents of `result` as ordered pieces (analysis_id, section, place, text), for analyses of any size."""
    return json_fragments(_head(tables), {name: (tables[name], order) for name, order in LISTS})


def result(tables: dict[str, DataFrame]) -> DataFrame:
    """(analysis_id, body): one nested JSON document for each analysis; it must fit into a row, see `result_fragments`."""
    out = _head(tables)
    for name, order in LISTS:
        df = tables[name]
        rows = df.groupBy("analysis_id").agg(ordered_list(F.struct(*[c for c in df.columns if c != "analysis_id"]), order).alias(name))
        out = out.join(rows, "analysis_id", "left")
    return to_json_result(out)
