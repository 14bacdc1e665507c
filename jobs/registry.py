"""The jobs as queries: each runs twice into one new folder and returns what stands there after the second run."""

from __future__ import annotations

import json

from rippletrace.functions.shared import new_folder
from rippletrace.plans.sql import CASCADE_RISKS

from . import change_feed, impact_report


def _config(path: str, **changed) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file) | changed


def job1_change_feed(spark, sf_dir):
    """Every document as a new revision of the document before it."""
    folder, table = new_folder(spark), f"{sf_dir}/documents.parquet"
    config = _config(change_feed.CONFIG, base_key="doc_id + 1")
    for _ in range(2):
        change_feed.run(spark, table + "*", table, f"{folder}/out", f"{folder}/checkpoint", config)
    return change_feed.changes(spark, f"{folder}/out")


def job2_impact_report(spark, sf_dir):
    folder = new_folder(spark)
    for _ in range(2):
        impact_report.run(spark, sf_dir, folder, _config(impact_report.CONFIG))
    return impact_report.report(spark, folder)


_LINES = "CAST(coalesce(length({0}) - length(replace({0}, chr(10), '')) + CAST({0} <> '' AND NOT ends_with({0}, chr(10)) AS INTEGER), 0) AS BIGINT)"

QUERIES = {"job1_change_feed": job1_change_feed, "job2_impact_report": job2_impact_report}
ORACLE_SQL = {
    "job1_change_feed": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(nullif(lang, ''), 'unknown') AS lang FROM documents),
p AS (SELECT d.*, b.t AS base FROM d LEFT JOIN d b ON b.doc_id + 1 = d.doc_id)
SELECT doc_id AS key, 'texts/' || doc_id || '.txt' AS path, CASE WHEN base IS NULL THEN 'added' WHEN base = t THEN 'unchanged' ELSE 'modified' END AS status, {_LINES.format("base")} AS base_lines, {_LINES.format("t")} AS head_lines,
       CASE WHEN base IS NULL OR base <> t THEN sha256(t) END AS patched_sha256, lang FROM p""",
    "job2_impact_report": f"""{CASCADE_RISKS}, s AS (SELECT *, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS risk_seq, CASE category WHEN 'runtime' THEN 98 WHEN 'type' THEN 79 WHEN 'business_logic' THEN 45 WHEN 'dependency' THEN 98 ELSE 83 END AS score FROM r WHERE n = 1)
SELECT CAST(row_number() OVER (ORDER BY score DESC, confidence DESC, risk_seq) AS INTEGER) AS rank, id, title, category, severity, confidence, score, regexp_extract(id, 'part:[0-9]+') AS changed_node_id, regexp_extract(id, 'supplier:[0-9]+') AS affected_node_id FROM s""",
}
