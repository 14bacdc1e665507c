"""Optional language-model step: contexts, prompts, pluggable clients, parsing and enrichment of risks."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.exprs import HIGH_IMPACT, filled, sanitize_confidence, valid_category, valid_severity
from rippletrace.functions.ordering import first_by, numbered, ordered_list
from rippletrace.operators.graph import direct_dependents
from rippletrace.operators.rules import RISK_COLUMNS, RISK_META
from rippletrace.schemas import LLM_ENRICHMENT, LLM_RISKS

MAX_CONTEXTS, MAX_COMPONENTS, MAX_ENRICHED = 8, 10, 15
# Kinds of symbols whose changes are worth a context of their own.
WORTH_TYPES = ("function", "class", "api_route", "database_model", "database_field", "type", "interface")


class RiskClient(Protocol):
    """What a language model answers, as JSON text. The only extension point."""

    def analyze(self, prompt: str) -> str: ...

    def enrich(self, prompt: str) -> str: ...


class OfflineClient:
    """Answers without a network, the same for the same prompt: no risks, no changes."""

    def analyze(self, prompt: str) -> str:
        return json.dumps({"risks": []})

    def enrich(self, prompt: str) -> str:
        return json.dumps({"enrichedRisks": []})


class FallbackClient:
    """Asks several models in turn; the first answer that is not blank counts, none gives an empty one."""

    def __init__(self, models: list[Callable[[str], str]]):
        self.models = models

    def _ask(self, prompt: str) -> str:
        for model in self.models:
            try:
                if (answer := model(prompt)) and answer.strip():
                    return answer
            except Exception as error:  # a model that fails is passed over
                print(f"model failed: {error}")
        return ""

    def analyze(self, prompt: str) -> str:
        return self._ask(prompt)

    def enrich(self, prompt: str) -> str:
        return self._ask(prompt)


def message(model: str, prompt: str) -> dict:
    """The default request of `HttpClient`: one user message, low temperature, an answer in JSON."""
    return {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"temperature": 0.1, "responseMimeType": "application/json"}}


def first_text(answer: dict) -> str:
    """The text of the first candidate in an answer."""
    return "".join(p.get("text", "") for p in answer["candidates"][0]["content"]["parts"])


class HttpClient:
    """Models over HTTP: `address` with {model} in it takes a JSON request and gives a JSON answer.

    Models are asked in order. One that is busy or fails on its side (429, 5xx, no connection, no answer within `timeout` seconds)
    is asked up to `tries` times with growing pauses; then, as after any other error, a blank text or a text that is no JSON, it is
    the next one's turn. If none answers, the text is empty. `ask` sends up to `at_once` requests of a task at a time. The
    key is read from an environment variable where the request is sent, so it is in no plan; a missing one is an error.
    """

    def __init__(self, address: str, models: list[str], *, key_variable: str | None = None, key_header: str = "Authorization", key_format: str = "Bearer {}", timeout: float = 30, tries: int = 3, pause: float = 0.5, at_once: int = 4, request: Callable[[str, str], dict] = message, text: Callable[[dict], str] = first_text):
        self.address, self.models, self.key_variable, self.key_header, self.key_format = address, models, key_variable, key_header, key_format
        self.timeout, self.tries, self.pause, self.at_once, self.request, self.text = timeout, tries, pause, at_once, request, text

    def _send(self, model: str, prompt: str) -> str:
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            if not os.environ.get(self.key_variable):
                raise ValueError(f"{self.key_variable} is not set")
            headers[self.key_header] = self.key_format.format(os.environ[self.key_variable])
        body = json.dumps(self.request(model, prompt)).encode()
        with urllib.request.urlopen(urllib.request.Request(self.address.format(model=model), body, headers), timeout=self.timeout) as answer:
            return self.text(json.load(answer))

    def _ask(self, prompt: str) -> str:
        for model in self.models:
            for k in range(self.tries):
                try:
                    found = self._send(model, prompt)
                    json.loads(re.sub(r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "", found))
                    return found
                except urllib.error.HTTPError as error:
                    print(f"{model} failed: {error}")
                    if error.code != 429 and error.code < 500:
                        break
                except OSError as error:  # no connection, or no answer in time
                    print(f"{model} failed: {error}")
                except (LookupError, TypeError, json.JSONDecodeError) as error:
                    print(f"{model} gave no usable answer: {error}")
                    break
                if k + 1 < self.tries:
                    time.sleep(self.pause * 2**k)
        return ""

    def analyze(self, prompt: str) -> str:
        return self._ask(prompt)

    def enrich(self, prompt: str) -> str:
        return self._ask(prompt)


def is_worth_analysis(change_type: Column, kind: Column) -> Column:
    return change_type.isin(*HIGH_IMPACT) | kind.isin(*WORTH_TYPES)


def contexts(changes: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame, affected: DataFrame | None, *, limit: int | None = MAX_CONTEXTS) -> DataFrame:
    """One row for each change worth a context: the change, its code, up to ten components, edges among them.

    Components are affected nodes whose path holds the change; direct dependents
    are used only where no affected table is given at all.
    """
    chosen = changes.where(is_worth_analysis(F.col("change_type"), F.col("type")))
    chosen = numbered(chosen, "context_seq", ["analysis_id"], "change_seq")
    chosen = chosen if limit is None else chosen.where(F.col("context_seq") <= limit)
    keys = chosen.select("analysis_id", "context_seq", F.col("node_id").alias("changed_id"))
    code = first_by(symbols, ["analysis_id", "id"], "symbol_seq").select("analysis_id", "id", "code")
    if affected is None:
        direct = direct_dependents(edges, nodes, keys.select("analysis_id", F.col("changed_id").alias("target")).distinct(), rows_per_edge=True)
        hit = keys.join(direct.withColumnRenamed("target", "changed_id"), ["analysis_id", "changed_id"])
        hit = hit.select("analysis_id", "context_seq", "changed_id", F.col("edge_seq").cast("long").alias("order"), "id", "name", "type", "file_path", F.lit(1).alias("depth"), F.array("changed_id", "id").alias("path"))
    else:
        exploded = affected.select("analysis_id", "out_seq", F.col("node_id").alias("id"), "depth", "path", F.explode(F.array_distinct("path")).alias("changed_id"))
        hit = keys.join(exploded, ["analysis_id", "changed_id"]).join(nodes.select("analysis_id", "id", "name", "type", "file_path"), ["analysis_id", "id"])
        hit = hit.select("analysis_id", "context_seq", "changed_id", F.col("out_seq").cast("long").alias("order"), "id", "name", "type", "file_path", "depth", "path")
    hit = hit.withColumn("_rank", F.row_number().over(Window.partitionBy("analysis_id", "context_seq").orderBy("order"))).where(F.col("_rank") <= MAX_COMPONENTS)
    hit = hit.join(code, ["analysis_id", "id"], "left")
    component = F.struct(F.col("id").alias("nodeId"), "name", "type", F.col("file_path").alias("filePath"), "code", "depth", "path")
    components = hit.groupBy("analysis_id", "context_seq").agg(ordered_list(component, "_rank").alias("affectedComponents"))
    ids = keys.select("analysis_id", "context_seq", F.col("changed_id").alias("id")).unionByName(hit.select("analysis_id", "context_seq", "id")).distinct()
    ends = lambda name: ids.select("analysis_id", "context_seq", F.col("id").alias(name))
    among = edges.join(ends("source"), ["analysis_id", "source"]).join(ends("target"), ["analysis_id", "context_seq", "target"])
    links = among.groupBy("analysis_id", "context_seq").agg(ordered_list(F.struct("source", "target", "type"), "edge_seq").alias("dependencyEdges"))
    change = F.struct(F.col("node_id").alias("nodeId"), "name", "type", F.col("change_type").alias("changeType"), F.col("file_path").alias("filePath"), "before", "after")
    out = chosen.withColumn("change", change).join(code.withColumnRenamed("id", "node_id").withColumnRenamed("code", "changedCode"), ["analysis_id", "node_id"], "left")
    out = out.join(components, ["analysis_id", "context_seq"], "left").join(links, ["analysis_id", "context_seq"], "left")
    return out.select("analysis_id", "context_seq", "change_seq", "change", "changedCode", "affectedComponents", "dependencyEdges")


def skip_idle(found: DataFrame) -> DataFrame:
    """Contexts without components whose change is only `modified` are not asked about."""
    return found.where((F.coalesce(F.size("affectedComponents"), F.lit(0)) > 0) | (F.col("change.changeType") != "modified"))


ANALYZE_RULES = (
    "You review a code change. Report only breakage that the given code and edges support. "
    'Answer with JSON {"risks": [{"title", "description", "category", "severity", "confidence", "reason", "failurePath", "evidence", "suggestedFix", "affectedSymbol", "affectedNodeId"}]}.'
)
ENRICH_RULES = 'You explain known risks of a code change. Keep every id. Answer with JSON {"enrichedRisks": [{"id", "description", "suggestedFix", "severity", "confidence"}]}.'


def analysis_prompt() -> Column:
    """The prompt of one context row."""
    part = lambda title, column: F.concat(F.lit(f"\n\n{title}:\n"), F.coalesce(column, F.lit("[]")))
    return F.concat(F.lit(ANALYZE_RULES), part("CHANGE", F.to_json("change")), part("CODE", F.coalesce("changedCode", F.lit("not available"))), part("AFFECTED", F.to_json("affectedComponents")), part("EDGES", F.to_json("dependencyEdges")))


def enrichment_prompts(risks: DataFrame, changes: DataFrame, affected: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(analysis_id, prompt): all risks of an analysis in one prompt, with its changes and the first affected nodes."""
    few = affected.where(F.col("out_seq") <= MAX_ENRICHED).select("analysis_id", "out_seq", F.col("node_id").alias("id")).join(nodes.select("analysis_id", "id", "name", "type", "file_path"), ["analysis_id", "id"])
    few = few.join(first_by(symbols, ["analysis_id", "id"], "symbol_seq").select("analysis_id", "id", "code"), ["analysis_id", "id"], "left")
    gathered = lambda df, value, order, name: df.groupBy("analysis_id").agg(F.to_json(ordered_list(value, order)).alias(name))
    r = gathered(risks, F.struct("id", "title", "description", "category", "severity", "confidence", "evidence"), "risk_seq", "r")
    c = gathered(changes, F.struct("name", "type", F.col("change_type").alias("changeType"), "before", "after"), "change_seq", "c")
    a = gathered(few, F.struct(F.col("id").alias("nodeId"), "name", "type", F.col("file_path").alias("filePath"), "code"), "out_seq", "a")
    both = r.join(c, "analysis_id", "left").join(a, "analysis_id", "left")
    text = F.concat(F.lit(ENRICH_RULES), F.lit("\n\nRISKS:\n"), "r", F.lit("\n\nCHANGES:\n"), F.coalesce("c", F.lit("[]")), F.lit("\n\nAFFECTED:\n"), F.coalesce("a", F.lit("[]")))
    return both.select("analysis_id", text.alias("prompt"))


def ask(prompts: DataFrame, client: RiskClient, kind: str) -> DataFrame:
    """`prompts` with `answer`; a failing call answers with an empty text."""

    def one(prompt):
        try:
            return getattr(client, kind)(prompt)
        except Exception as error:  # one failing context must not end the others
            print(f"analysis failed: {error}")
            return ""

    def call(batches):
        with ThreadPoolExecutor(getattr(client, "at_once", 1)) as pool:
            for batch in batches:
                answers = list(pool.map(one, batch.column(batch.schema.get_field_index("prompt")).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, "answer"])

    body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInArrow(call, f"{body}, answer string")


def unfenced(answer: Column) -> Column:
    """An answer without the code fence around it."""
    t = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def parse_risks(answer: Column) -> Column:
    """array of risks; empty where the JSON is broken."""
    return F.coalesce(F.from_json(unfenced(answer), LLM_RISKS)["risks"], F.array().cast(LLM_RISKS[len("struct<risks:") : -1]))


def parse_enrichment(answer: Column) -> Column:
    return F.coalesce(F.from_json(unfenced(answer), LLM_ENRICHMENT)["enrichedRisks"], F.array().cast(LLM_ENRICHMENT[len("struct<enrichedRisks:") : -1]))


def to_risks(answered: DataFrame) -> DataFrame:
    """Risk rows of answered contexts (analysis_id, context_seq, change, answer), without risk_seq."""
    rows = answered.select("analysis_id", "context_seq", "change", F.posexplode(parse_risks(F.col("answer"))).alias("index", "r"))
    target = F.coalesce("r.affectedNodeId", "r.affectedSymbol", F.col("index").cast("string"))
    return rows.select(
        "analysis_id", "context_seq", "index", F.concat_ws(":", F.lit("ai"), "change.nodeId", target).alias("id"), F.col("r.title").alias("title"), filled(F.col("r.description"), F.col("r.reason")).alias("description"),
        valid_category(F.col("r.category")).alias("category"), valid_severity(F.col("r.severity")).alias("severity"), sanitize_confidence(F.col("r.confidence")).alias("confidence"), F.lit("ai").alias("source"),
        F.col("change.nodeId").alias("changed_node_id"), F.col("r.affectedNodeId").alias("affected_node_id"), F.col("change.name").alias("changed_symbol"), F.col("r.affectedSymbol").alias("affected_symbol"),
        F.col("change.filePath").alias("file_path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("dependency_depth"), F.col("r.failurePath").alias("failure_path"),
        F.col("r.evidence").alias("evidence"), F.col("r.suggestedFix").alias("suggested_fix"), F.struct(F.col("r.reason").alias("reason")).cast(RISK_META).alias("metadata"),
    )


def analyze(found: DataFrame, client: RiskClient) -> DataFrame:
    """Risks that a client reports for contexts, in context and answer order."""
    answered = ask(skip_idle(found).withColumn("prompt", analysis_prompt()), client, "analyze")
    return numbered(to_risks(answered), "risk_seq", ["analysis_id"], "context_seq", "index").select("analysis_id", "risk_seq", *RISK_COLUMNS[1:])


def enrichment_rows(answered: DataFrame) -> DataFrame:
    """(analysis_id, id, description, suggestedFix, severity, confidence): the last answer for each id."""
    rows = answered.select("analysis_id", F.posexplode(parse_enrichment(F.col("answer"))).alias("pos", "e"))
    return rows.groupBy("analysis_id", F.col("e.id").alias("id")).agg(F.max_by("e", "pos").alias("e")).select("analysis_id", "id", "e.description", "e.suggestedFix", "e.severity", "e.confidence")


def enrich(risks: DataFrame, rows: DataFrame, *, validate: bool = False) -> DataFrame:
    """Risks with texts and grades from enrichment rows of their id; descriptions always, others where filled.

    `validate` replaces unknown severities, which otherwise leave a risk without a score.
    """
    e = rows.select("analysis_id", "id", F.struct("description", "suggestedFix", "severity", "confidence").alias("_e"))
    both = risks.join(e, ["analysis_id", "id"], "left")
    hit = F.col("_e").isNotNull()
    severity = F.when(hit, filled(F.col("_e.severity"), F.col("severity"))).otherwise(F.col("severity"))
    both = both.withColumn("description", F.when(hit, F.col("_e.description")).otherwise(F.col("description")))
    both = both.withColumn("suggested_fix", F.when(hit, filled(F.col("_e.suggestedFix"), F.col("suggested_fix"))).otherwise(F.col("suggested_fix")))
    both = both.withColumn("severity", valid_severity(severity) if validate else severity)
    given = F.when((F.col("_e.confidence") != 0) & ~F.isnan("_e.confidence"), F.col("_e.confidence"))
    both = both.withColumn("confidence", F.when(hit, F.coalesce(given, F.col("confidence"))).otherwise(F.col("confidence")))
    return both.withColumn("source", F.when(hit, F.lit("ai")).otherwise(F.col("source"))).select(*risks.columns)


