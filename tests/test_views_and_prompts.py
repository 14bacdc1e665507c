"""Views in their exact forms, prompts, contexts and answers."""

import random

from pyspark.sql import functions as F

from rippletrace.operators import enrich, views
from rippletrace.plans.analyze import analyze

from . import fixture


def edges(spark, pairs):
    return spark.createDataFrame([("a", k, s, t) for k, (s, t) in enumerate(pairs)], "analysis_id string, edge_seq long, source string, target string")


def test_exact_sweep_depends_on_edge_order(spark):
    chosen = spark.createDataFrame([("a", "x")], "analysis_id string, id string")
    ids = lambda pairs, exact: {r.id for r in views.neighbourhood(edges(spark, pairs), chosen, exact=exact).collect()}
    assert ids([("y", "x"), ("z", "y")], True) == {"x", "y", "z"} and ids([("z", "y"), ("y", "x")], True) == {"x", "y"}
    assert ids([("y", "x"), ("z", "y")], False) == {"x", "y"}


def sweeps(pairs, changed):
    """Depths by six sweeps in place, and joining numbers by one."""
    depth, joined = dict.fromkeys(changed, 0), dict.fromkeys(changed, views.NEVER)
    for _ in range(views.SWEEPS):
        for source, target in pairs:
            if target in depth and depth[target] + 1 < depth.get(source, 10**9):
                depth[source] = depth[target] + 1
    for k, (source, target) in enumerate(pairs):
        if source in joined or target in joined:
            joined.setdefault(source, k)
            joined.setdefault(target, k)
    return depth, joined


def test_sweeps_of_every_order(spark):
    rng, graphs = random.Random(8), {}
    for n in (3, 6, 7, 8, 20, 30):
        chain = [(f"n{k + 1}", f"n{k}") for k in range(n)]
        graphs[f"up{n}"], graphs[f"down{n}"] = (chain, ["n0"]), (chain[::-1], ["n0"])
    for g in range(60):
        n = rng.randrange(2, 14)
        graphs[f"g{g}"] = ([(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(1, 30))], [f"n{rng.randrange(n)}" for _ in range(rng.randrange(1, 3))])
    every = spark.createDataFrame([(g, k, s, t) for g, (pairs, _) in graphs.items() for k, (s, t) in enumerate(pairs)], "analysis_id string, edge_seq int, source string, target string")
    changed = spark.createDataFrame([(g, c) for g, (_, cs) in graphs.items() for c in cs], "analysis_id string, id string")
    depth, joined = {g: {} for g in graphs}, {g: {} for g in graphs}
    for r in views.depths(every, changed).collect():
        depth[r.analysis_id][r.id] = r.depth
    for r in views.joining_times(every, changed).collect():
        joined[r.analysis_id][r.id] = r.joined
    for g, (pairs, start) in graphs.items():
        assert (depth[g], joined[g]) == sweeps(pairs, start), g
    assert max(depth["up30"].values()) == 30 and max(depth["down30"].values()) == 6


def test_contexts_hold_code_components_and_edges(spark):
    t = analyze(*fixture.frames(spark))
    row = enrich.contexts(t["changes"], t["symbols"], t["nodes"], t["edges"], t["affected"]).withColumn("prompt", enrich.analysis_prompt()).first()
    assert row.change.name == "User.email" and row.changedCode is None and len(row.affectedComponents) == 8 and len(row.dependencyEdges) == 11
    assert "syncBilling" in row.prompt and "type_changed" in row.prompt


def test_a_client_enriches_by_id(spark):
    class Client:
        def analyze(self, prompt):
            return '```json\n{"risks": [{"title": "T", "reason": "R", "severity": "odd", "confidence": 250, "affectedSymbol": "s"}]}\n```'

        def enrich(self, prompt):
            risk = prompt.split('"id":"')[1].split('"')[0]
            return '{"enrichedRisks": [{"id": "' + risk + '", "description": "told", "severity": "low", "confidence": 0.5}]}'

    t = analyze(*fixture.frames(spark), client=Client())
    changed = [r for r in t["risks"].collect() if r.source == "ai"]
    assert [(r.description, r.severity, r.confidence, r.score) for r in changed] == [("told", "low", 0.5, 15)]
    found = enrich.analyze(enrich.contexts(t["changes"], t["symbols"], t["nodes"], t["edges"], None), Client()).collect()
    assert [(r.id, r.description, r.severity, r.confidence) for r in found] == [("ai:field:User.email:s", "R", "medium", 1.0)]


def test_playback_times(spark):
    risks = spark.createDataFrame([("a", 1, ["x", "y"]), ("a", 2, ["z"]), ("a", 3, ["p", "q", "r"])], "analysis_id string, rank int, failure_path array<string>")
    assert [(r.name, r.at_ms, r.is_last) for r in views.playback(risks).orderBy("at_ms").collect()] == [("x", 0, False), ("y", 850, True), ("p", 2400, False), ("q", 3250, False), ("r", 4100, True)]
    states = spark.range(3).select(views.step_state(F.col("id"), F.lit(1)).alias("s")).collect()
    assert [r.s for r in states] == ["active", "current", "waiting"]
