"""Operators that iterate read their inputs once, and no more of them than their results need."""

from pyspark.sql import functions as F

from rippletrace.functions import ordering
from rippletrace.functions.shared import cut
from rippletrace.operators import linediff, scoring, traverse, views


def counted(spark, df, column):
    """The rows, and how often one of them has been computed."""
    calls = spark.sparkContext.accumulator(0)

    def look(value):
        calls.add(1)
        return value

    return df.withColumn(column, F.udf(look, "string").asNondeterministic()(column)), calls


def test_a_history_is_read_once_for_all_generations(spark):
    rows = [("a", str(k), [str(k - 1)] if k else []) for k in range(8)]
    commits, calls = counted(spark, spark.createDataFrame([*rows, ("a", "x", ["3"])], "analysis_id string, commit string, parents array<string>"), "commit")
    found = linediff.merge_base(commits, spark.createDataFrame([("a", "7", "x")], "analysis_id string, base string, head string"))
    assert [r.merge_base for r in found.collect()] == ["3"]
    assert calls.value <= 9


def test_radii_join_edges_with_nodes_once_and_carry_no_paths(spark, monkeypatch):
    written = []
    monkeypatch.setattr(traverse, "cut", lambda df: written.append(cut(df)) or written[-1])
    nodes = spark.createDataFrame([("a", str(k)) for k in range(6)], "analysis_id string, id string")
    edges = spark.createDataFrame([("a", k, str(k + 1), str(k)) for k in range(6)], "analysis_id string, edge_seq long, source string, target string")
    totals = traverse.radius_totals(edges, nodes, spark.createDataFrame([("a", 1, "0")], "analysis_id string, seed_seq int, seed string"))
    assert [(r.total_affected, r.first, r.last) for r in totals.collect()] == [(4, "1", "4")]
    assert written[0].columns == ["analysis_id", "at", "source", "edge_seq"] and written[0].count() == 5
    assert len(written) == 4 and all(r.way == ["0"] for level in written[1:] for r in level.collect())


def test_depths_of_drawn_nodes_walk_only_what_these_depend_on(spark, monkeypatch):
    written = []
    monkeypatch.setattr(views, "cut", lambda df: written.append(cut(df)) or written[-1])
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("c", "a"), ("a", "d"), *((f"leaf{k}", "b") for k in range(50))]
    edges = spark.createDataFrame([("x", len(pairs) - k, s, t) for k, (s, t) in enumerate(pairs)], "analysis_id string, edge_seq long, source string, target string")
    changed = spark.createDataFrame([("x", "a")], "analysis_id string, id string")
    drawn = spark.createDataFrame([("x", "d"), ("x", "leaf7"), ("x", "alone")], "analysis_id string, id string")
    depths = lambda df: {(r.id, r.depth) for r in df.collect()}
    near = depths(views.depths(edges, changed, drawn))
    assert max(w.count() for w in written) < 10
    assert {p for p in near if p[0] in ("d", "leaf7", "alone")} == {p for p in depths(views.depths(edges, changed)) if p[0] in ("d", "leaf7", "alone")} == {("d", 2), ("leaf7", 2)}


def test_growing_sets_read_the_edges_once(spark):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("e", "x")]
    edges, calls = counted(spark, spark.createDataFrame([("s", k, a, b) for k, (a, b) in enumerate(pairs)], "analysis_id string, edge_seq long, source string, target string"), "source")
    found = views.joining_times(edges, spark.createDataFrame([("s", "a")], "analysis_id string, id string"))
    assert {(r.id, r.joined) for r in found.collect()} == {("a", views.NEVER), ("b", 0), ("c", 1), ("d", 2)}
    assert calls.value == len(pairs)


def test_nodes_that_lead_nowhere_keep_their_first_label(spark, monkeypatch):
    written = []
    monkeypatch.setattr(views, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = [("b", "a", 0), ("c", "b", 1), ("leaf", "a", 9), ("leaf", "c", 2)]
    edges, calls = counted(spark, spark.createDataFrame([("s", k, a, b) for a, b, k in rows], "analysis_id string, edge_seq long, source string, target string"), "source")
    found = views.depths(edges, spark.createDataFrame([("s", "a")], "analysis_id string, id string"))
    assert sorted((r.id, r.depth) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2), ("leaf", 1)]
    assert calls.value == len(rows)
    assert sum(w.where("id = 'leaf'").count() for w in written if "label" in w.columns) == 1


def test_playback_of_scored_risks_numbers_them_once_and_reads_no_evidence(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ordering, "cut", lambda df: written.append(cut(df)) or written[-1])
    rows = [("a", k, "type", "high", k / 10, "static", f"n{k % 4}", f"t{k % 4}", 1, ["x", "y"] if k % 4 else ["x"], ["e"]) for k in range(8)]
    risks = spark.createDataFrame(rows, "analysis_id string, risk_seq long, category string, severity string, confidence double, source string, changed_node_id string, title string, dependency_depth int, failure_path array<string>, evidence array<string>")
    risks = risks.withColumns({"affected_node_id": F.lit("m"), "changed_symbol": F.lit("c"), "affected_symbol": F.lit("s")})
    narrow, calls = counted(spark, risks.drop("evidence"), "title")
    found = views.playback(scoring.score(scoring.dedupe(narrow)), scoring.BEST_FIRST).collect()
    assert len(written) == 1 and written[0].count() == 3 and calls.value <= len(rows)
    ranked = scoring.rank(scoring.score(scoring.dedupe(risks)))
    assert sorted(found) == sorted(views.playback(ranked).collect())


def test_two_states_of_files_are_read_once_for_all_kinds_of_diffs(spark):
    schema = "analysis_id string, path string, content string"
    texts = {"same": ("x\n", "x\n"), "edited": ("x\ny\n", "x\nz"), "gone": ("g\n", None), "new": (None, "n\n"), "old/a": ("p\nq\n", None), "moved/a": (None, "p\nq\n")}
    base, base_calls = counted(spark, spark.createDataFrame([("s", p, b) for p, (b, _) in texts.items() if b], schema), "content")
    head, head_calls = counted(spark, spark.createDataFrame([("s", p, h) for p, (_, h) in texts.items() if h], schema), "content")
    files = cut(linediff.file_diffs(base, head))
    assert {(r.new_path, r.status) for r in files.collect()} == {("edited", "modified"), ("gone", "deleted"), ("new", "added"), ("moved/a", "renamed")}
    assert (base_calls.value, head_calls.value) == (4, 4)
    assert {(r.path, r.content) for r in linediff.patched(base, files).collect()} == {("edited", "x\nz"), ("new", "n\n"), ("moved/a", "p\nq\n")}
