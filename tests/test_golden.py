"""The golden repository end to end."""

import pytest

from rippletrace.plans.analyze import Options, analyze, result

from . import fixture


@pytest.fixture(scope="module")
def tables(spark):
    return analyze(*fixture.frames(spark))


@pytest.mark.parametrize("name,order", [("golden_nodes", "node_seq"), ("golden_edges", "edge_seq"), ("golden_affected", "out_seq"), ("golden_risks", "rank")])
def test_rows(tables, name, order):
    import duckdb

    want = duckdb.sql(fixture.golden_values()[name]).fetchall()
    columns = [d[0] for d in duckdb.sql(fixture.golden_values()[name]).description]
    got = [tuple(r) for r in tables[name.removeprefix("golden_")].orderBy(order).select(*columns).collect()]
    assert got == sorted(want)


def test_summary(tables):
    row = tables["summary"].first()
    assert (row.changed, row.affected, row.risks, row.critical, row.high, row.score) == (1, 8, 3, 1, 1, 88)


def test_paths_end_at_their_node(tables):
    for r in tables["affected"].collect():
        assert r.depth <= 4 and len(r.path) == r.depth + 1 and r.path[-1] == r.node_id and r.path[0] == r.seed


def test_result_is_one_document(tables):
    import json

    body = json.loads(result(tables).first().body)
    assert body["blastRadiusScore"] == 88 and body["summary"]["risks"] == 3 and len(body["nodes"]) == 18


def test_many_analyses_in_one_job(spark):
    f1, d1 = fixture.frames(spark, "a")
    f2, d2 = fixture.frames(spark, "b", diff="")
    t = analyze(f1.unionByName(f2), d1.unionByName(d2))
    assert {(r.analysis_id, r.risks, r.score) for r in t["summary"].collect()} == {("a", 3, 88), ("b", 0, 0)}


def test_line_fix_finds_database_fields(spark):
    t = analyze(*fixture.frames(spark), options=Options(prisma_line_fix=True))
    assert [r.name for r in t["changes"].orderBy("change_seq").collect()] == ["User.email", "User.phone", "User.email"]


def test_stream_appends_each_batch_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from rippletrace.streaming.incremental import analyze_stream, read_diffs

    files, diffs = fixture.frames(spark)
    diffs.select("analysis_id", F.lit("b").alias("base"), F.lit("h").alias("head"), "diff").write.parquet(str(tmp_path / "in"))
    query = analyze_stream(read_diffs(spark, str(tmp_path / "in")), files, str(tmp_path / "out"), str(tmp_path / "cp"), tables=("summary",))
    query.awaitTermination(120)
    assert [r.score for r in spark.read.parquet(str(tmp_path / "out/summary")).collect()] == [88]
