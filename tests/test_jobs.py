"""The jobs: registered queries against SQL, runs over growing copies of the tables, safe reruns."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import change_feed, impact_report, registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def rows(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{t}')")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(got.columns)
    assert rows(got) == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())


def config(**changed):
    with open(change_feed.CONFIG) as file:
        return json.load(file) | changed


def test_feed_takes_only_what_is_new(spark, tmp_path, caplog):
    docs, seen, out, mark = spark.read.parquet(f"{FOLDER}/documents.parquet"), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    base = str(tmp_path / "base")
    docs.where("doc_id % 3 > 0").withColumn("text", F.concat(F.lit("first line\n"), "text")).write.parquet(base)
    docs.where("doc_id < 90").coalesce(1).write.parquet(seen)
    files = lambda: {f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")}
    with caplog.at_level("INFO", logger="jobs.change_feed"):
        first = change_feed.run(spark, seen, base, out, mark, config())
        before = files()
        assert first == {"added": 30, "modified": 60}
        assert change_feed.run(spark, seen, base, out, mark, config()) == {} and files() == before  # nothing new: nothing written
        docs.where("doc_id >= 90").coalesce(1).write.mode("append").parquet(seen)
        change_feed.run(spark, seen, base, out, mark, config())
    assert before < files()
    found = {r.key: r for r in change_feed.changes(spark, out).collect()}
    assert set(found) == {r.doc_id for r in docs.collect()} and change_feed.changes(spark, out).count() == docs.count()
    assert {k % 3 for k, r in found.items() if r.status == "added"} == {0}
    texts = {r.doc_id: r.digest for r in docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).collect()}
    assert all(r.patched_sha256 == texts[k] for k, r in found.items())
    assert "read 90 revisions" in caplog.text and "read 0 revisions" in caplog.text and f"read {docs.count() - 90} revisions" in caplog.text
    diffs = spark.read.parquet(f"{out}/diffs")
    assert diffs.where("status = 'modified'").where(~F.col("diff").contains("-first line\n")).count() == 0


def test_a_batch_that_runs_again_leaves_its_rows_once(spark, tmp_path):
    one = spark.createDataFrame([(1, "a\n", "en"), (2, None, None), (3, "c", "")], "doc_id long, text string, lang string")
    base = one.where("doc_id = 3")
    for k in range(2):  # the second run has a new mark, as after a loss of the first one's
        one.write.mode("overwrite").parquet(str(tmp_path / "in"))
        base.write.mode("overwrite").parquet(str(tmp_path / "base"))
        change_feed.run(spark, str(tmp_path / "in"), str(tmp_path / "base"), str(tmp_path / "out"), str(tmp_path / f"mark{k}"), config())
    got = {(r.key, r.status, r.base_lines, r.head_lines, r.lang) for r in change_feed.changes(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "added", 0, 1, "en"), (2, "added", 0, 0, "unknown"), (3, "unchanged", 1, 1, "unknown")}
    assert change_feed.changes(spark, str(tmp_path / "out")).count() == 3


def test_unchanged_revisions_have_no_digest(spark):
    rows = "doc_id long, text string, lang string"
    revisions = spark.createDataFrame([(1, "a\nb\n", "en"), (2, "c\n", "en"), (3, "new\n", "en"), (4, "", "en")], rows)
    base = spark.createDataFrame([(1, "a\nb\n", "en"), (2, "b\n", "en"), (4, "", "en")], rows)
    changes, _ = change_feed.compare(revisions, base, config())
    digests = {r.key: (r.status, r.patched_sha256) for r in changes.collect()}
    of = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert digests == {1: ("unchanged", None), 2: ("modified", of("c\n")), 3: ("added", of("new\n")), 4: ("unchanged", None)}


def test_report_is_replaced_by_an_equal_one(spark, tmp_path):
    out, least = str(tmp_path / "report"), {"least_score": 50, "partition": ["severity"]}
    written = impact_report.run(spark, FOLDER, out, least)
    once = rows(impact_report.report(spark, out))
    assert impact_report.run(spark, FOLDER, out, least) == written and rows(impact_report.report(spark, out)) == once
    assert set(written) == {"critical", "high"} and sum(written.values()) == len(once) and os.path.isdir(f"{out}/risks/severity=high")


def test_command_lines(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.impact_report", "--tables", FOLDER, "--out", str(tmp_path / "r")], cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=4 pyspark-shell"})
    assert done.returncode == 0 and "wrote {" in done.stderr, done.stderr[-2000:]
    done = subprocess.run([sys.executable, "-m", "jobs.change_feed", "--revisions", f"{FOLDER}/documents.parquet*", "--base", f"{FOLDER}/documents.parquet", "--out", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c")], cwd=root, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=4 pyspark-shell"})
    assert done.returncode == 0 and "wrote {'unchanged': 200}" in done.stderr, done.stderr[-2000:]
