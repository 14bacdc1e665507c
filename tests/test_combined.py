"""Combined radii keep few arrivals at a node and leave little on disk, with the rows of all radii in full."""

import os
import random
import time

from pyspark.sql import functions as F

from rippletrace.functions import ordering, shared
from rippletrace.operators import traverse


def graphs(spark, made):
    """(edges, seeds) of graphs (pairs, seeds), an analysis each."""
    edges = [(f"g{g}", k, s, t) for g, (pairs, _) in enumerate(made) for k, (s, t) in enumerate(pairs)]
    seeds = [(f"g{g}", k, n) for g, (_, ns) in enumerate(made) for k, n in ns]
    return spark.createDataFrame(edges, "analysis_id string, edge_seq long, source string, target string"), spark.createDataFrame(seeds, "analysis_id string, seed_seq int, seed string")


def drawn(rng, falls):
    size = rng.randrange(4, 10)
    pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randrange(4, 3 * size))]
    pairs = [(max(p), min(p)) if falls else p for p in pairs if p[0] != p[1]]
    return [(f"n{s}", f"n{t}") for s, t in pairs], list(enumerate(rng.sample([f"n{k}" for k in range(size)], rng.randrange(2, size))))


def rows(df):
    return sorted((r.analysis_id, r.out_seq, r.node_id, r.depth, r.seed, r.path) for r in df.collect())


def test_combined_radii_equal_all_radii(spark, monkeypatch):
    rng = random.Random(3)
    edges, seeds = graphs(spark, [drawn(rng, True) for _ in range(60)])
    want = rows(traverse.combine(traverse.dependents(edges, seeds)))
    monkeypatch.setattr(traverse, "dependents", None)  # no seed comes back to itself, so no radius is found alone
    assert rows(traverse.combined(edges, seeds)) == want and len(want) > 150


def test_seeds_on_cycles(spark):
    rng = random.Random(4)
    edges, seeds = graphs(spark, [([("b", "a"), ("c", "b"), ("a", "c"), ("x", "a")], [(1, "b"), (0, "a"), (2, "c")]), *[drawn(rng, False) for _ in range(20)]])
    assert rows(traverse.combined(edges, seeds)) == rows(traverse.combine(traverse.dependents(edges, seeds)))


def test_many_seeds_leave_one_arrival_at_a_node(spark, monkeypatch):
    written = []
    monkeypatch.setattr(traverse, "cut", lambda df: written.append(shared.cut(df)) or written[-1])
    pairs = [("mid", f"s{k}") for k in range(4)] + [(f"leaf{k}", "mid") for k in range(50)]
    edges, seeds = graphs(spark, [(pairs, [(k, f"s{k}") for k in range(4)])])
    found = traverse.combined(edges, seeds)
    assert found.where("node_id LIKE 'leaf%'").count() == 50
    levels = [w for w in written if "order_key" in w.columns]
    assert sum(level.where("node_id LIKE 'leaf%'").count() for level in levels) == 50 and len(levels) == 2  # nothing depends on leaves


def test_what_is_written_leaves_no_shuffle_files(spark):
    store = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f.getPath() for d in store.localDirs() for f in _walk(d) if f.getName().startswith("shuffle_")}
    before = files()
    shared.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(100):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before


def _walk(folder):
    for f in folder.listFiles() or []:
        yield from _walk(f) if f.isDirectory() else [f]


def test_discarded_tables_are_gone(spark):
    table = shared.cut(spark.range(3).toDF("k"))
    folder = os.path.dirname(table.inputFiles()[0]).removeprefix("file://")
    assert os.path.isdir(folder)
    shared.discard(table)
    assert not os.path.isdir(folder) and not any(path.endswith(os.path.basename(folder)) for _, path in shared._written)


def test_numbers_over_ranges_need_no_second_shuffle(spark):
    df = spark.createDataFrame([(None if k % 3 == 0 else f"a{k % 3}", k * 37 % 101) for k in range(90)], "g string, v int")
    got = ordering.numbered_widely(df, "n", ["g"], F.desc("v"))
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, ordering.numbered(df, "n", ["g"], F.desc("v")).collect()))


def test_slices_change_no_rows_and_leave_no_steps(spark, monkeypatch):
    rng = random.Random(5)
    edges, seeds = graphs(spark, [drawn(rng, k % 2) for k in range(20)])
    edges = shared.cut(edges)  # of a known size
    nodes = edges.where("source < 'n7'").select("analysis_id", F.col("source").alias("id")).distinct()
    radii = lambda: sorted(map(str, traverse.radius_totals(edges, nodes, seeds).collect()))
    want, falling = radii(), seeds.where("analysis_id LIKE '%1'")
    both = rows(traverse.combined(edges, falling))
    monkeypatch.setattr(traverse, "SLICE", 1)
    before = len(shared._written)
    assert radii() == want
    assert len(shared._written) - before == 4  # the levels: neither edges nor steps
    assert rows(traverse.combined(edges, falling)) == both
