"""Graph queries over the whole graph against brute force, on the smallest tables."""

import os
from collections import Counter

import pytest

from rippletrace.operators import traverse, views
from rippletrace.plans import testdata as T
from rippletrace.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def star(spark):
    edges = [(r.edge_seq, r.source, r.target) for r in T.lineage_edges(spark, FOLDER).collect()]
    nodes = {r.id: (r.node_seq, r.name) for r in T.lineage_nodes(spark, FOLDER).collect()}
    into = {}
    for e, source, target in sorted(edges):
        into.setdefault(target, []).append((e, source))
    return edges, nodes, into


def reach(into, seed, depth=4):
    """node -> (depth, order key, path), in order of discovery."""
    found, level = {}, [(seed, (), (seed,))]
    for d in range(1, depth + 1):
        after = []
        for node, key, path in level:
            for e, source in into.get(node, ()):
                if source != seed and source not in found:
                    found[source] = (d, (*key, e), (*path, source))
                    after.append((source, *found[source][1:]))
        level = after
    return found


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_blast_radius(spark, star):
    want = {s: list(reach(star[2], s)) for s in (f"region:{k}" for k in range(5))}
    got = {r.seed: (r.total_affected, r.first, r.last) for r in rows(spark, "blast_radius")}
    assert got == {s: (len(f), f[0] if f else "", f[-1] if f else "") for s, f in want.items()}
    assert any(last.startswith("lineitem:") for _, _, last in got.values())
    placed = {}
    for r in traverse.blast_radius(T.lineage_edges(spark, FOLDER), T.lineage_nodes(spark, FOLDER), T.region_seeds(spark, FOLDER)).orderBy("seed", "position").collect():
        placed.setdefault(r.seed, []).extend([r.node_id] if r.node_id else [])
    assert placed == want


def test_combined_blast(spark, star):
    seeds = {n: int(n.split(":")[1]) if n.startswith("customer") else 10**8 - int(n.split(":")[1]) for n in star[1] if n.startswith(("customer:", "nation:"))}
    won, first = {}, {}
    for seed, seq in seeds.items():
        for n, (d, key, path) in reach(star[2], seed).items():
            won[n] = min(won.get(n, (99,)), (d, seq, seed, ">".join(path)))
            first[n] = min(first.get(n, (10**9,)), (seq, d, key))
    order = sorted(won, key=lambda n: (won[n][0], first[n]))
    want = [(i, n, won[n][0], won[n][2], won[n][3]) for i, n in enumerate(order, 1)]
    assert sorted((r.out_seq, r.node_id, r.depth, r.seed, r.path) for r in rows(spark, "combined_blast")) == want


def test_direct_dependents(spark, star):
    items = T.read(spark, FOLDER, "lineitem").select("l_partkey", "l_suppkey").collect()
    want = Counter((f"part:{p}", f"supplier:{k}") for p, k in items)
    got = rows(spark, "direct_dependents")
    assert {(r.target, r.id): r.edges for r in got} == want and all(r.name == star[1][r.id][1] for r in got)


def test_induced_subgraph(spark, star):
    edges, _, into = star
    reached = {"region:0", *reach(into, "region:0")}
    want = sorted(e for e in edges if e[1] in reached and e[2] in reached)
    assert 0 < len(want) < len(edges) and sorted(map(tuple, rows(spark, "induced_subgraph"))) == want


def test_graph_views(spark, star):
    edges, nodes, into = star
    changed, affected = {f"region:{k}" for k in range(5)}, {n for n in nodes if n.startswith("nation:")}
    depth = dict.fromkeys(changed, 0)
    for c in changed:
        for n, (d, *_) in reach(into, c, views.SWEEPS).items():
            depth[n] = min(depth.get(n, 99), d)
    assert {r.id: r.depth for r in rows(spark, "graph_view_depth")} == depth
    near = changed | affected
    near = near | {s for _, s, t in edges if t in near} | {t for _, s, t in edges if s in near}
    shown = sorted(near, key=lambda n: nodes[n][0])[: views.MAX_NODES]
    places, want = Counter(), {}
    for n in shown:
        d = depth.get(n, views.FAR)
        want[n] = (d, d * views.COLUMN, places[d] * views.ROW, "changed" if n in changed else "affected" if n in affected else "other")
        places[d] += 1
    assert {r.id: (r.depth, r.x, r.y, r.node_class) for r in rows(spark, "graph_view_layout")} == want
    drawn = {(t, s, t in changed) for _, s, t in edges if s in want and t in want}
    assert {(r.source, r.target, r.animated) for r in rows(spark, "graph_view_edges")} == drawn
