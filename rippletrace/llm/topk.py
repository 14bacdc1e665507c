"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Vectors are dealt into blocks, queries into groups, and each (block, group) pair
meets in one task. A block keeps one list per dimension, sorted by component. A
query reads a list from its top if its own component is positive, from its
bottom if negative, always in order and `1 / PARTS` of a list at a time. Entries
read add to the partial score of their vector, once each. What a vector has not shown yet
lies between the far end of each list and the component read last, which bounds its
score from below and above. Reading stops for a query when every vector outside its
candidates has an upper bound under the k-th best lower bound and at most `FEW`
candidates are left, or at the lists' ends, where all bounds are exact; the
candidates' final scores are then resolved, and ties go to the smaller id. Entries that
were read are counted. The k best of all blocks meet in one window per query.

A part of the lists enters the partial scores of all queries of a group as one matrix
product, zero where nothing was read.

Defined cases: rows with a null id, a null vector, an empty vector or null or
non-finite components take no part; shorter vectors count as padded with zeros;
a query never meets rows of its own id; repeated rows are candidates each; a
repeated query id is asked once, with its first vector in order; fewer than k
candidates give fewer ranks; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, prepare

K, EVERY, SCALE = 5, 50, 256
#: Vectors of a block and queries of a group that meet in one task.
BLOCK, GROUP = 4096, 512
#: Parts in which a list is read, and candidates that end the reading.
PARTS, FEW = 8, 200
#: Scores up to this size are exact in floating point; larger ones are added as Python integers, by the same steps.
EXACT = 2.0**52


def _padded(rows: list[list[int]], width: int) -> np.ndarray:
    if all(len(r) == width for r in rows):
        return np.array(rows, np.int64).reshape(len(rows), width)
    return np.array([r + [0] * (width - len(r)) for r in rows], np.int64)


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K) -> tuple[list[tuple[int, int, int]], int]:
    """(query id, id, score) of each query's k best in this block, and the list entries that were read."""
    (n, d), columns = vectors.shape, np.arange(vectors.shape[1])
    largest = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(1, d)
    kind = np.float64 if largest < EXACT else object
    lists = np.argsort(vectors, axis=0, kind="stable")
    x, y = vectors.astype(kind), queries.astype(kind)
    high, low = np.maximum(y, 0).T, np.minimum(y, 0).T  # what each query has for lists read from the top, and from the bottom
    first, last = x[lists[0], columns], x[lists[-1], columns]
    own: dict[int, list[int]] = {}
    for j, i in enumerate(ids.tolist()):
        own.setdefault(i, []).append(j)

    partial, active = np.zeros((n, len(queries)), kind), np.arange(len(queries))
    unread_top, unread_bottom = np.ones((n, d), kind), np.ones((n, d), kind)
    out: list[tuple[int, int, int]] = []
    read = done = 0
    while len(active):
        depth = min(n, done + max(1, -(-n // PARTS)))
        for some, unread, side in ((lists[n - depth : n - done], unread_top, high), (lists[done:depth], unread_bottom, low)):
            new = np.zeros((n, d), kind)
            np.put_along_axis(new, some, np.take_along_axis(x, some, 0), 0)
            np.put_along_axis(unread, some, 0, 0)
            partial = partial + new @ side
        read += (depth - done) * int(np.count_nonzero(high) + np.count_nonzero(low))
        done = depth
        best = partial + (unread_top * x[lists[n - depth], columns]) @ high + (unread_bottom * x[lists[depth - 1], columns]) @ low
        least = partial + (unread_top * first) @ high + (unread_bottom * last) @ low
        for c, q in enumerate(active.tolist()):
            if (at := own.get(int(query_ids[q]))) is not None:
                best[at, c] = least[at, c] = -np.inf
        if n > k:
            reach = (np.partition(least, n - k, axis=0) if kind is np.float64 else np.sort(least, axis=0))[n - k]
        else:
            reach = np.full(len(active), -np.inf)
        inside = best >= reach
        stop = (inside.sum(0) <= FEW) | (done == n)
        for c in np.flatnonzero(stop).tolist():
            q, some = int(active[c]), np.flatnonzero(inside[:, c])
            some = some[ids[some] != query_ids[q]]
            scores = x[some] @ y[q]
            for r in sorted(range(len(some)), key=lambda r: (-scores[r], ids[some[r]]))[:k]:
                out.append((int(query_ids[q]), int(ids[some[r]]), int(scores[r])))
        active, partial, high, low = active[~stop], partial[:, ~stop], high[:, ~stop], low[:, ~stop]
    return out, read


def _meet_pass(batches, k: int):
    """Rows (block, group, is_query, id, vector), sorted -> (query_id, vec_id, score)."""
    place, held = None, ([], [])

    def flush():
        vectors, queries = held
        if not vectors or not queries:
            return None
        width = max(len(v) for _, v in vectors + queries)
        seen: dict[int, list[int]] = {}
        for i, v in sorted(queries):
            seen.setdefault(i, v)
        found, _ = block_top(np.array(list(seen), np.int64), _padded(list(seen.values()), width), np.array([i for i, _ in vectors], np.int64), _padded([v for _, v in vectors], width), k)
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    for batch in batches:
        for b, g, is_query, i, v in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if (b, g) != place:
                if (out := flush()) is not None:
                    yield out
                place, held = (b, g), ([], [])
            held[is_query].append((i, v))
    if (out := flush()) is not None:
        yield out


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) over components floor(scale * x)."""
    prepare(vectors.sparkSession)
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(whole)
    rows = usable.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("x"), is_query.alias("q"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-asked // GROUP))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    base = rows.select(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int").alias("b"), spread(groups).alias("g"), F.lit(0).alias("is_query"), "id", "x")
    queries = rows.where("q").select(spread(blocks).alias("b"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(1).alias("is_query"), "id", "x")
    dealt = base.unionByName(queries).repartition("b", "g").sortWithinPartitions("b", "g")
    found = arrow_map(dealt, lambda batches: _meet_pass(batches, k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    return top_k(vectors.select("vec_id", "embedding"), F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)))
