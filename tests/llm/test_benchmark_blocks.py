"""Benchmark blocks of full size: compact, split anywhere, and equal to plain sets of windows."""

import pickle
import random
import re

from pyspark.sql import functions as F

from rippletrace.llm import decontaminate as D


def words(rng, n, size):
    return " ".join(f"Word{rng.randrange(size)}" for _ in range(n))


def test_a_block_of_very_many_windows_is_small(spark):
    n = 6000
    bench = spark.range(n).select(F.concat(F.lit("i"), "id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(92)), lambda k: F.concat(F.lit("w"), F.conv(F.substring(F.md5(F.concat("id", F.lit("-"), k)), 1, 5), 16, 10))), " ").alias("text"))
    (block,) = D.benchmark_blocks(bench, "item_id", "text", 13, D.BLOCK_WINDOWS)
    assert block.count == 80 * n and len(pickle.dumps(block)) < 60 * block.count
    assert sum(c.nbytes for c in block.by_length[13]) + len(block.data) < 60 * block.count
    row = bench.where("item_id = 'i4321'").first()
    ((count, spans, items),) = D.mark([f"before {row.text.upper()} after".encode()], block)
    assert items == ["i4321"] and count == 94 and spans == [(7, 7 + len(row.text))]


def test_blocks_split_anywhere_and_windows_of_many_items(spark):
    rng = random.Random(6)
    shared = words(rng, 20, 10**6)
    items = [(str(k), words(rng, rng.choice([1, 3, 12, 13, 14, 40]), 30) if k % 3 else shared) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [words(rng, 60, 30) for _ in range(40)] + [f"x {shared} y", " ".join(t for _, t in items[:9])]
    lower = lambda t: re.findall("[a-z0-9]+", t.lower())
    windows = {}
    for i, t in items:
        w = lower(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for t in texts:
        w, hit, met = lower(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    met |= found
        want.append((len(w), len(hit), sorted(met)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (10**6, 7, 100):
        got = D.scan(docs, bench, block_windows=size).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, sorted(r["items"])) for r in got] == want
