"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
non-ASCII characters. Every window of `ngram` consecutive words of a benchmark
item (an item with fewer words is one window) goes into a sorted array of
64-bit hashes, which is broadcast with the items' words, each once, and the places of the windows in them. Each document's windows are looked up in it,
every hit is verified word by word, and the words inside verified windows are
marked. A benchmark of more than `block_windows` windows is scanned in several
passes, each a job of its own with one bounded broadcast, that add to the marks
written by the one before; no pass shuffles anything, and the driver holds two blocks at most.

Defined cases: null or word-less texts have no words and no hits; null items and
items without words match nothing; repeated rows are judged one by one; an empty
table or benchmark gives empty or clean results; other columns pass through, and
result columns replace columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import arrow_map, cut, extended, free_name, own_names, prepare

NGRAM = 13
#: Windows in one broadcast: 28 bytes each for hash, place and item, and a word of the items' texts.
BLOCK_WINDOWS = 1_500_000
#: A document is contaminated if at least one word in `SHARE` is hit.
SHARE = 20


class _Windows:
    """One broadcast block: the words of its items, and for each window length the sorted hashes, places in the words, and items."""

    def __init__(self):
        self.data, self.size, self.count = [], 0, 0
        self.items: list[str] = []
        self.parts: dict[int, list[tuple]] = defaultdict(list)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}

    def add(self, item: str, words: list[bytes], keys: np.ndarray, length: int) -> None:
        """Windows of `length` words of an item: as many, from its first word on, as there are keys."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = self.size + np.cumsum(sizes + 1) - sizes - 1
        n = len(keys)
        self.parts[length].append((keys, begin[:n], begin[length - 1 : length - 1 + n] + sizes[length - 1 : length - 1 + n], np.full(n, len(self.items), np.int32)))
        text = b" ".join(words)
        self.data.append(text)
        self.size += len(text) + 1
        self.items.append(item)
        self.count += n

    def seal(self) -> "_Windows":
        for length, parts in self.parts.items():
            columns = [np.concatenate(c) for c in zip(*parts)]
            order = np.argsort(columns[0], kind="stable")
            self.by_length[length] = tuple(c[order] for c in columns)
        self.data, self.parts = b" ".join(self.data), {}
        return self

    def found(self, length: int, place: int, text: bytes) -> set[str]:
        """Items with this window, whose hash stands at `place` and maybe behind."""
        keys, begin, end, item = self.by_length[length]
        stop = int(np.searchsorted(keys, keys[place], side="right"))
        return {self.items[item[k]] for k in range(place, stop) if self.data[begin[k] : end[k]] == text}


def _window_hashes(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first word, and hash, of each run of `length` words within a row."""
    if len(hashes) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(len(hashes) - length + 1)
    row_end = np.repeat(first[1:], np.diff(first))
    at = at[at + length <= row_end[at]]
    return at, B.spans_hash(B.prefix(hashes), at, at + length)


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, ngram: int, block_windows: int):
    """Blocks of at most `block_windows` windows, read from the benchmark row by row."""
    block = _Windows()
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        if row.i is None or not row.t:
            continue
        joined = B.Joined([bytes(row.t)])
        starts, ends, first, hashes = joined.word_hashes(B.NOT_ALNUM)
        if not len(starts):
            continue
        low = B.LOWER[joined.data].tobytes()
        words = [low[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        n = min(ngram, len(words))
        _, keys = _window_hashes(hashes, first, n)
        done = 0
        while done < len(keys):  # a long item may fill several blocks
            some = keys[done : done + block_windows - block.count]
            block.add(row.i, words[done : done + len(some) + n - 1], some, n)
            done += len(some)
            if block.count >= block_windows:
                yield block.seal()
                block = _Windows()
    if block.count:
        yield block.seal()


def mark(texts: list[bytes | None], block: _Windows) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: words, merged hit spans in bytes, items found."""
    joined = B.Joined(texts)
    starts, ends, first, hashes = joined.word_hashes(B.NOT_ALNUM)
    out = [(int(n), [], []) for n in np.diff(first)]
    low = None
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for length, (table, *_) in block.by_length.items():
        at, keys = _window_hashes(hashes, first, length)
        if not len(at):
            continue
        place = np.searchsorted(table, keys)
        place[place == len(table)] = 0
        met = table[place] == keys
        for k, p in zip(at[met].tolist(), place[met].tolist()):
            if low is None:
                low = B.LOWER[joined.data].tobytes()
            text = b" ".join(low[a:b] for a, b in zip(starts[k : k + length].tolist(), ends[k : k + length].tolist()))
            if found := block.found(length, p, text):
                row = int(np.searchsorted(first, k, side="right")) - 1
                hits[row].append((k, k + length))
                items[row].update(found)
    for row, windows in hits.items():
        spans: list[list[int]] = []
        for a, b in sorted(windows):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        base = int(joined.start[row])
        out[row] = (out[row][0], [(int(starts[a]) - base, int(ends[b - 1]) - base) for a, b in spans], sorted(items[row]))
    return out


def _count_words(text: bytes, spans: list[tuple[int, int]]) -> int:
    return sum(len(B.Joined([text[a:b]]).words(B.NOT_ALNUM)[0]) for a, b in spans)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_STATE = "array<struct<s:int,e:int>>"
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def scan(documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """documents with hit_spans (byte offsets), n_words, n_hit, items, contaminated, clean_text."""
    spark = prepare(documents.sparkSession)
    added = ["n_words", "n_hit", "hit_spans", "items", "contaminated", "clean_text"]
    keep = [c for c in documents.columns if c not in added]
    df = documents.select(*keep) if text_col in keep else documents
    kept, at, state = df.schema, df.columns.index(text_col), free_name(df, "hits")
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, ngram, block_windows)
    block = next(blocks, None)
    while (following := next(blocks, None)) is not None:
        # One broadcast at a time: the marks so far are written before the next block is sent.
        sent = spark.sparkContext.broadcast(block)
        step = extended(kept, f"`{state}` {_STATE}, `{state}_i` array<string>")
        df = cut(arrow_map(df, lambda batches, sent=sent: _mark_pass(batches, sent.value, at, len(kept), [state, state + "_i"]), step))
        sent.unpersist()
        block = following
    sent = spark.sparkContext.broadcast(block)
    last = extended(kept, f"n_words bigint, n_hit bigint, hit_spans {_STATE}, items array<string>, contaminated boolean, clean_text string")
    return arrow_map(df, lambda batches: _finish_pass(batches, sent.value, at, len(kept)), last)


def _marked(batches, block: _Windows | None, at: int, width: int):
    """(rows, texts, spans, items) of each slice, with the marks of earlier blocks, which stand behind the first `width` columns."""
    for batch in batches:
        for a, b in B.slices(batch.column(at)):
            part = batch.slice(a, b - a)
            texts = B.binary(part.column(at))
            old = [part.column(k).to_pylist() for k in (width, width + 1)] if batch.num_columns > width else [[None] * len(texts)] * 2
            new = mark(texts, block) if block else [(0, [], [])] * len(texts)
            spans = [_merge(s + [(d["s"], d["e"]) for d in s0 or ()]) for (_, s, _), s0 in zip(new, old[0])]
            yield part, texts, spans, [sorted({*i, *(i0 or ())}) for (_, _, i), i0 in zip(new, old[1])]


def _as_spans(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"s": x, "e": y} for x, y in s] for s in spans], _SPANS)


def _mark_pass(batches, block, at, width, names):
    for part, _, spans, items in _marked(batches, block, at, width):
        yield pa.RecordBatch.from_arrays([*part.columns[:width], _as_spans(spans), pa.array(items, pa.list_(pa.string()))], names=[*part.schema.names[:width], *names])


def _finish_pass(batches, block, at, width):
    for part, texts, spans, items in _marked(batches, block, at, width):
        words = np.diff(B.Joined(texts).words(B.NOT_ALNUM)[2]).tolist()
        n_hit = [_count_words(text, s) if s else 0 for text, s in zip(texts, spans)]
        clean = []
        for text, s in zip(texts, spans):
            if s:
                cuts = [0, *(x for pair in s for x in pair), len(text)]
                text = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2]))
            clean.append(text)
        bad = [h > 0 and SHARE * h >= w for h, w in zip(n_hit, words)]
        extra = [pa.array(words, pa.int64()), pa.array(n_hit, pa.int64()), _as_spans(spans), pa.array(items, pa.list_(pa.string())), pa.array(bad, pa.bool_()), pa.array(clean, pa.binary()).cast(pa.string())]
        names = ["n_words", "n_hit", "hit_spans", "items", "contaminated", "clean_text"]
        yield pa.RecordBatch.from_arrays([*part.columns[:width], *extra], names=[*part.schema.names[:width], *names])


def report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The contract's columns, one row per document."""
    found = scan(documents.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


def remove(documents: DataFrame, benchmark: DataFrame, *, spans: bool = False, **options) -> DataFrame:
    """Clean documents with their own columns; with `spans`, hit spans go and the documents stay."""
    plain, text = own_names(documents, options.pop("text_col", "text"))
    found = scan(plain, benchmark, text_col=text, **options)
    if not spans:
        found = found.where(~F.col("contaminated"))
    else:
        found = found.withColumn(text, F.col("clean_text"))
    return found.select(*[F.col(a).alias(b) for a, b in zip(plain.columns, documents.columns)])
