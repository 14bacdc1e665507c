"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two suffixes that agree in their first `depth` bytes are a repeated window. The
suffixes are grouped digit by digit, the most significant digit first, and a
group of one is never looked at again, so no suffix is read past the first digit
that sets it apart or past `depth`:

1. First digit: a gram of `GRAM` bytes. Every window of `depth` bytes is keyed by
   the least gram hash inside it (leftmost on ties), so equal windows have equal
   grams at equal offsets, and about one position in 85 speaks for all suffixes
   of the 169 windows around it. Grams that occur once end here.
2. Second digit: the whole context of a gram, which is all that windows holding
   it can reach. Equal contexts are repeated windows throughout.
3. Grams with several contexts: the suffixes of all windows in one context of
   each kind are sorted in passes of `DIGIT` bytes to the full depth. Groups
   that remain are repeated windows. Grams with over `WIDE` contexts have their
   windows grouped by an aggregation over the cluster instead of in one task.

Counts are combined before they are shuffled and occurrences are found again by
equi-joins, so a gram in a third of all documents is split like any skewed key.
Digits are compared as fingerprints: a gram and its context by 128 bits together, windows by
128 bits. The text itself is shuffled once, compressed, next to the spans found.

Defined cases: null and empty texts have no bytes; texts under `depth` bytes are
kept whole; repeated rows are copies of each other; an empty table gives an empty
result; other columns pass through `remove`. Removal is judged on bytes, so
`remove` decodes what is left with replacement of cut characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import arrow_map, cut, own_names, prepare

DEPTH = 200
GRAM, DIGIT = 32, 40
#: Contexts of one gram that one task may hold; contexts sorted at once; shares of a gram with more.
WIDE, TOGETHER, SALTS = 4096, 8192, 256
#: Bytes whose grams are hashed at once: arrays of eight bytes for each that stay in a core's cache.
SLICE = 120_000
U = B.U


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    done, out = 1, keys
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if width > done:
        out = np.minimum(out[: len(out) - (width - done)], out[width - done :])
    return out


def anchors(joined: B.Joined, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, gram hash and context hash of every gram that is the least of some window."""
    empty = np.empty(0, np.int64)
    window = depth - GRAM + 1
    if not (joined.size >= depth).any():
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    sums = B.prefix(B.BYTE_VALUE[joined.data])
    start = np.arange(len(joined.data) - GRAM + 1)
    grams = B.spans_hash(sums, start, start + GRAM)
    bits = U(32)  # the same in every slice, so equal windows have equal keys up to their place
    keys = (grams >> bits << bits) | start.astype(np.uint64)
    least = _least(keys, window)
    inside = np.zeros(len(least) + 1, np.int32)
    long = joined.size >= depth
    np.add.at(inside, joined.start[long], 1)
    np.add.at(inside, joined.start[long] + joined.size[long] - depth + 1, -1)
    least = least[np.cumsum(inside[:-1]) > 0]
    place = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    place = np.unique(place[np.concatenate([[True], place[1:] != place[:-1]])])
    row = np.searchsorted(joined.start, place, side="right") - 1
    lo = np.maximum(joined.start[row], place - (depth - GRAM))
    hi = np.minimum(joined.start[row] + joined.size[row], place + depth)
    context = B.mix(B.spans_hash(sums, lo, hi) + (place - lo).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    return row, place - joined.start[row], grams[place], context


def _anchor_pass(batches, depth: int, contexts: bool):
    for batch in batches:
        for a, b in B.slices(batch.column(2), SLICE):
            part = batch.slice(a, b - a)
            row, place, gram, context = anchors(B.Joined(B.binary(part.column(2))), depth)
            columns = [pa.array(gram.view(np.int64))]
            if contexts:
                take = pa.array(row)
                columns += [pa.array(context.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "c", "k", "t", "p"][: len(columns)])


def _pack_pass(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        z = [pack(t or b"") for t in B.binary(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=["k", "t", "z"])


def _context_pass(batches, depth: int):
    """(k, t, z, found[a, c, p, kinds]) -> contexts of the grams found; `salt` spreads grams of many contexts, and is 0 for others."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for k, t, z, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
            text = unpack(z) if found else b""
            for f in found or ():
                lo = max(0, f["p"] - (depth - GRAM))
                salt = 1 + f["c"] % SALTS if f["kinds"] > WIDE else 0
                for column, value in zip(out, (f["a"], salt, k, t, f["p"], f["p"] - lo, text[lo : f["p"] + depth])):
                    column.append(value)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, types)], names=["a", "salt", "k", "t", "p", "left", "context"])


def _windows(contexts: list[bytes], left: np.ndarray, depth: int):
    """Bytes, their sums, and context number, offset before the gram and start of every window that holds the gram."""
    joined = B.Joined(contexts)
    first = np.maximum(0, left - (depth - GRAM))
    last = np.minimum(left, joined.size - depth)
    n = np.maximum(0, last - first + 1)
    i = np.repeat(np.arange(len(contexts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[i]
    return joined.data, B.prefix(B.BYTE_VALUE[joined.data]), i, left[i] - at, joined.start[i] + at


def repeated(gram: np.ndarray, contexts: list[bytes], left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context number and offset of the windows that two contexts of a gram share: the digit passes of step 3.

    Passes group by a 64-bit key; what is left after the last one is held against a second, independent 64 bits.
    """
    data, sums, i, offset, start = _windows(contexts, left, depth)
    group = B.mix(gram[i] + offset.astype(np.uint64) * U(0x9FB21C651E98DF25))
    alive = np.arange(len(i))
    for digit in range(0, depth, DIGIT):
        if not len(alive):
            break
        s = start[alive] + digit
        key = B.mix(group[alive] ^ (B.spans_hash(sums, s, s + min(DIGIT, depth - digit)) * U(0xA24BAED4963EE407)))
        order = np.argsort(key)
        ranked = key[order]
        same = np.zeros(len(ranked), bool)
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        group[alive] = key
        alive = np.sort(alive[order[same]])
    if len(alive):
        other = B.prefix(B.OTHER_VALUE[data])
        key = B.mix(B.spans_hash(other, start[alive], start[alive] + depth) + group[alive])
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        alive = np.sort(alive[order[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]])
    return i[alive], offset[alive]


_HIT = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _merged(starts: np.ndarray, depth: int) -> list[dict]:
    edge = np.flatnonzero(np.diff(starts) > depth)
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(starts) - 1]])
    return [{"s": int(starts[a]), "e": int(starts[b]) + depth} for a, b in zip(first, last)]


def _sort_pass(batches, depth: int):
    """Contexts sorted by gram -> spans of their rows."""
    held: list[tuple] = []

    def flush():
        gram = np.array([h[0] for h in held], np.int64).view(np.uint64)
        i, offset = repeated(gram, [h[6] for h in held], np.array([h[5] for h in held], np.int64), depth)
        order = np.argsort(i, kind="stable")
        i, offset = i[order], offset[order]
        who, begin = np.unique(i, return_index=True)
        end = np.append(begin[1:], len(i))
        rows = [(held[c][2], held[c][3], _merged(np.sort(held[c][4] - offset[a:b]), depth)) for c, a, b in zip(who.tolist(), begin, end)]
        types = (pa.int64(), pa.int64(), _HIT)
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(types)], names=["k", "t", "spans"])

    for batch in batches:
        for row in zip(*(batch.column(j).to_pylist() for j in range(7))):
            if row[1]:
                continue
            if len(held) >= TOGETHER and row[0] != held[-1][0]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def _window_pass(batches, depth: int):
    """Contexts -> one row for each window: fingerprint of 128 bits, and whose it is."""
    for batch in batches:
        batch = batch.filter(pc.greater(batch.column(1), 0))
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            gram = np.array(part.column(0).to_pylist(), np.int64).view(np.uint64)
            data, sums, i, offset, start = _windows(part.column(6).to_pylist(), np.array(part.column(5).to_pylist(), np.int64), depth)
            key = B.mix(B.spans_hash(sums, start, start + depth) ^ B.mix(gram[i] + offset.astype(np.uint64)))
            other = B.spans_hash(B.prefix(B.OTHER_VALUE[data]), start, start + depth)
            take, place = pa.array(i), np.array(part.column(4).to_pylist(), np.int64)[i] - offset
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), part.column(2).take(take), part.column(3).take(take), pa.array(place.astype(np.int32))], names=["w", "w2", "k", "t", "s"])


def found_spans(texts: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """texts(k, t, text) -> packed texts (k, t, z), and (k, t, spans) of the rows with repeated windows."""
    occurrences = lambda contexts, body: arrow_map(texts, lambda batches: _anchor_pass(batches, depth, contexts), body)
    # Counts are written before they are joined: both sides of the join are then plain shuffles, whose hot keys adaptive execution splits.
    often = cut(occurrences(False, "a bigint").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    known = cut(occurrences(True, "a bigint, c bigint, k bigint, t bigint, p int").join(often, "a"))
    # One occurrence speaks for a context; the three values are those of one row, as all are taken from the first one met.
    kinds = cut(known.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in ("k", "t", "p")]))
    whole = known.join(kinds.where("n > 1").select("a", "c"), ["a", "c"], "left_semi")
    whole = whole.groupBy("k", "t").agg(F.collect_set("p").alias("places")).select("k", "t", F.transform("places", lambda p: F.struct(F.greatest(p - (depth - GRAM), F.lit(0)).alias("s"), (p + depth).alias("e"))).alias("spans"))
    mixed = cut(kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    one = cut(kinds.join(mixed, "a").select("a", "c", "k", "t", "p", "kinds"))
    packed = arrow_map(texts, _pack_pass, "k bigint, t bigint, z binary")
    asked = one.groupBy("k", "t").agg(F.collect_list(F.struct("a", "c", "p", "kinds")).alias("found"))
    # The outer join keeps the plan of the packed side as the final join has it, so one shuffle of the texts serves both.
    contexts = arrow_map(packed.join(asked, ["k", "t"], "left").select("k", "t", "z", "found"), lambda batches: _context_pass(batches, depth), "a bigint, salt int, k bigint, t bigint, p int, left int, context binary")
    dealt = contexts.repartition("a", "salt")
    sorted_spans = arrow_map(dealt.sortWithinPartitions("a"), lambda batches: _sort_pass(batches, depth), "k bigint, t bigint, spans array<struct<s:int,e:int>>")
    windows = arrow_map(dealt, lambda batches: _window_pass(batches, depth), "w bigint, w2 bigint, k bigint, t bigint, s int")
    shared = windows.groupBy("w", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "w2")
    hit = windows.join(shared, ["w", "w2"], "left_semi").groupBy("k", "t").agg(F.collect_set("s").alias("starts"))
    wide_spans = hit.select("k", "t", F.transform("starts", lambda s: F.struct(s.alias("s"), (s + depth).alias("e"))).alias("spans"))
    spans = whole.unionByName(sorted_spans)
    if not one.where(F.col("kinds") > WIDE).isEmpty():
        spans = spans.unionByName(wide_spans)
    return packed, spans.groupBy("k", "t").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut_text(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal removed runs."""
    runs: list[list[int]] = []
    for s, e in sorted((d["s"], min(d["e"], len(text))) for d in spans or ()):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), sum(b - a for a, b in runs), len(runs)


def _final_pass(batches, width: int):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        text = [unpack(z) for z in batch.column(width).to_pylist()]
        done = [_cut_text(t, s) for t, s in zip(text, batch.column(width + 1).to_pylist())]
        columns = [*batch.columns[:width], pa.array([len(t) for t in text], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
        columns += [pa.array([hashlib.sha256(d[0]).hexdigest() for d in done]), pa.array([d[0].decode("utf-8", "replace") for d in done], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept), one row per document."""
    prepare(documents.sparkSession)
    # A row is named by its id and 63 bits of its text; without an id by 127 bits of the text, and an odd t.
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    t = F.shiftleft(F.xxhash64(text), 1) + own.isNull().cast("long")
    texts = documents.select(F.coalesce(own, F.xxhash64(F.lit(1), text)).alias("k"), t.alias("t"), text.alias("text"))
    packed, spans = found_spans(texts, depth)
    rows = packed.join(spans, ["k", "t"], "left").select("k", "t", "z", "spans")
    out = arrow_map(rows, lambda batches: _final_pass(batches, 2), "k bigint, t bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    return out.select(F.when(F.col("t") % 2 == 0, F.col("k")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def remove(documents: DataFrame, *, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """Documents with repeated strings cut from their texts."""
    prepare(documents.sparkSession)
    plain, text = own_names(documents, text_col)
    keyed = plain.withColumn("k", F.xxhash64(*[F.col(c).cast("string") for c in plain.columns])).withColumn("t", F.xxhash64(text))
    packed, spans = found_spans(keyed.select("k", "t", F.col(text).alias("text")), depth)
    cutting = spans.join(packed, ["k", "t"]).dropDuplicates(["k", "t"]).select("k", "t", "z", "spans")
    done = arrow_map(cutting, lambda batches: _final_pass(batches, 2), "k bigint, t bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    out = keyed.join(done.select("k", "t", "kept"), ["k", "t"], "left")
    return out.select(*[F.coalesce("kept", text).alias(c) if a == text else F.col(a).alias(c) for a, c in zip(plain.columns, documents.columns)])


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return scan(documents.select("doc_id", "text")).drop("kept")
