"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct word shingles (A-Z lower-cased, words split
at ASCII white space; a text of fewer words is one shingle). Two documents link
when 100 * |x & y| >= percent * |x | y|. The result is exact:

1. Frequency hints. Shingles that meet again within a few thousand documents
   are counted; the `HINTS` most frequent ones are the frequent class. Hints
   only order tokens, so their bound changes speed, never links.
2. Equal sets are grouped by a 128-bit fingerprint; one row of each goes on.
3. Prefixes. Tokens are ordered rare first. A set of n tokens with least
   overlap a = ceil(percent * n / 100) takes a prefix of n - a + 1 + m tokens,
   so two linked sets share at least 1 + m tokens of their prefixes. Rare tokens
   are indexed alone; frequent ones fall into m classes and are indexed as
   pairs within a class. Of 1 + m shared tokens, either one is rare or two fall
   into one class: a linked pair always shares a key. m grows with n, which
   keeps the pairs of a set in proportion to n; sets near a step of m index
   under both values.
4. Keys held by one set only are dropped after a count that is combined before
   the shuffle. In groups of at most `SKETCHED` sets, entries whose neighbours by
   size are too small or too large to link go too, and what is left is held against
   bucket counts: a set counts its tokens in about n / 4 hash buckets, and the sum of
   bucket minima is an upper bound of an overlap, so pairs it rules out cannot link.
   Entries of larger groups all go on; no window or list holds such a group.
5. Sets that still share keys form clusters, and each cluster is verified whole:
   its texts travel once, compressed, and pairs are compared inside a task as products of
   incidence matrices. Clusters over `BLOCK` sets are cut into blocks and
   compared block by block; clusters over `CLUSTER` sets go by key group
   instead, each distinct list of members once. Key groups over `BLOCK` sets
   compare each block with itself first; then only sets outside a group's
   largest component meet the rest, so a large group of near copies costs rows
   in proportion to its size. Rows come out only for links.

Defined cases: null and word-less texts have an empty set, link with nothing and
are their own component; rows with a null id link with nothing and have a null
component; rows that share an id are judged one by one by their texts; an empty
table gives an empty result; other columns are ignored, and pass through `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import _bytes as B
from ._common import arrow_map, cut, own_names, prepare
from .components import components

WIDTH, PERCENT = 5, 80
#: Frequent shingles that are broadcast (16 bytes each), and the least count of one.
HINTS, FREQUENT = 1 << 19, 2
#: Count of a hinted shingle from which it is indexed in pairs.
PAIRED = 64
#: Shingles gathered before they are counted in the hint pass.
CHUNK = 2_000_000
#: Sets, and tokens, that are compared within one task; larger groups are split into blocks.
BLOCK, BLOCK_TOKENS = 1024, 1_500_000
#: Sets of the largest key group whose pairs are held against bucket counts; entries of larger ones all go on.
SKETCHED = 512
#: Sets of the largest cluster that is verified whole.
CLUSTER = 4096
#: Rows of the cluster table that may be broadcast (about 40 bytes each); a larger one is joined by shuffles.
BROADCAST_ROWS = 300_000
U = B.U


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    joined = B.Joined(texts)
    _, _, first, words = joined.word_hashes(B.SPACE)
    counts = np.diff(first)
    if not len(words):
        return [np.empty(0, np.uint64)] * len(texts)
    sums = B.prefix(words)
    at = np.arange(max(0, len(words) - width + 1))
    row_end = np.repeat(first[1:], counts)
    at = at[at + width <= row_end[at]]
    full = B.spans_hash(sums, at, at + width)
    begin = np.searchsorted(at, first)
    short = B.spans_hash(sums, first[:-1], first[1:])
    out = []
    for i, n in enumerate(counts.tolist()):
        out.append(np.unique(full[begin[i] : begin[i + 1]]) if n >= width else short[i : i + 1] if n else full[:0])
    return out


def _sets(batches, text_col: str, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        col = batch.schema.get_field_index(text_col)
        for a, b in B.slices(batch.column(col)):
            part = batch.slice(a, b - a)
            yield part, shingle_sets(B.binary(part.column(col)), width)


def _seal(x: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set."""
    return int(np.bitwise_xor.reduce(B.mix(x * U(0xA24BAED4963EE407)))), int(np.add.reduce(B.mix(x + U(0x9FB21C651E98DF25))))


def _hint_pass(batches, width: int):
    held: list[np.ndarray] = []
    seen: set[tuple[int, int]] = set()

    def counted():
        every = np.concatenate(held)
        held.clear(), seen.clear()
        every.sort()
        edge = np.append(np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])), len(every))
        n = np.diff(edge)
        keys, n = every[edge[:-1][n > 1]], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    size = 0
    for _, sets in _sets(batches, "text", width):
        for x in sets:
            if len(x) > 1 and (key := _seal(x)) not in seen:
                seen.add(key)
                held.append(x)
                size += len(x)
        if size >= CHUNK:
            yield counted()
            size = 0
    if held:
        yield counted()


def _classes(n: int) -> int:
    return max(1, (1 << n.bit_length() - 1) >> 5)


def keys_of(x: np.ndarray, percent: int, hint_keys: np.ndarray, hint_counts: np.ndarray) -> np.ndarray:
    """The index keys of one set, as in step 3."""
    n = len(x)
    if n < 2:
        return np.empty(0, np.uint64)
    count = np.zeros(n, np.int64)
    if len(hint_keys):
        place = np.searchsorted(hint_keys, x)
        place[place == len(hint_keys)] = 0
        same = hint_keys[place] == x
        count[same] = hint_counts[place[same]]
    order = np.lexsort((B.mix(x), count))
    slack = n - (percent * n + 99) // 100
    out = []
    sizes = sorted({_classes(n), _classes(n * 100 // percent)})
    longest = order[: slack + 1 + sizes[-1]]
    out.append(x[longest[count[longest] < PAIRED]])
    for m in sizes:
        prefix = order[: slack + 1 + m]
        often = x[prefix[count[prefix] >= PAIRED]]
        kind = (B.mix(often) % U(m)).astype(np.int64)
        for c in np.unique(kind):
            own = np.sort(often[kind == c])
            i, j = np.triu_indices(len(own), 1)
            if len(i):
                out.append(B.mix(own[i] * U(0xC2B2AE3D27D4EB4F) + B.mix(own[j] + U(m))))
    return np.unique(np.concatenate(out))


def sketch(x: np.ndarray) -> bytes:
    """Token counts of a set in 2**k buckets: about four tokens each, sixteen in long sets. The last byte tells the width."""
    buckets = 1 << max(3, (len(x) >> (4 if len(x) > 1024 else 2)).bit_length())
    counts = np.bincount((B.mix(x) & U(buckets - 1)).astype(np.int64), minlength=buckets)
    most = counts.max(initial=0)
    if most < 16:
        return (counts[::2] << 4 | counts[1::2]).astype(np.uint8).tobytes() + b"\0"
    return counts.astype(np.uint8 if most < 256 else np.uint32).tobytes() + (b"\1" if most < 256 else b"\4")


def _buckets(raw: bytes) -> int:
    return (len(raw) - 1) * 2 if raw[-1] == 0 else (len(raw) - 1) // raw[-1]


def _counts(raw: bytes, buckets: int) -> np.ndarray:
    c = np.frombuffer(raw[:-1], np.uint32 if raw[-1] == 4 else np.uint8).astype(np.int32)
    if raw[-1] == 0:
        c = np.stack([c >> 4, c & 15], 1).ravel()
    while len(c) > buckets:
        c = c[: len(c) // 2] + c[len(c) // 2 :]
    return c


def possible(sizes: list[int], sketches: list[bytes], percent: int) -> np.ndarray:
    """Which sets of a group can link with another one, by sizes and bucket counts."""
    n = np.array(sizes, np.int64)
    out = np.zeros(len(n), bool)
    least = min(map(_buckets, sketches))
    c = np.stack([_counts(x, least) for x in sketches])
    for i in range(len(n) - 1):
        top = np.minimum(c[i], c[i + 1 :]).sum(1)
        ok = 100 * top >= percent * (n[i] + n[i + 1 :] - top)
        if ok.any():
            out[i] = True
            out[i + 1 :] |= ok
    return out


def _possible_pass(batches, percent: int):
    """Rows (key, id, n, sketch) sorted by key -> the entries that can link within their key group."""
    key, wide, ids, sizes, sketches = None, False, [], [], []

    def flush():
        keep = np.full(len(ids), True) if wide else possible(sizes, sketches, percent) if len(ids) > 1 else np.zeros(len(ids), bool)
        own = [i for i, ok in zip(ids, keep.tolist()) if ok]
        for held in (ids, sizes, sketches):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.int64()), pa.array(own, pa.int64())], names=["key", "id"])

    for batch in batches:
        for k, i, n, c in zip(*(batch.column(j).to_pylist() for j in range(4))):
            if k != key:
                yield flush()
                key, wide = k, False
            elif len(ids) == SKETCHED:  # a larger group passes whole, a piece at a time
                wide = True
                yield flush()
            ids.append(i)
            sizes.append(n)
            sketches.append(c)
    yield flush()


def _key_pass(batches, width: int, percent: int, sent):
    hint_keys, hint_counts = sent.value
    for part, sets in _sets(batches, "text", width):
        seals = [_seal(x) for x in sets]
        keys = [keys_of(x, percent, hint_keys, hint_counts) for x in sets]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        columns = [part.column(part.schema.get_field_index(c)) for c in ("id", "t1", "t2")] + [pa.array([len(x) for x in sets], pa.int64())]
        columns += [pa.array(np.array([s[i] for s in seals], np.uint64).view(np.int64)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))), pa.array([sketch(x) for x in sets], pa.binary())], names=["id", "t1", "t2", "n", "s1", "s2", "keys", "sketch"])


def _pack_pass(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t or b"") for t in B.binary(batch.column(1))], pa.binary())], names=["id", "z"])


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the number of the first set of its component."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0 if 100 * common >= percent * (int(size.sum()) - common) else 1])
    _, token, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    often = met[token] > 1
    column = np.cumsum(met > 1) - 1
    row, token = row[often], column[token[often]]
    common = np.zeros((n, n), np.float32)
    step = 4096
    by = np.argsort(token, kind="stable")
    row, token = row[by], token[by]
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        a, b = np.searchsorted(token, [lo, lo + step])
        x = np.zeros((n, min(step, int(token[-1]) + 1 - lo)), np.float32)
        x[row[a:b], token[a:b] - lo] = 1
        common += x @ x.T
    whole = size[:, None] + size[None, :] - common
    i, j = np.nonzero(np.triu((100 * common.astype(np.float64) >= percent * whole) & (common > 0), 1))
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
    return np.array([find(i) for i in range(n)])


def _verify_pass(batches, width: int, percent: int):
    """Rows sorted by their group columns -> (u, v): each set that links, and the first set of its component."""
    unpack = zstandard.ZstdDecompressor().decompress
    group, ids, members = None, [], []

    def flush():
        if len(ids) < 2:
            return None
        by = sorted(range(len(ids)), key=ids.__getitem__)
        first = linked([members[k] for k in by], percent)
        pairs = [(ids[by[k]], ids[by[f]]) for k, f in enumerate(first.tolist()) if f != k]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"]) if pairs else None

    for batch in batches:
        for lo in range(0, batch.num_rows, 50):
            part = batch.slice(lo, 50)
            sets = shingle_sets([unpack(z) for z in part.column(4).to_pylist()], width)
            for key, a, b, i, x in zip(*(part.column(k).to_pylist() for k in range(4)), sets):
                if (key, a, b) != group:
                    if (out := flush()) is not None:
                        yield out
                    group, ids, members = (key, a, b), [], []
                ids.append(i)
                members.append(x)
    if (out := flush()) is not None:
        yield out


def _verified(rows: DataFrame, width: int, percent: int) -> DataFrame:
    dealt = rows.select("key", "a", "b", "id", "z").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return arrow_map(dealt, lambda batches: _verify_pass(batches, width, percent), "u bigint, v bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """(key, id, g, tokens) -> (key, a, b, id): each pair of blocks a <= b of a group meets in one task."""
    n = F.greatest(F.ceil(F.col("g") * 2 / BLOCK), F.ceil(F.col("tokens") * 2 / BLOCK_TOKENS))
    n = F.when((F.col("g") <= BLOCK) & (F.col("tokens") <= BLOCK_TOKENS), F.lit(1)).otherwise(n).cast("long")
    rows = rows.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id")


def _hints(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    counted = arrow_map(texts, lambda batches: _hint_pass(batches, width), "h bigint, n bigint")
    top = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(HINTS).toArrow()
    keys, counts = (np.asarray(top.column(c).to_numpy(), np.int64) for c in ("h", "n"))
    by = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[by], counts[by]


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, text): an id and 128 bits of a text name a row, up to equal rows."""
    text = F.col(text_col)
    return documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _entries(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, n) of the index entries that may meet a partner: by size within small key groups, all of large ones."""
    index = sets.select("id", "n", F.explode("keys").alias("key"))
    held = cut(index.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    large = _sized(held.where(F.col("held") > SKETCHED).select("key"))
    by_size = Window.partitionBy("key").orderBy("n", "id")
    near = F.lit(percent) * F.lead("n").over(by_size) <= 100 * F.col("n")
    small = index.join(held.where(F.col("held") <= SKETCHED).select("key"), "key")
    small = small.withColumn("up", near).withColumn("down", F.lit(percent) * F.col("n") <= 100 * F.lag("n").over(by_size)).where("up OR down")
    small = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("members"))
    small = small.groupBy(F.xxhash64("members").alias("h1"), F.xxhash64(F.lit(7), F.col("members")).alias("h2")).agg(F.min("key").alias("key"), F.first("members").alias("members"))
    small = small.select("key", F.explode("members").alias("m")).select("key", "m.id", "m.n")
    small = small.join(sets.select("id", "sketch"), "id").select("key", "id", "n", "sketch").repartition("key").sortWithinPartitions("key")
    small = arrow_map(small, lambda batches: _possible_pass(batches, percent), "key bigint, id bigint")
    return cut(small.unionByName(index.join(large, "key").select("key", "id")).distinct())


def _wide_links(groups: DataFrame, packed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) within key groups of any size, (key, id, g, tokens).

    A group is dealt into blocks by a hash that differs from key to key, and each block is
    compared with itself. Sets that are linked by then need no comparison: only the sets outside
    the largest component of a group still meet each other and those inside, block by block.
    """
    n = F.greatest(F.ceil(F.col("g") * 2 / BLOCK), F.ceil(F.col("tokens") * 2 / BLOCK_TOKENS)).cast("long")
    fits = (F.col("g") <= BLOCK) & (F.col("tokens") <= BLOCK_TOKENS)
    own = F.when(fits, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("key", "id"), n))
    first = cut(_verified(groups.select("key", own.alias("a"), own.alias("b"), "id").join(packed, "id"), width, percent))
    split = groups.where(~fits)
    if split.isEmpty():
        return first
    known = components(first).withColumnRenamed("node", "id")
    split = split.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    size = split.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"))
    rest = (F.col("all") - F.col("most.n")).alias("rest")
    size = cut(size.where("all > most.n").select("key", F.col("most.component").alias("largest"), F.col("most.n").alias("inside"), rest))
    split = cut(split.select("key", "id", "component", (F.col("tokens") / F.col("g")).alias("mean")).join(size, "key"))
    blocks = lambda rows: F.greatest(F.ceil(F.col(rows) * 2 / BLOCK), F.ceil(F.col(rows) * F.col("mean") * 2 / BLOCK_TOKENS), F.lit(1)).cast("long")
    split = split.withColumn("out", F.col("component") != F.col("largest")).withColumn("outs", blocks("rest")).withColumn("ins", blocks("inside"))
    spread = F.xxhash64("key", "id")
    place = F.when(F.col("out"), F.pmod(spread, "outs")).otherwise(F.col("outs") + F.pmod(spread, "ins"))
    last = F.when(F.col("out"), F.col("outs") + F.col("ins")).otherwise(F.col("outs")) - 1
    pairs = split.withColumn("own", place).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pairs = pairs.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id")
    return first.unionByName(_verified(pairs.join(packed, "id"), width, percent))


def _linked_rows(documents: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, t1, t2, n, leader): the least row (id, t1, t2) of each row's component; null for rows that link with nothing."""
    spark = prepare(documents.sparkSession)
    rows = _rows(documents, id_col, text_col)
    texts = rows.select("id", "text")
    sent = spark.sparkContext.broadcast(_hints(texts, width))
    named = "id bigint, t1 bigint, t2 bigint"
    base = cut(arrow_map(rows, lambda batches: _key_pass(batches, width, percent, sent), f"{named}, n bigint, s1 bigint, s2 bigint, keys array<bigint>, sketch binary"))
    usable = base.where("n > 0 AND id IS NOT NULL")
    sets = usable.groupBy("s1", "s2").agg(F.min(F.struct("id", "t1", "t2")).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    # A number for each distinct set; the table is written, so a number stays with its set.
    sets = cut(sets.withColumn("id", F.monotonically_increasing_id()))
    entries = _entries(sets, percent)

    least = cut(entries.groupBy("key").agg(F.min("id").alias("least")))
    cluster = components(entries.join(least, "key").select(F.col("id").alias("u"), F.col("least").alias("v")))
    cluster = cluster.unionByName(cluster.select(F.col("component").alias("node"), "component").distinct())
    sized = cluster.join(sets.select(F.col("id").alias("node"), "n", "row"), "node")
    sized = cut(sized.join(cut(sized.groupBy("component").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("tokens"))), "component"))
    whole = _blocks(sized.where(F.col("g") <= CLUSTER).select(F.col("component").alias("key"), F.col("node").alias("id"), "g", "tokens"))
    wide = sized.where(F.col("g") > CLUSTER).select(F.col("node").alias("id"), "n")
    again = cut(entries.join(wide, "id"))
    again = cut(again.join(cut(again.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("tokens"))), "key"))
    small = again.where(F.col("g") <= BLOCK).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("g").alias("g"), F.first("tokens").alias("tokens"))
    small = small.groupBy(F.xxhash64(F.col("ids"), F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), F.col("ids")).alias("h2")).agg(F.min("key").alias("key"), F.first("ids").alias("ids"), F.first("g").alias("g"), F.first("tokens").alias("tokens"))
    small = small.select("key", F.explode("ids").alias("id"), "g", "tokens").unionByName(again.where(F.col("g") > BLOCK).select("key", "id", "g", "tokens"))
    asked = _sized(sized.select(F.col("row.id").alias("id"), F.col("row.t1").alias("t1"), F.col("row.t2").alias("t2"), "node"))
    packed = arrow_map(rows.join(asked, ["id", "t1", "t2"]).select("node", "text"), _pack_pass, "id bigint, z binary")
    packed = packed.groupBy("id").agg(F.first("z").alias("z"))  # equal rows hold one text
    links = _verified(whole.join(packed, "id"), width, percent)
    if not wide.isEmpty():
        links = links.unionByName(_wide_links(small, packed, width, percent))
    joined = components(links)

    found = sets.select("id", "s1", "s2", "row").join(joined, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    leader = cut(found.groupBy("component").agg(F.min("row").alias("leader")))
    found = found.join(leader, "component").select("s1", "s2", "leader")
    out = base.select("id", "t1", "t2", "n", "s1", "s2").join(found, ["s1", "s2"], "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select("id", "t1", "t2", "n", F.when(~alone, F.col("leader")).alias("leader"))


def jaccard_join(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row; component_id is the smallest id reachable by links."""
    found = _linked_rows(documents, id_col, text_col, width, percent)
    reached = F.when(F.col("n") > 0, F.col("leader.id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), reached.alias("component_id"))


def deduplicate(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the least by id, then by a hash of its text. Rows with a null id, or without words, stay."""
    plain, text = own_names(documents, text_col)
    own = plain.columns[documents.columns.index(id_col)]
    found = _linked_rows(plain, own, text, width, percent).where(F.col("leader").isNotNull())
    found = cut(found.groupBy("id", "t1", "t2").agg(F.first("leader").alias("leader"), F.count(F.lit(1)).alias("copies")))
    stays = F.struct("id", "t1", "t2") == F.col("leader")
    names = [F.col(c).alias(f"other_{c}") for c in ("id", "t1", "t2")]
    keyed = plain.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), F.col(text))})
    same = (F.col(own).cast("long") == F.col("other_id")) & (F.col("t1") == F.col("other_t1")) & (F.col("t2") == F.col("other_t2"))
    kept = keyed.join(_sized(found.where(~stays).select(*names)), same, "left_anti")
    twice = found.where(stays & (F.col("copies") > 1)).select(*names)
    if not twice.isEmpty():
        one = kept.join(twice, same, "left_semi").dropDuplicates([own, "t1", "t2"])
        kept = kept.join(twice, same, "left_anti").unionByName(one)
    return kept.select(*[F.col(a).alias(b) for a, b in zip(plain.columns, documents.columns)])


def _sized(ids: DataFrame) -> DataFrame:
    """With a broadcast hint if the table is small by count."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
