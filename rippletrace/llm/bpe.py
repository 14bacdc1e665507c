"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A task loads the vocabulary: every way to cut a token into two tokens is a
row (pair, merged id) of the merge table, so a merge's rank is its id.
Texts are cut by the tokenizer's pattern; words not yet held go
to DuckDB as token-position rows, one row a byte, whatever their length. A keyed
recursive query joins neighbouring rows with the merge table and contracts in
each word the pair of minimum rank, from the left and without overlap, wherever
it stands, until no pair is left. One leftmost pair after the other gives the same, unless
a merge makes a pair of a lower rank that takes part of another pair of the round; some
rows of a vocabulary have parts of higher ranks, so this is no theorem, and `tests/llm`
holds words made of all such rows against the library. Ordered aggregation over the final rows gives a word's ids and,
through the vocabulary, its decoded bytes; a document is its words one after another.

Whole texts are encoded, in one pass without a shuffle. A worker holds the last one
or two times `KNOWN_WORDS` words that its tasks met, packed (about 50 bytes each), so
frequent words are contracted once; a lost worker's successor learns them anew. A round costs
time in proportion to the words that are not done, and a word of n bytes needs at
most as many rounds as it has different merges. Defined cases: null and empty texts have no tokens;
repeated rows are encoded one by one; an empty table gives an empty result;
other columns pass through `encode` unchanged.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import arrow_map, extended, own_names, prepare

#: Words in each of the two generations a worker holds, and characters of the longest; words, and bytes of them, in one query (or one word).
KNOWN_WORDS, KEPT_LENGTH, QUERY_WORDS, QUERY_BYTES = 400_000, 100, 20_000, 500_000

# A row's place is w << 32 | p, so one order serves all words; a pair of tokens is l << 32 | r; -1 marks a token that went into its left neighbour.
_CONTRACT = """
WITH RECURSIVE s(wp, t) USING KEY (wp) AS (
  SELECT (CAST(w AS BIGINT) << 32) + p, t FROM seed
  UNION ALL
  (WITH q AS MATERIALIZED (
     SELECT wp, t, wp >> 32 AS w, lead(wp) OVER x AS after, lead(t) OVER x AS right_t, row_number() OVER x AS k FROM s WHERE t >= 0 WINDOW x AS (ORDER BY wp)
   ),
   pairs AS MATERIALIZED (SELECT w, wp, after, k, m.id FROM q JOIN merges m ON m.pair = (CAST(t AS BIGINT) << 32) + right_t WHERE after >> 32 = w),
   least AS MATERIALIZED (SELECT w, min(id) AS id FROM pairs GROUP BY w),
   hit AS MATERIALIZED (SELECT wp, after, k, pairs.id FROM pairs JOIN least USING (w, id)),
   follows AS (SELECT h.*, k - row_number() OVER (ORDER BY k) AS run FROM hit h SEMI JOIN hit b ON b.after = h.wp),
   taken AS MATERIALIZED (
     SELECT h.wp, h.after, h.id FROM hit h ANTI JOIN hit b ON b.after = h.wp
     UNION ALL SELECT wp, after, id FROM follows QUALIFY row_number() OVER (PARTITION BY run ORDER BY k) % 2 = 0
   ),
   change AS (SELECT wp, id FROM taken UNION ALL SELECT after, -1 FROM taken)
   SELECT q.wp, coalesce(change.id, q.t) FROM q JOIN least ON least.w = q.w LEFT JOIN change ON change.wp = q.wp)
)
SELECT wp >> 32 AS w, wp & 4294967295 AS p, t FROM s WHERE t >= 0
"""

# One thread reads the sorted rows in order.
_RESULT = """
SELECT w, string_agg(name, ' ') AS ids, unhex(string_agg(piece, '')) AS decoded
FROM (SELECT w, name, piece FROM final JOIN vocabulary v ON v.id = t ORDER BY w, p) GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


@functools.lru_cache(maxsize=1)
def _tables(path: str) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """The merge table, the vocabulary and the token of each byte."""
    ranks = read_ranks(path)
    pair, merged = [], []
    for piece, number in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is not None and b is not None:
                pair.append(a << 32 | b), merged.append(number)
    merges = pa.table({"pair": pa.array(pair, pa.int64()), "id": pa.array(merged, pa.int32())})
    vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks.keys(), pa.binary())})
    return merges, vocabulary, np.array([ranks[bytes([b])] for b in range(256)], np.int32)


class Words:
    """Encoded words in packed columns, found by sorted hashes; two generations of at most `limit` words."""

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.recent: list[tuple] = []  # runs: (sorted hashes, rows, words, ids, decoded)
        self.older: list[tuple] = []

    def take(self, words: list[str]) -> dict[str, tuple[str, bytes]]:
        """Those of the words that are held. Words of the older generation move to the recent one."""
        out: dict[str, tuple[str, bytes]] = {}
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        left = np.argsort(hashes)
        for runs, move in ((list(self.recent), False), (list(self.older), True)):
            for keys, rows, *columns in runs:
                at = np.searchsorted(keys, hashes[left])
                at[at == len(keys)] = 0
                hit = keys[at] == hashes[left]
                picked = pa.array(rows[at[hit]])
                held, ids, decoded = (c.take(picked).to_pylist() for c in columns)
                found = dict(zip(held, zip(ids, decoded)))
                if held != [words[k] for k in left[hit].tolist()]:  # another word of the same hash
                    found = {w: found[w] for w in (words[k] for k in left[hit].tolist()) if w in found}
                    hit = np.fromiter((words[k] in found for k in left.tolist()), bool, len(left))
                left = left[~hit]
                out.update(found)
                if move:
                    self.put(found)
        return out

    def put(self, found: dict[str, tuple[str, bytes]]) -> None:
        kept = [(w, *x) for w, x in found.items() if len(w) <= KEPT_LENGTH]
        if not kept:
            return
        if self.size + len(kept) > self.limit:
            self.older, self.recent, self.size = self.recent, [], 0
        keys = np.fromiter((hash(k[0]) for k in kept), np.int64, len(kept))
        order = np.argsort(keys)
        run = (keys[order], order, *(pa.array([k[c] for k in kept], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.binary()))))
        while self.recent and len(self.recent[-1][0]) <= 2 * len(run[0]):
            before = self.recent.pop()
            keys = np.concatenate([before[0], run[0]])
            order = np.argsort(keys, kind="stable")
            run = (keys[order], np.concatenate([before[1], run[1] + len(before[1])])[order], *(pa.concat_arrays(c) for c in zip(before[2:], run[2:])))
        self.recent.append(run)
        self.size += len(kept)


#: What this worker's tasks leave to the next one: (path, pattern) -> words.
_held: dict[tuple[str, str], Words] = {}


class Coder:
    """A DuckDB connection with the merge table, and the words that the worker holds."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern)
        if (path, pattern) not in _held:
            _held.clear()
        self.words = _held.setdefault((path, pattern), Words(KNOWN_WORDS))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": tempfile.gettempdir()})
        merges, vocabulary, self.byte = _tables(path)
        self.db.register("m", merges), self.db.register("v", vocabulary)
        self.db.execute("CREATE TABLE merges AS FROM m; CREATE TABLE vocabulary AS SELECT id, CAST(id AS VARCHAR) AS name, hex(piece) AS piece FROM v")
        self.db.unregister("m"), self.db.unregister("v")

    def _seed(self, words: list[bytes]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        p = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        t = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        self.db.register("seed", pa.table({"w": w, "p": p.astype(np.int32), "t": t}))

    def _contract(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        self._seed(words)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE final AS {_CONTRACT}")
        out: list = [None] * len(words)
        for w, ids, decoded in self.db.execute(_RESULT).fetchall():
            out[w] = (ids, decoded)
        self.db.execute("DROP TABLE final")
        self.db.unregister("seed")
        return out

    def learn(self, words: list[str]) -> dict[str, tuple[str, bytes]]:
        """Ids and decoded bytes of these words; those not held are encoded."""
        known = self.words.take(words)
        new = [(w, w.encode()) for w in words if w not in known]
        part, size, added = [], 0, {}
        for k, (word, raw) in enumerate(new):
            part.append((word, raw))
            size += len(raw)
            if len(part) == QUERY_WORDS or size >= QUERY_BYTES or k + 1 == len(new):
                added.update(zip((w for w, _ in part), self._contract([raw for _, raw in part])))
                part, size = [], 0
        self.words.put(added)
        known.update(added)
        return known

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, bytes]]:
        """(tokens, ids joined by spaces, bytes decoded from the ids) of each text."""
        cut = [self.split.findall(t) if t else [] for t in texts]
        known, out = self.learn(list(set().union(*cut))), []
        for words in cut:
            ids, decoded = zip(*map(known.__getitem__, words)) if words else ((), ())
            ids = " ".join(ids)
            out.append((ids.count(" ") + 1 if ids else 0, ids, b"".join(decoded)))
        return out

    def close(self) -> None:
        self.db.close()


def _encode_pass(batches, col: int, path: str, pattern: str):
    own = Coder(path, pattern)
    try:
        for batch in batches:
            for a, b in B.slices(batch.column(col), 1_000_000):
                part = batch.slice(a, b - a)
                done = own.encode(part.column(col).to_pylist())
                columns = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "n_tokens", "ids", "decoded"])
    finally:
        own.close()


def encode(documents: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """Columns of documents as in_0, in_1, ... with n_tokens, ids (joined by one space) and the bytes decoded from them."""
    prepare(documents.sparkSession)
    plain, text = own_names(documents, text_col)
    at = plain.columns.index(text)
    return arrow_map(plain, lambda batches: _encode_pass(batches, at, path, pattern), extended(plain.schema, "n_tokens bigint, ids string, decoded binary"))


def decode_ids(ids: str, path: str, pattern: str = r"\X") -> bytes:
    """The bytes of space-joined ids, by ordered aggregation."""
    own = Coder(path, pattern)
    rows = [int(i) for i in ids.split()]
    own.db.register("given", pa.table({"p": pa.array(range(len(rows)), pa.int64()), "t": pa.array(rows, pa.int32())}))
    found = own.db.execute("SELECT unhex(string_agg(v.piece, '' ORDER BY p)) FROM given JOIN vocabulary v ON v.id = t").fetchone()[0]
    own.close()
    return found or b""


def report(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns, one row per document."""
    coded = encode(documents.select("doc_id", "text"), path, pattern)
    return coded.select(F.col("in_0").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digest(ids: list[int]) -> str:
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
