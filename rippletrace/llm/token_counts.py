"""Token counts of documents by a map-side lookup of two tiers.

A tokenizer cuts a text into pre-tokens and encodes each by itself, so a document's count
is a sum of lengths that depend on the pre-token alone. The first tier holds the lengths of the
frequent pre-tokens: those that make up at least one in `SHARE` of all pre-tokens of all documents,
hence at most `SHARE` of them, each of at most `LONGEST` characters; that bound lets it
be broadcast. The second tier is a cache in each Python worker for the others, which are
encoded by the library when they are first met; a cache of a lost worker is learned anew. Texts
stay where they were read: the first pass sends on only the pre-tokens that are frequent
in its own task (at most `SHARE` rows, as a globally frequent one is frequent in some task), and the
second pass shuffles nothing. The tiers only save work; any table gives the same counts.

Character classes differ between regular expression engines for code points that younger versions
of Unicode assign, so `classes` asks the library for the class of each code point in `ASKED`, and
the pre-token pattern is made of these. Texts with any other code point go to the library
whole, as do those with special tokens in them, which the library takes out first.

Defined cases: null and empty texts have no bytes and no tokens; a special token's text counts as one
token, which is the library's default; repeated rows are counted one by one; an empty table gives
an empty result; other columns, of any name, pass through `counted` unchanged.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import arrow_map, cut, extended, own_names, prepare

#: Frequent means one in so many pre-tokens; characters of the longest pre-token that is kept in a tier; entries of a worker's cache and of a task's counter.
SHARE, LONGEST, CACHED, COUNTED = 1 << 16, 64, 400_000, 1 << 19
#: Code points whose class is asked for: the basic plane and the pictographs.
ASKED = ((0, 0xD7FF), (0xE000, 0xFFFF), (0x1F000, 0x1FAFF))


@functools.lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check(path: str) -> list[str]:
    """Texts of the added tokens; an error for a tokenizer of another kind."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    pre = held["pre_tokenizer"] or {}
    plain = all(not a[flag] for a in held["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    if held["normalizer"] is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
        raise ValueError("a byte-level tokenizer without normalizer is needed")
    return [a["content"] for a in held["added_tokens"]]


def _ranges(points: list[int]) -> str:
    """A character class of ascending code points."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


@functools.lru_cache(maxsize=2)
def pattern(path: str) -> str:
    """The pre-token pattern of byte-level tokenizers, with letters, numbers and white space as the library sees them."""
    pieces = library(path).pre_tokenizer.pre_tokenize_str
    letters, numbers, spaces = [], [], []
    for low, high in ASKED:
        for c in range(low, high + 1):
            probe = "a{0}1{0}.{0}".format(chr(c))
            ends = {span for _, span in pieces(probe)}
            if (0, 2) in ends:
                letters.append(c)
            elif (1, 4) in ends:
                numbers.append(c)
            elif (3, 6) not in ends:
                spaces.append(c)
    word, digit, space = map(_ranges, (letters, numbers, spaces))
    return rf" ?[{word}]+|'(?:s|t|re|ve|m|ll|d)| ?[{digit}]+| ?[^{space}{word}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"


#: Bytes as the characters that stand for them in a byte-level vocabulary: printable ones as they are, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
LETTER = {**{b: b for b in _PLAIN}, **{b: 256 + k for k, b in enumerate(_OTHER)}}


def piece_length(path: str, piece: str) -> int:
    """Tokens of one pre-token, by the library's model."""
    return len(library(path).model.tokenize(piece.encode().decode("latin-1").translate(LETTER)))


def whole_length(path: str, text: str) -> int:
    return len(library(path).encode(text, add_special_tokens=False).ids)


class Lengths(dict):
    """Pre-token -> number of tokens: the broadcast tier, then two generations of a cache, then the library."""

    def __init__(self, frequent: dict[str, int], path: str):
        super().__init__(frequent)
        self.path, self.young, self.old = path, {}, {}

    def __missing__(self, piece: str) -> int:
        n = self.young.get(piece)
        if n is None:
            n = self.old.get(piece) or piece_length(self.path, piece)
            if len(piece) <= LONGEST:
                if len(self.young) >= CACHED // 2:
                    self.old, self.young = self.young, {}
                self.young[piece] = n
        return n


_own: dict[tuple[str, int], Lengths] = {}


def _worker_lengths(path: str, version: int, held) -> Lengths:
    """The tiers of this worker, kept from task to task for one broadcast."""
    if (path, version) not in _own:
        _own.clear()
        _own[path, version] = Lengths(held.value, path)
    return _own[path, version]


def _finders(added: list[str], pieces: str):
    """How pre-tokens, and texts that the library must see whole, are found."""
    outside = re.compile("[^" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ASKED) + "]").search

    def strange(text: str) -> bool:
        return any(a in text for a in added) or not text.isascii() and outside(text) is not None

    return re.compile(pieces).findall, strange


def _texts(batch, col):
    for a, b in B.slices(batch.column(col), 1_000_000):
        yield a, b, batch.column(col).slice(a, b - a).to_pylist()


def frequent(documents: DataFrame, path: str, *, text_col: str = "text") -> dict[str, int]:
    """Lengths of the pre-tokens that are one in `SHARE` of all; at most `SHARE` short strings."""
    added, pieces_of = check(path), pattern(path)

    def count(batches):
        find, strange = _finders(added, pieces_of)
        seen, total = Counter(), 0
        for batch in batches:
            for _, _, texts in _texts(batch, 0):
                for text in texts:
                    if text and not strange(text):
                        pieces = find(text)
                        seen.update(pieces)
                        total += len(pieces)
                if len(seen) > COUNTED:
                    least = 1
                    while len(seen) > COUNTED // 2:
                        least *= 2
                        seen = Counter({p: n for p, n in seen.items() if n >= least})
        kept = [(p, n) for p, n in seen.items() if n * SHARE >= total and len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([None, *(p for p, _ in kept)], pa.string()), pa.array([total, *(n for _, n in kept)], pa.int64())], names=["piece", "n"])

    def measure(batches):
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([piece_length(path, p) for p in pieces], pa.int32())], names=["piece", "tokens"])

    merged = cut(arrow_map(documents.select(text_col), count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n")))
    total = merged.where("piece IS NULL").agg(F.sum("n")).first()[0] or 0
    often = merged.where(F.col("piece").isNotNull() & (F.col("n") * SHARE >= total)).select("piece")
    return {r.piece: r.tokens for r in arrow_map(often, measure, "piece string, tokens int").collect()}


def counted(documents: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """Columns of documents as in_0, in_1, ... with n_tokens."""
    spark = prepare(documents.sparkSession)
    added, pieces_of = check(path), pattern(path)
    held = spark.sparkContext.broadcast(frequent(documents, path, text_col=text_col))
    version = held._jbroadcast.id()
    plain, text = own_names(documents, text_col)
    at = plain.columns.index(text)

    def count(batches):
        find, strange = _finders(added, pieces_of)
        length = _worker_lengths(path, version, held).__getitem__
        for batch in batches:
            for a, b, texts in _texts(batch, at):
                n = [0 if not t else whole_length(path, t) if strange(t) else sum(map(length, find(t))) for t in texts]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*part.schema.names, "n_tokens"])

    return arrow_map(plain, count, extended(plain.schema, "n_tokens bigint"))


def report(documents: DataFrame, path: str, *, limit: int = 1024) -> DataFrame:
    """The contract's columns, one row per document."""
    done = counted(documents.select("doc_id", "text"), path)
    return done.select(F.col("in_0").alias("doc_id"), F.coalesce(F.octet_length("in_1"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
