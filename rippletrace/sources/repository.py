"""Local clones as tables: refs, objects, commits and the files of a ref.

Two data sources read a clone's folder, which every machine must see: `git_refs` and `git_objects`.
Objects are dealt by folders of loose objects and by ranges of places in packs; a delta's bases are
found by their places in the same pack, so no range needs another one. What is made of objects is
DataFrame code: commits by patterns, trees level by level with joins, and the blobs that a
ref's supported files name.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rippletrace.functions.ordering import numbered
from rippletrace.functions.shared import cut
from rippletrace.sources.files import IGNORED_SEGMENTS, is_supported, select_files

# Fixed values of the object format.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_PLACE, BY_NAME = 6, 7
INDEX_MAGIC = b"\xfftOc"
DIRECTORY, FILES = "40000", ("100644", "100755")
#: Folders of loose objects, and objects of a pack, in one partition; bytes of objects kept as bases of deltas, and sent in one batch.
LOOSE, RANGE, KEPT_BYTES, BATCH_BYTES = 32, 20_000, 64 << 20, 8 << 20


def git_folder(path: str) -> str:
    """The folder of the clone's own files: below a working copy, or the folder of a bare one."""
    path = path.removeprefix("file://")
    inner = os.path.join(path, ".git")
    return inner if os.path.isdir(inner) else path


class Index:
    """Names and places of the objects of a pack, from its index."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        if raw[:4] != INDEX_MAGIC or struct.unpack(">I", raw[4:8])[0] != 2:
            raise ValueError(f"{path}: not a pack index of version 2")
        n = struct.unpack(">I", raw[8 + 255 * 4 : 8 + 256 * 4])[0]
        names, places = 8 + 256 * 4, 8 + 256 * 4 + n * 24
        large = places + n * 4
        found = struct.unpack(f">{n}I", raw[places:large])
        self.names = [raw[names + 20 * k : names + 20 * k + 20] for k in range(n)]
        self.places = [p if p < 1 << 31 else struct.unpack(">Q", raw[large + 8 * (p & 0x7FFFFFFF) :][:8])[0] for p in found]

    def ordered(self) -> list[tuple[int, bytes]]:
        return sorted(zip(self.places, self.names))


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: copied ranges and new bytes."""

    def size(at: int) -> int:
        while delta[at] & 0x80:
            at += 1
        return at + 1

    at, out = size(size(0)), []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 0x80:
            numbers = [0] * 7
            for k in range(7):
                if op >> k & 1:
                    numbers[k] = delta[at]
                    at += 1
            start = int.from_bytes(bytes(numbers[:4]), "little")
            length = int.from_bytes(bytes(numbers[4:]), "little") or 0x10000
            out.append(base[start : start + length])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


class Pack:
    """Objects of one pack by their places."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.index = Index(path.removesuffix(".pack") + ".idx")
        self.place = dict(zip(self.index.names, self.index.places))
        self.kept: OrderedDict[int, bytes] = OrderedDict()
        self.held = 0

    def _head(self, at: int) -> tuple[int, int | None, int]:
        """(kind, place of the base, place of the packed bytes) of an entry."""
        self.file.seek(at)
        raw, k = self.file.read(64), 1
        kind = raw[0] >> 4 & 7
        while raw[k - 1] & 0x80:
            k += 1
        if kind == BY_PLACE:
            back = raw[k] & 0x7F
            while raw[k] & 0x80:
                k += 1
                back = (back + 1 << 7) | (raw[k] & 0x7F)
            return kind, at - back, at + k + 1
        if kind == BY_NAME:
            return kind, self.place[raw[k : k + 20]], at + k + 20
        return kind, None, at + k

    def _inflate(self, at: int) -> bytes:
        self.file.seek(at)
        engine, out = zlib.decompressobj(), []
        while not engine.eof:
            raw = self.file.read(1 << 16)
            if not raw:
                raise ValueError("a pack ends within an object")
            out.append(engine.decompress(raw))
        return b"".join(out)

    def kind(self, at: int) -> str:
        """What an entry is; a delta is what its last base is. Nothing is unpacked."""
        while True:
            kind, base, _ = self._head(at)
            if base is None:
                return KINDS[kind]
            at = base

    def data(self, at: int) -> bytes:
        """The bytes of an entry, its deltas applied from the last base or a kept one on."""
        chain = []
        while at not in self.kept:
            _, base, packed = self._head(at)
            chain.append((at, packed))
            if base is None:
                break
            at = base
        found = self.kept.get(at)
        for place, packed in reversed(chain):
            raw = self._inflate(packed)
            found = raw if found is None else apply_delta(found, raw)
            self._keep(place, found)
        return found

    def _keep(self, at: int, data: bytes) -> None:
        self.kept[at] = data
        self.held += len(data)
        while self.held > KEPT_BYTES and len(self.kept) > 1:
            self.held -= len(self.kept.popitem(last=False)[1])


class _Part(InputPartition):
    """Folders of loose objects, or the objects of a pack from `low` to `high` by their places."""

    def __init__(self, paths: list[str], low: int = 0, high: int = 0):
        self.paths, self.low, self.high = paths, low, high


class _Objects(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = os.path.join(git_folder(options["path"]), "objects")
        self.kinds = frozenset(filter(None, options.get("kinds", "").split(","))) or frozenset(KINDS.values())
        self.range = int(options.get("range", RANGE))

    def partitions(self):
        folders = sorted(glob.glob(os.path.join(glob.escape(self.folder), "[0-9a-f][0-9a-f]")))
        packs = sorted(glob.glob(os.path.join(glob.escape(self.folder), "pack", "*.pack")))
        ranges = [_Part([p], k, k + self.range) for p in packs for k in range(0, len(Index(p.removesuffix(".pack") + ".idx").names), self.range)]
        return [_Part(folders[k : k + LOOSE]) for k in range(0, len(folders), LOOSE)] + ranges or [_Part([])]

    def _rows(self, part: _Part):
        if part.high:
            pack = Pack(part.paths[0])
            for at, name in pack.index.ordered()[part.low : part.high]:
                kind = pack.kind(at)
                if kind in self.kinds:
                    yield name.hex(), kind, pack.data(at)
            return
        for folder in part.paths:
            for name in sorted(os.listdir(folder)):
                if len(name) == 38:
                    with open(os.path.join(folder, name), "rb") as file:
                        head, _, data = zlib.decompress(file.read()).partition(b"\0")
                    kind = head.split(b" ")[0].decode()
                    if kind in self.kinds:
                        yield os.path.basename(folder) + name, kind, data

    def read(self, partition):
        rows, size = [], 0
        for row in self._rows(partition):
            rows.append(row)
            size += len(row[2])
            if size > BATCH_BYTES or len(rows) >= 1000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))], names=["oid", "kind", "data"])


class GitObjects(DataSource):
    """(oid, kind, data) of all objects, or of those of the option `kinds`; an object may be both loose and packed."""

    @classmethod
    def name(cls):
        return "git_objects"

    def schema(self):
        return "oid string, kind string, data binary"

    def reader(self, schema):
        return _Objects(self.options)


class _Refs(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = git_folder(options["path"])

    def read(self, partition):
        found: dict[str, str] = {}
        packed = os.path.join(self.folder, "packed-refs")
        if os.path.exists(packed):
            with open(packed, encoding="utf-8") as file:
                for line in file:
                    if line[0] not in "#^":
                        oid, name = line.split()
                        found[name] = oid
        for folder, _, names in os.walk(os.path.join(self.folder, "refs")):
            for name in names:
                with open(os.path.join(folder, name), encoding="utf-8") as file:
                    found[os.path.relpath(os.path.join(folder, name), self.folder).replace(os.sep, "/")] = file.read().strip()
        with open(os.path.join(self.folder, "HEAD"), encoding="utf-8") as file:
            found["HEAD"] = file.read().strip()
        for name, at in found.items():
            for _ in range(5):  # a symbolic ref names another
                at = found.get(at[5:], "") if at.startswith("ref: ") else at
            if at:
                yield name, at


class GitRefs(DataSource):
    """(name, oid) of the refs and HEAD, symbolic ones resolved; a loose ref hides a packed one."""

    @classmethod
    def name(cls):
        return "git_refs"

    def schema(self):
        return "name string, oid string"

    def reader(self, schema):
        return _Refs(self.options)


def objects(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("path", path).option("kinds", ",".join(kinds)).load()


def refs(spark: SparkSession, path: str) -> DataFrame:
    """(name, oid): short names, as origin/main or main; tags end at what they mark."""
    spark.dataSource.register(GitRefs)
    found = spark.read.format("git_refs").option("path", path).load()
    found = found.select(F.regexp_replace("name", "^refs/(remotes|heads|tags)/", "").alias("name"), "oid")
    marked = objects(spark, path, "tag").select(F.col("oid").alias("tag"), F.regexp_extract(F.decode("data", "ISO-8859-1"), r"^object ([0-9a-f]{40})", 1).alias("of")).distinct()
    return found.join(marked, found["oid"] == marked["tag"], "left").select("name", F.coalesce("of", "oid").alias("oid"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(commit, tree, parents)."""
    head = F.substring_index(F.decode("data", "ISO-8859-1"), "\n\n", 1)
    one = objects(spark, path, "commit").select(F.col("oid").alias("commit"), head.alias("head")).distinct()
    return one.select("commit", F.regexp_extract("head", r"^tree ([0-9a-f]{40})", 1).alias("tree"), F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})"), 1).alias("parents"))


def _entries(batches):
    for batch in batches:
        rows = []
        for tree, data in zip(batch.column("oid").to_pylist(), batch.column("data").to_pylist()):
            at = 0
            while at < len(data):
                space, end = data.index(b" ", at), data.index(b"\0", at)
                rows.append((tree, data[at:space].decode().lstrip("0"), data[space + 1 : end].decode("utf-8", "replace"), data[end + 1 : end + 21].hex()))
                at = end + 21
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["tree", "mode", "name", "oid"])


def tree_entries(spark: SparkSession, path: str) -> DataFrame:
    """(tree, mode, name, oid) of all trees."""
    return objects(spark, path, "tree").select("oid", "data").mapInArrow(_entries, "tree string, mode string, name string, oid string").distinct()


def _decoded(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("oid"), pa.array([d.decode("utf-8", "replace") for d in batch.column("data").to_pylist()], pa.string())], names=["oid", "content"])


def resolved(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(analysis_id, ref, checkout, commit): each ref as `origin/<ref>`, else as `<ref>`, else what HEAD is."""
    tries = wanted.select("analysis_id", "ref", F.posexplode(F.array(F.concat(F.lit("origin/"), "ref"), F.col("ref"), F.lit("HEAD"))).alias("k", "name"))
    best = F.min(F.struct("k", "name", "oid")).alias("b")
    return tries.join(refs(spark, path), "name").groupBy("analysis_id", "ref").agg(best).select("analysis_id", "ref", F.col("b.name").alias("checkout"), F.col("b.oid").alias("commit"))


def files_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(analysis_id, file_seq, path, content, size, language): supported files outside ignored folders at each wanted (analysis_id, ref).

    Folders are entered level by level, ignored ones not at all; links and nested repositories are left
    out, as by a scan of a checkout. Bytes that are no UTF-8 are replaced.
    """
    entries = cut(tree_entries(spark, path))
    level = resolved(spark, path, wanted).join(commits(spark, path), "commit").select("analysis_id", F.lit("").alias("folder"), "tree")
    found = None
    while not level.isEmpty():
        step = level.join(entries, "tree").select("analysis_id", F.concat("folder", "name").alias("path"), "name", "mode", "oid")
        files = cut(step.where(F.col("mode").isin(*FILES) & is_supported(F.col("path"))).select("analysis_id", "path", "oid"))
        found = files if found is None else found.unionByName(files)
        level = cut(step.where((F.col("mode") == DIRECTORY) & ~F.col("name").isin(*IGNORED_SEGMENTS)).select("analysis_id", F.concat("path", F.lit("/")).alias("folder"), F.col("oid").alias("tree")))
    if found is None:
        found = spark.createDataFrame([], "analysis_id string, path string, oid string")
    blobs = objects(spark, path, "blob").join(found.select("oid").distinct(), "oid", "left_semi").select("oid", "data").mapInArrow(_decoded, "oid string, content string").dropDuplicates(["oid"])
    return numbered(select_files(found.join(blobs, "oid").select("analysis_id", "path", "content")), "file_seq", ["analysis_id"], "path")
