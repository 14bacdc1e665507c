"""Conversation repair at the least cost by a lazily determinised weighted automaton.

A well-formed conversation has role initials `(s?(ua)+)?`. Turns may be kept, given another role,
deleted or preceded by inserted empty turns, each at a price; blank and repeated turns must go. The
four states of the form (`START`, after s, after u, after a) with these edits are a weighted
automaton over the kinds of turns. Read from the last turn to the first, the costs from each
state to an accepting end are a vector; less its minimum, a vector is a state of the
determinised automaton. Inserts bound the differences, so there are few; a state and its arcs are made
when a worker first meets them, and kept in a transition table, so a scan is one lookup a turn
and sums the weights. The audit is traced against the direction of the scan, from the first turn on:
of the arcs that are tight, those whose weight is the difference of two vectors, it takes the ASCII-least.

Equal rows of a turn are combined before the shuffle, and a row is first of its role and text by a
minimum that is combined as well. Turns are cut into blocks of `BLOCK` turn numbers; a block of over
`DENSE` rows is cut by turn and by digits of the hash that orders it. Blocks are scanned in parallel
from each of the four exits; what is composed for a conversation is four by four costs a block.
Last, a conversation's blocks stream through one task in order, which holds the
current block and those costs: the contract's digest is a chain over all its text.

Defined cases: turns are ordered by turn (nulls first), and where it repeats, by the md5 digest of
role and text; a null role or text is one space, so a turn without text is blank; rows with a null
conversation id are one conversation; a role counts by its first character, an empty one has
no initial; a conversation without turns after damage has zeros, an empty audit and an empty
repaired form; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, cut, prepare

#: Turn numbers in a block; rows from which a block is cut further, and rows wanted in each part.
BLOCK, DENSE, PART = 256, 4096, 1024
START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60
#: State after a turn with that initial, where there is one.
NEXT = {"s": (AFTER_S, None, None, None), "u": (AFTER_U, AFTER_U, None, AFTER_U), "a": (None, None, AFTER_A, None)}
#: The one role that can be inserted at each state: its mark, and the state after it.
INSERTED = (("U", AFTER_U), ("U", AFTER_U), ("A", AFTER_A), ("U", AFTER_U))
#: Costs to an accepting end where no turn is left.
END = (0, 4, 2, 0)
ROLE = {"U": "user", "A": "assistant", "u": "user", "a": "assistant"}
LETTER = str.maketrans("UAkuad", "IIKRRD")
#: A turn's kind is a letter: its initial (o: another, e: none), a capital where it is truncated, its number where it must go.
INITIALS = "suaoe"
NUMBERS = {str(k + 1): c for k, c in enumerate(INITIALS)}
LEGAL = {"su", "ua", "au"}


def edits(kind: str, state: int) -> list[tuple[str, int, int]]:
    """(mark, state after, cost) of what can be done with a turn, ASCII-least letter first; inserts aside."""
    out = [("d", state, DELETE)]
    if kind in NUMBERS:
        return out
    initial, late = kind.lower(), TRUNCATED if kind.isupper() else 0
    kept = state if initial == "e" else NEXT[initial][state] if initial in NEXT else None
    if kept is not None:
        out.append(("k", kept, KEEP + late))
    return out + [(mark, NEXT[mark][state], REROLE + late) for mark in "ua" if NEXT[mark][state] is not None]


class Determinised:
    """Normalised cost vectors as states; arcs and tight edits are worked out on first use."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.arcs: dict[tuple[int, str], tuple[int, int]] = {}
        self.tight: dict[tuple[int, str], list[tuple[str, int]]] = {}

    def state(self, vector) -> tuple[int, int]:
        """(state, weight) of a vector."""
        least = min(vector)
        normal = tuple(v if v >= FAR else v - least for v in vector)
        if normal not in self.number:
            self.number[normal] = len(self.vectors)
            self.vectors.append(normal)
        return self.number[normal], least

    def _before(self, after: tuple[int, ...], kind: str) -> list[int]:
        costs = [min(min(FAR, cost + after[to]) for _, to, cost in edits(kind, q)) for q in range(4)]
        for _ in range(3):
            costs = [min(costs[q], min(FAR, INSERT + costs[INSERTED[q][1]])) for q in range(4)]
        return costs

    def arc(self, state: int, kind: str) -> tuple[int, int]:
        """State and weight before a turn, from the state after it."""
        found = self.arcs.get((state, kind))
        if found is None:
            found = self.arcs[state, kind] = self.state(self._before(self.vectors[state], kind))
        return found

    def moves(self, state: int, kind: str) -> list[tuple[str, int]]:
        """For each state of the form before a turn: marks of inserts and the turn's edit, and the state after it."""
        found = self.tight.get((state, kind))
        if found is None:
            after = self.vectors[state]
            costs = self._before(after, kind)
            found = []
            for q in range(4):
                marks = ""
                while True:
                    fits = [(m, to) for m, to, cost in edits(kind, q) if costs[q] == cost + after[to]]
                    if fits and fits[0][0] == "d":
                        break
                    mark, to = INSERTED[q]
                    if costs[q] == INSERT + costs[to]:
                        marks, q = marks + mark, to
                        continue
                    break
                found.append((marks + fits[0][0], fits[0][1]))
            self.tight[state, kind] = found
        return found

    def scan(self, kinds: str, vector) -> tuple[list[int], list[int]]:
        """Costs before a block from those after it, and the state after each turn."""
        state, total = self.state(vector)
        after = [0] * len(kinds)
        for k in range(len(kinds) - 1, -1, -1):
            after[k] = state
            state, weight = self.arc(state, kinds[k])
            total += weight
        return [v if v >= FAR else v + total for v in self.vectors[state]], after

    def block(self, kinds: str) -> list[int]:
        """Costs through a block, exit by exit: four entries for each."""
        return [cost for q in range(4) for cost in self.scan(kinds, [0 if p == q else FAR for p in range(4)])[0]]


_machine = Determinised()


def damage(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The contract's damage: (conv, turn, role, text, copies) with nulls of role and text as one space."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    fate = F.crc32(F.concat(space(F.col(id_col).cast("string")), F.lit(":"), space(F.col(turn_col).cast("string"))).cast("binary")) % 20
    role, text = space(F.col(role_col)), space(F.col(text_col))
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), F.when(fate == 3, 2).otherwise(1).alias("copies"), fate.alias("fate"))
    return rows.where("fate <> 0").drop("fate")


def blocks(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text, copies) as blocks: (key, block, rows, kinds, blank, duplicate, truncated, extra), written."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    key = F.coalesce(F.concat(F.lit("k"), F.col("conv").cast("string")), F.lit("n")).alias("key")
    rows = turns.select(key, "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), "copies").groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    rows = cut(rows.withColumn("mark", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).withColumn("turns_of", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))))
    first = rows.groupBy("key", "mark").agg(F.min(F.struct("turn")).alias("f")).select(F.col("key").alias("k"), F.col("mark").alias("m"), F.col("f.turn").alias("t"))
    rows = rows.join(first, (rows["key"] == first["k"]) & (rows["mark"] == first["m"]) & rows["turn"].eqNullSafe(first["t"]), "left").withColumn("first", F.col("k").isNotNull()).drop("k", "m", "t")
    dense = rows.groupBy("key", "turns_of").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > DENSE).select(F.col("key").alias("k"), F.col("turns_of").alias("b"), F.ceil(F.log(F.col("size") / PART) / F.log(F.lit(16.0))).cast("int").alias("digits"))
    rows = rows.join(cut(dense), (F.col("key") == F.col("k")) & (F.col("turns_of") == F.col("b")), "left").drop("k", "b")
    fine = lambda x, other: F.when(F.col("digits").isNotNull(), x).otherwise(other)
    block = F.struct("turns_of", fine(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))), F.lit(-(2**62))).alias("turn"), fine(F.substring("mark", F.lit(1), F.col("digits")), F.lit("")).alias("mark"))
    filled = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    initial = F.when(F.col("role") == "", "e").when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    open_end = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    kind = F.when(~filled | ~F.col("first"), F.translate(initial, INITIALS, "12345")).when(open_end, F.upper(initial)).otherwise(initial)
    rows = rows.withColumn("kind", kind).withColumn("filled", filled).withColumn("block", block)
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "mark", "kind", "n", F.when(~F.col("kind").isin(*NUMBERS), F.col("role")).alias("role"), F.when(~F.col("kind").isin(*NUMBERS), F.col("text")).alias("text"))
    grouped = rows.groupBy("key", "block").agg(
        F.array_sort(F.collect_list(one)).alias("rows"), F.sum(F.when(~F.col("filled"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("filled"), F.col("n") - F.col("first").cast("int")).otherwise(0)).alias("duplicate"), F.sum((F.col("filled") & F.col("first") & open_end).cast("long")).alias("truncated"), F.sum(F.col("n") - 1).alias("extra"),
    )
    return cut(grouped.select("key", "block", F.transform("rows", lambda r: F.struct(r["n"].alias("n"), r["role"].alias("role"), r["text"].alias("text"))).alias("rows"), F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("kinds"), "blank", "duplicate", "truncated", "extra"))


def _through(kinds: pd.Series) -> pd.Series:
    return kinds.map(_machine.block)


def _entries(through: list[list[int]]) -> tuple[int, list[tuple[int, ...]]]:
    """Cost of a conversation, and the costs after each of its blocks (less their least), from those through its blocks."""
    vector, total, out = list(END), 0, [END] * len(through)
    for k in range(len(through) - 1, -1, -1):
        least = min(vector)
        out[k] = tuple(v - least for v in vector)
        total += least
        vector = [min(min(FAR, through[k][4 * q + p] + out[k][q]) for q in range(4)) for p in range(4)]
    return total + vector[START], out


def _follow(batches, emit):
    """Conversations in order, block by block: `emit` takes (key, mark, role, text, copies) for each edit, and (key, cost, illegal) at its end."""
    key, through, after, state, cost, illegal, last, at = None, [], None, START, 0, 0, None, 0

    def finish():
        for role in {AFTER_S: "UA", AFTER_U: "A"}.get(state, ""):
            emit.edit(key, role, ROLE[role], "", 1)
        emit.end(key, cost, illegal)

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    finish()
                key, through, after, state, illegal, last, at = row["key"], [], None, START, 0, None, 0
            if row["through"] is not None:
                through.append(row["through"])
                continue
            if after is None:
                (cost, after), through = _entries(through), []
            kinds = row["kinds"]
            _, states = _machine.scan(kinds, after[at])
            at += 1
            for kind, then, turn in zip(kinds, states, row["rows"]):
                marks, state = _machine.moves(then, kind)[state]
                for mark in marks[:-1]:
                    emit.edit(key, mark, ROLE[mark], "", 1)
                done, n = marks[-1], turn["n"]
                emit.edit(key, done, ROLE.get(done, turn["role"]), turn["text"], 1)
                if n > 1:
                    emit.edit(key, "d", None, None, n - 1)
                initial = NUMBERS.get(kind, kind.lower())
                illegal += n - 1 + (last is not None and last + initial not in LEGAL)
                last = initial
        yield from emit.flush()
    if key is not None:
        finish()
    yield from emit.flush()


class _Digests:
    """For each conversation: cost, adjacent turns out of form, audit, digest of the repaired turns."""

    def __init__(self):
        self.audit, self.sha, self.any, self.done = [], hashlib.sha256(), False, []

    def edit(self, key, mark, role, text, copies):
        self.audit.append(mark.translate(LETTER) * copies)
        if mark != "d":
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def end(self, key, cost, illegal):
        self.done.append((key, cost, illegal, "".join(self.audit), self.sha.hexdigest()))
        self.audit, self.sha, self.any = [], hashlib.sha256(), False

    def flush(self):
        if self.done:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "scan", "illegal", "audit", "sha"), d)) for d in self.done], schema=_DIGESTS)
            self.done = []


class _Turns:
    """For each edit but a deletion: its place, letter, role and text."""

    def __init__(self):
        self.place, self.rows = 0, []

    def edit(self, key, mark, role, text, copies):
        if mark != "d":
            self.rows.append((key, self.place, mark.translate(LETTER), role, text))
            self.place += 1

    def end(self, key, cost, illegal):
        self.place = 0

    def flush(self):
        if self.rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "place", "edit", "role", "text"), r)) for r in self.rows], schema=_TURNS)
            self.rows = []


_DIGESTS = pa.schema([("key", pa.string()), ("scan", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string()), ("sha", pa.string())])
_TURNS = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _streamed(dealt: DataFrame, emitter, schema: str) -> DataFrame:
    none = lambda c: F.lit(None).cast(dict(dealt.dtypes)[c]).alias(c)
    ahead = dealt.select("key", F.lit(0).alias("phase"), "block", F.pandas_udf(_through, "array<bigint>")("kinds").alias("through"), none("rows"), none("kinds"))
    turns = dealt.select("key", F.lit(1).alias("phase"), "block", F.lit(None).cast("array<bigint>").alias("through"), "rows", "kinds")
    order = ahead.unionByName(turns).repartition("key").sortWithinPartitions("key", "phase", "block").drop("phase", "block")
    return arrow_map(order, lambda batches: _follow(batches, emitter()), schema)


def repair(turns: DataFrame) -> DataFrame:
    """Repaired turns of (conv, turn, role, text, copies): (key, place, edit, role, text), where edit is K, R or I; key is k and the id, or n."""
    prepare(turns.sparkSession)
    return _streamed(blocks(turns), _Turns, "key string, place bigint, edit string, role string, text string")


def audit(turns: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of (conv, turn, role, text, copies)."""
    prepare(turns.sparkSession)
    dealt = blocks(turns)
    counts = dealt.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "extra")])
    found = _streamed(dealt, _Digests, "key string, scan bigint, illegal bigint, audit string, sha string")
    key = F.coalesce(F.concat(F.lit("k"), F.col("conv").cast("string")), F.lit("n")).alias("key")
    spans = turns.where("turn IS NOT NULL").select(key, "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = found.join(counts, "key").join(spans, "key", "left")
    return out.select("key", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", (F.col("scan") + DELETE * F.col("extra")).alias("cost"), "audit", F.col("sha").alias("repaired_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The contract's columns, one row per original conversation."""
    ids = conversations.select("conv_id").distinct().withColumn("key", F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("n")))
    found = audit(damage(conversations))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = ids.join(found, "key", "left")
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
