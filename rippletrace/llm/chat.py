"""Chat formatting after collapsing cumulative snapshots of conversations.

A log that stores a conversation after every turn holds it many times, each copy
a prefix of the next. Every turn gets a rolling hash of the turns up to it (two
64-bit hashes of place, role and text, combined by exclusive or, so prefixes
can be computed from blocks). A conversation whose last rolling hash appears
inside a longer conversation is a prefix of it and goes by an anti-join; of
equal conversations the smallest id stays. What is left is rendered.

Turns are numbered in blocks of `BLOCK` turn numbers; a block of over `DENSE` rows, which
repeats its turn numbers (or has none), is split by turn and the first digits of a hash. Block
totals are combined before the shuffle, offsets run over blocks, and turns run inside a block,
so a conversation of very many rows is spread over many tasks, whatever its turn numbers.
Rendering yields one row for each block of turns. DataFrame functions only.

Defined cases: turns of a conversation are ordered by turn (nulls first), and where it repeats, by
the md5 digest of role and text; rows repeated in all of these count once; a null role renders as
`unknown`, a null text as empty, and nulls equal nulls in comparisons; rows with
a null conversation id are one conversation of their own that stays; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Turn numbers in a block, and rows from which a block is split by turn and hash.
BLOCK, DENSE = 256, 4096


def rolling(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, block, place, turns, role, text, h1, h2): each turn's place from 1 and the hash of the turns up to it."""
    base = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).distinct()
    mark = F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("\x1f"), F.coalesce("text", F.lit(""))))
    base = base.withColumn("mark", mark).withColumn("turns_of", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    dense = base.groupBy("conv", "turns_of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE)
    dense = cut(dense.select(F.col("conv").alias("c"), F.col("turns_of").alias("b")))
    met = base["conv"].eqNullSafe(F.col("c")) & (base["turns_of"] == F.col("b"))
    fine = F.struct(F.when(F.col("b").isNotNull(), F.coalesce("turn", F.lit(-(2**62)))).otherwise(-(2**62)).alias("turn"), F.when(F.col("b").isNotNull(), F.substring("mark", 1, 3)).otherwise("").alias("mark"))
    base = cut(base.join(dense, met, "left").withColumn("block", F.struct("turns_of", fine.alias("fine"))).drop("c", "b", "turns_of"))
    totals = base.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("turns", F.sum("n").over(Window.partitionBy("conv")))
    offsets = offsets.select(F.col("conv").alias("c"), F.col("block").alias("b"), "offset", "turns")
    same = lambda x: x["conv"].eqNullSafe(F.col("c")) & (x["block"] == F.col("b"))
    order = [F.asc_nulls_first("turn"), F.asc("mark"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    placed = base.join(offsets, same(base)).drop("c", "b")
    placed = placed.withColumn("place", F.col("offset") + F.row_number().over(Window.partitionBy("conv", "block").orderBy(*order)))
    seen = [F.col("place"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("role").isNull(), F.col("text").isNull()]
    placed = cut(placed.withColumn("x1", F.xxhash64(F.lit(1), *seen)).withColumn("x2", F.xxhash64(F.lit(2), *seen)))
    sums = placed.groupBy("conv", "block").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    sums = sums.select(F.col("conv").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.bit_xor(s).over(before.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias(p) for s, p in (("s1", "p1"), ("s2", "p2"))))
    up_to = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = placed.join(sums, same(placed)).drop("c", "b")
    return joined.select("conv", "block", "place", "turns", "role", "text", *(F.bit_xor(x).over(up_to).bitwiseXOR(F.col(p)).alias(h) for x, p, h in (("x1", "p1", "h1"), ("x2", "p2", "h2"))))


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv) of the conversations that no longer or equal one covers."""
    last = hashed.where(F.col("place") == F.col("turns")).select("conv", "place", "h1", "h2")
    inner = hashed.where((F.col("place") < F.col("turns")) & F.col("conv").isNotNull()).select("place", "h1", "h2").distinct()
    named = last.where(F.col("conv").isNotNull())
    alone = named.groupBy("place", "h1", "h2").agg(F.min("conv").alias("conv"))
    return alone.join(inner, ["place", "h1", "h2"], "left_anti").select("conv").unionByName(last.where(F.col("conv").isNull()).select("conv"))


def render(turns: DataFrame, **columns) -> DataFrame:
    """(conv, part, turns, text) of maximal conversations; part numbers blocks of turns in order."""
    hashed = cut(rolling(turns, **columns))
    kept = maximal(hashed).withColumnRenamed("conv", "c")
    rows = hashed.join(kept, hashed["conv"].eqNullSafe(F.col("c"))).drop("c")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    part = F.floor((F.col("place") - 1) / BLOCK).alias("part")
    ordered = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    parts = rows.groupBy("conv", part).agg(F.first("turns").alias("turns"), F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("text"))
    return parts.select("conv", "part", "turns", "text")


def report(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, part, n_turns, text."""
    return render(turns).select(F.col("conv").alias("conv_id"), "part", F.col("turns").alias("n_turns"), "text")
