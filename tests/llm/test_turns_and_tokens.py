"""Repair of conversations and token counts against brute force, the library and SQL, and their defined cases."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rippletrace.llm import token_counts, turn_repair
from rippletrace.llm.queries import QUERIES
from rippletrace.llm.sql import OP11

TURNS = "conv_id long, turn long, role string, text string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def brute_repair(rows):
    """Every row's answer by a search over edit sequences, cheapest and then ASCII-least first."""
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        seen, kinds = set(), []
        for _, role, text in turns:
            filled = re.findall("[^\x20\x09-\x0d]", text)
            kinds.append("b" if not filled else "d" if (role, text) in seen else "t" if filled[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, p, q, said = heapq.heappop(heap)
            if p == len(turns) and q in (0, 3):
                break
            if (p, q) in done:
                continue
            done.add((p, q))
            for role in ("user", "assistant"):
                if (q, role[0]) in STEP:
                    heapq.heappush(heap, (cost + 2, audit + "I", p, STEP[q, role[0]], (*said, role + ":")))
            if p < len(turns):
                _, role, text = turns[p]
                late = int(kinds[p] == "t")
                heapq.heappush(heap, (cost + 3, audit + "D", p + 1, q, said))
                if kinds[p] in ("b", "d"):
                    continue
                for letter, price, name in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    then = q if name == "" else STEP.get((q, name[0]))
                    if then is not None:
                        heapq.heappush(heap, (cost + price + late, audit + letter, p + 1, then, (*said, f"{name}:{text}")))
        out[conv] = (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def answers(df):
    return {r[0]: tuple(r)[1:] for r in turn_repair.report(df).collect()}


def turns_of(seed, n=80):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(n)]:
        for _ in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 4, 5, 9, 300, 600]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]), rng.choice(["a.", "b", "c!", " \n ", None, "", "x. \n", "hi there", "ok."])))
    return rows


@pytest.mark.parametrize("dense", [4096, 30])
def test_repair_against_brute_force_and_sql(spark, monkeypatch, dense):
    monkeypatch.setattr(turn_repair, "DENSE", dense)
    monkeypatch.setattr(turn_repair, "PART", 10)
    rng = random.Random(9)
    rows = turns_of(dense)
    rows += [(998, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b"]) + f"{k % 97}.") for k in range(900)]  # spans blocks
    rows += [(999, 0, rng.choice(["user", "assistant"]), f"t{k}.") for k in range(300)]  # one turn number for all
    rows += [(997, 5, "user", "the same.")] * 40
    want = brute_repair(rows)
    assert answers(spark.createDataFrame(rows, TURNS)) == want
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    assert {r[0]: tuple(r)[1:] for r in con.sql(OP11).fetchall()} == want


def test_repaired_turns_have_the_form(spark):
    rows = [(c, t, r, x, 1) for c, t, r, x in turns_of(4)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string, copies int")
    found = {}
    for r in turn_repair.repair(turns).orderBy("key", "place").collect():
        found.setdefault(r.key, []).append(r)
    assert len(found) > 50
    for key, said in found.items():
        assert [r.place for r in said] == list(range(len(said)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in said)), key
        assert all(r.text == "" for r in said if r.edit == "I") and {r.edit for r in said} <= set("KRI")


def test_states_are_few(spark):
    machine, rng = turn_repair.Determinised(), random.Random(2)
    for _ in range(300):
        machine.block("".join(rng.choice("suaoeSUAOE12345") for _ in range(rng.randrange(1, 60))))
    assert len(machine.vectors) <= 30 and len(machine.arcs) <= 30 * 15


def test_repair_defined_cases(spark):
    empty = turn_repair.report(spark.createDataFrame([], TURNS))
    assert empty.count() == 0 and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    dropped = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(*dropped, "user", "x", 1, "y")], TURNS + ", key int, block string")  # other columns with names of the operator's own
    assert answers(df) == {dropped[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = spark.createDataFrame([(5, 1, "user", "w " * 400_000 + "."), (5, 2, "assistant", "y" * 300_000)], TURNS)
    assert answers(long) == brute_repair([tuple(r) for r in long.collect()])


# Token counts --------------------------------------------------------------------------------------


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x in enumerate(texts)}


def test_counts_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 40)  # both generations of the cache turn over
    rng = random.Random(1)
    letters = [*" \n\t'a1.éß中٣​　\x1c\x85 ½²ªⅣ", "<|endoftext|>", "<|endof", "'ll", "\U0001f600", "\U00020000", "ՠ", "࢏", "꟎", "the ", " and"]
    texts = [None, "", " ", "a" * 50_000, "\n" * 3000, "<|endoftext|>", "the same", "the same"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.report(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got == library_counts(texts)


def test_query_counts_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = library_counts([r.text for r in rows])
    assert got == {r.doc_id: (*want[k], want[k][1] > 1024) for k, r in enumerate(rows)}


def test_frequent_pieces_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SHARE", 8)
    df = spark.createDataFrame([("a b c d e f g h i j",), ("a a a a a a a a a a",), (None,)], "text string")
    assert set(token_counts.frequent(df, public_tokenizers.path("byte_bpe_50k.json"))) == {" a"}


def test_counts_defined_cases(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.report(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0
    odd = spark.createDataFrame([(None, "x y", 1, [2])], "doc_id long, text string, n_tokens int, in_0 array<int>")
    assert [tuple(r) for r in token_counts.counted(odd, path).collect()] == [(None, "x y", 1, [2], 2)]
    with pytest.raises(ValueError):
        token_counts.check(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.report(odd.select(F.lit(7).alias("doc_id"), "text"), path).first().over_limit is False
