"""Line diffs: applied to the base they give the head; renames, merge bases, long files."""

import random
import time

import pytest

from rippletrace.operators import diff, linediff

FILE = "analysis_id string, path string, content string"
LINES = ["", "}", "{", "a", "b", "c", "-- x", "++ y", "--- a/f", "@@ -1 +1 @@", "\\ no", "diff --git a/x b/y", "é z", " tab\t", "\r"]


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randrange(0, 5)):
        at = rng.randrange(len(out) + 1)
        what = rng.randrange(4)
        if what == 0:
            out[at:at] = [rng.choice(LINES) for _ in range(rng.randrange(1, 4))]
        elif what == 1:
            del out[at : at + rng.randrange(1, 4)]
        elif what == 2 and out:
            out[min(at, len(out) - 1)] = f"n{rng.randrange(99)}"
        else:
            cut = rng.randrange(len(out) + 1)
            out = out[cut:] + out[:cut]
    return out


def pair(rng):
    lines = [rng.choice([*LINES, f"u{k}", f"u{k}"]) for k in range(rng.randrange(0, 40))]
    return tuple("\n".join(x) + rng.choice(["", "\n"]) for x in (lines, edited(rng, lines)))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_matches_rise_and_are_near_the_longest():
    rng, found, best = random.Random(1), 0, 0
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") + str(rng.randrange(3)) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        if rng.random() < 0.7:
            b = edited(rng, a)
        runs, i, j = linediff.matches(a, b), 0, 0
        for p, q, n in runs:
            assert p >= i and q >= j and n > 0 and a[p : p + n] == b[q : q + n]
            i, j = p + n, q + n
        found += sum(n for _, _, n in runs)
        best += longest_common(a, b)
    assert found >= 0.9 * best


def test_diffs_applied_to_the_base_give_the_head(spark):
    rng = random.Random(5)
    pairs = [pair(rng) for _ in range(250)] + [("", ""), ("", "\n"), ("x", "x\n"), ("x\n", "x"), ("a\nb", "a"), ("\n\n\n", "\n")]
    base = [(f"a{k % 7}", f"d/f{k}.ts", p) for k, (p, _) in enumerate(pairs)]
    head = [(f"a{k % 7}", f"d/f{k}.ts", q) for k, (_, q) in enumerate(pairs)]
    base += [("a0", "gone.ts", "bye\n"), ("a0", "null.ts", None), ("a1", "old/m.ts", "l1\nl2\nl3\n"), ("a1", "old/n.ts", "".join(f"row {k}\n" for k in range(20))), ("a1", "e.ts", "")]
    head += [("a0", "new.ts", "hi"), ("a0", "null.ts", "now\n"), ("a1", "lib/k.ts", "l1\nl2\nl3\n"), ("a1", "lib/n.ts", "".join(f"row {k}\n" for k in range(19)) + "other\n"), ("a1", "e2.ts", "")]
    b, h = spark.createDataFrame(base, FILE), spark.createDataFrame(head, FILE)
    files = linediff.file_diffs(b, h).cache()
    moved = {(r.old_path, r.new_path, r.similarity) for r in files.where("status = 'renamed'").collect()}
    assert moved == {("old/m.ts", "lib/k.ts", 100), ("old/n.ts", "lib/n.ts", 94)}
    got = {(r.analysis_id, r.path): r.content for r in linediff.patch(b, files).collect()}
    assert got == {(a, p): c or "" for a, p, c in head}
    counts = {r.new_path: (r.added, r.removed) for r in files.collect()}
    assert counts["new.ts"] == (1, 0) and counts["gone.ts"] == (0, 1) and counts["d/f252.ts"] == (1, 1)


def test_whole_diffs_are_read_by_the_parser(spark):
    b = spark.createDataFrame([("q", "a.ts", "x\ny\n"), ("q", "b.ts", "1\n")], FILE)
    h = spark.createDataFrame([("q", "a.ts", "x\nz\n"), ("q", "c.ts", "2\n")], FILE)
    whole = linediff.whole_diffs(linediff.file_diffs(b, h))
    assert {(r.new_path, r.status) for r in diff.parse_files(whole).collect()} == {("a.ts", "modified"), ("b.ts", "deleted"), ("c.ts", "added")}
    lines = {(r.new_path, r.type, r.content, r.old_line, r.new_line) for r in diff.parse_lines(whole).collect() if r.type != "context"}
    assert lines == {("a.ts", "removed", "y", 2, None), ("a.ts", "added", "z", None, 2), ("b.ts", "removed", "1", 1, None), ("c.ts", "added", "2", None, 1)}


@pytest.mark.parametrize("kind", ["distinct", "repeated", "swapped"])
def test_long_files_take_time_in_proportion(kind):
    n = 60_000
    a = [f"l{k}\n" for k in range(n)] if kind != "repeated" else ["ab"[(k * k) % 7 % 2] + "\n" for k in range(n)]
    b = a[n // 2 :] + a[: n // 2] if kind == "swapped" else [x for k, x in enumerate(a) if k % 97] + ["end\n"]
    began = time.time()
    text, added, removed = linediff.hunks("".join(a), "".join(b))
    assert time.time() - began < 20 and added - removed == len(b) - len(a)
    assert (added, removed) == (1, n // 97 + 1) or kind != "distinct"


def test_no_files_and_no_changes(spark):
    none = spark.createDataFrame([], FILE)
    one = spark.createDataFrame([("a", "f", "x\n")], FILE)
    assert linediff.file_diffs(none, none).count() == 0 and linediff.file_diffs(one, one).count() == 0
    assert [tuple(r) for r in linediff.patch(one, linediff.file_diffs(one, one)).collect()] == [("a", "f", "x\n")]


def test_merge_bases(spark):
    rng, commits, above = random.Random(3), [], {}
    for k in range(40):
        parents = sorted({rng.randrange(max(0, k - 6), k) for _ in range(rng.randrange(1, 3))}) if k else []
        commits.append(("r", f"c{k}", [f"c{p}" for p in parents]))
        above[k] = {k}.union(*(above[p] for p in parents))
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(12)]
    want = set()
    for x, y in pairs:
        common = above[x] & above[y]
        want |= {(f"c{x}", f"c{y}", f"c{m}") for m in common if not any(m in above[o] for o in common - {m})}
    got = linediff.merge_base(spark.createDataFrame(commits, "analysis_id string, commit string, parents array<string>"), spark.createDataFrame([("r", f"c{x}", f"c{y}") for x, y in pairs], "analysis_id string, base string, head string"))
    assert {(r.base, r.head, r.merge_base) for r in got.collect()} == want
