"""Line diffs between two states of files, as unified diffs; applying them; merge bases of commits.

Files of both sides meet by path in one join; each pair is compared by a small helper in
an Arrow batch, so the work is spread by file and a task holds one batch of texts. Renames and
patches are joins and groupings.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.exprs import basename
from rippletrace.functions.ordering import numbered_widely, ordered_list
from rippletrace.functions.shared import cut
from rippletrace.operators import diff

CONTEXT, SIMILAR = 3, 50
NO_NEWLINE = "\\ No newline at end of file\n"
HUNK = re.compile(r"@@ -(\d+),(\d+) ")


# One pair of texts ---------------------------------------------------------------------------------


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs (by rising first part) whose second part rises too."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def matches(a: list, b: list) -> list[tuple[int, int, int]]:
    """Runs (i, j, n) of equal lines, rising on both sides.

    Equal ends are matched first; then lines that occur once on each side, as many as rise together;
    where there is none, the rarest common line nearest to the middle. What lies between is compared
    likewise. Memory is linear in the lines, and a split by a repeated line is near the middle.
    """
    runs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        k = 0
        while i + k < m and j + k < n and a[i + k] == b[j + k]:
            k += 1
        if k:
            runs.append((i, j, k))
        i, j, k = i + k, j + k, 0
        while m - k > i and n - k > j and a[m - k - 1] == b[n - k - 1]:
            k += 1
        if k:
            runs.append((m - k, n - k, k))
        m, n = m - k, n - k
        if i == m or j == n:
            continue
        left, right = Counter(a[i:m]), Counter(b[j:n])
        common = [x for x in left if x in right]
        if not common:
            continue
        place = {b[q]: q for q in range(j, n) if right[b[q]] == 1 and left[b[q]] == 1}
        anchors = _rising([(p, place[a[p]]) for p in range(i, m) if a[p] in place])
        if not anchors:
            rare = min(common, key=lambda x: left[x] * right[x])
            p = min((p for p in range(i, m) if a[p] == rare), key=lambda p: abs(2 * p - i - m))
            share = (p - i) / (m - i)
            anchors = [(p, min((q for q in range(j, n) if b[q] == rare), key=lambda q: abs(q - j - share * (n - j))))]
        for p, q in anchors:
            todo.append((i, p, j, q))
            runs.append((p, q, 1))
            i, j = p + 1, q + 1
        todo.append((i, m, j, n))
    return sorted(runs)


def _lines(text: str) -> list[str]:
    """Lines with their line feeds; the last may have none."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


def hunks(base: str, head: str, context: int = CONTEXT) -> tuple[str, int, int]:
    """(text of the hunks, added lines, removed lines); no text where both are equal."""
    a, b = _lines(base), _lines(head)
    changes, i, j = [], 0, 0
    for p, q, n in [*matches(a, b), (len(a), len(b), 0)]:
        if p > i or q > j:
            if changes and i - changes[-1][-1][1] <= 2 * context:
                changes[-1].append((i, p, j, q))
            else:
                changes.append([(i, p, j, q)])
        i, j = p + n, q + n
    out, added, removed = [], 0, 0
    show = lambda mark, line: mark + line if line.endswith("\n") else f"{mark}{line}\n{NO_NEWLINE}"
    start = lambda at, n: f"{at + 1 if n else at},{n}"
    for group in changes:
        i0, j0 = max(group[0][0] - context, 0), max(group[0][2] - context, 0)
        lead = min(group[0][0] - i0, group[0][2] - j0)
        i0, j0 = group[0][0] - lead, group[0][2] - lead
        tail = min(context, len(a) - group[-1][1])
        i1, j1 = group[-1][1] + tail, group[-1][3] + tail
        out.append(f"@@ -{start(i0, i1 - i0)} +{start(j0, j1 - j0)} @@\n")
        at = i0
        for i, m, j, n in group:
            out += [show(" ", x) for x in a[at:i]] + [show("-", x) for x in a[i:m]] + [show("+", x) for x in b[j:n]]
            at, added, removed = m, added + n - j, removed + m - i
        out += [show(" ", x) for x in a[at:i1]]
    return "".join(out), added, removed


def applied(base: str, text: str) -> str:
    """What hunks make of a base: lines of context are taken from it, removed ones are left out."""
    a, out, i, last = _lines(base), [], 0, ""
    for line in _lines(text):
        kind = line[0]
        if kind == "@":
            start, count = map(int, HUNK.match(line).groups())
            at = start - 1 if count else start
            out += a[i:at]
            i = at
        elif kind == "+":
            out.append(line[1:])
        elif kind in " -":
            out += a[i : i + 1] if kind == " " else []
            i += 1
        elif last == "+":  # no line feed at the end of the file
            out[-1] = out[-1][:-1]
        last = kind
    return "".join(out + a[i:])


# Tables of files -----------------------------------------------------------------------------------


def _compare(pairs: DataFrame, context: int, *, digests: bool = False) -> DataFrame:
    """Rows with base_text and head_text, with hunks, added and removed instead; with `digests` also patched_sha256, of what the hunks make of the base."""
    kept = [c for c in pairs.columns if c not in ("base_text", "head_text")]
    made = ["hunks", "added", "removed", *(["patched_sha256"] if digests else [])]

    def work(batches):
        for batch in batches:
            done = []
            for b, h in zip(batch.column("base_text").to_pylist(), batch.column("head_text").to_pylist()):
                found = hunks(b or "", h or "", context)
                done.append((*found, hashlib.sha256(applied(b or "", found[0]).encode()).hexdigest()) if digests else found)
            columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string())[: len(made)])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *made])

    schema = pairs.select(*kept).schema.add("hunks", "string").add("added", "long").add("removed", "long")
    return pairs.mapInArrow(work, schema.add("patched_sha256", "string") if digests else schema)


def pair_diffs(pairs: DataFrame, *, context: int = CONTEXT) -> DataFrame:
    """Rows with path, base_text and head_text, with status, diff and patched_sha256 (the digest of the base after the diff) instead of the texts.

    A null base is a file that is added. Equal texts are unchanged, and have neither diff nor digest. Nothing is shuffled.
    """
    base, head = F.col("base_text"), F.col("head_text")
    status = F.when(base.isNull(), "added").when(base == head, "unchanged").otherwise("modified")
    differs = F.col("status") != "unchanged"
    rows = pairs.withColumn("status", status).withColumns({"base_text": F.when(differs, base), "head_text": F.when(differs, head)})
    path = F.col("path")
    named = _compare(rows, context, digests=True).withColumns({"old_path": path, "new_path": path, "similarity": F.lit(None).cast("int")})
    named = named.withColumns({"diff": F.when(differs, F.concat(header(), "hunks")), "patched_sha256": F.when(differs, F.col("patched_sha256"))})
    return named.drop("old_path", "new_path", "similarity", "hunks", "added", "removed")


def _line_weights(files: DataFrame, *keys: str) -> DataFrame:
    lines = files.select(*keys, F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy(*keys, F.xxhash64("line").alias("h"), (F.length("line") + 1).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(analysis_id, old_path, new_path, similarity): files with equal content, first with first by path; then files of one
    name, alone of it on each side, that share at least `SIMILAR` percent of the larger one's characters by equal lines."""
    texts, placed, rest = [], [], []
    for name, files in (("old_path", gone), ("new_path", new)):
        texts.append(files.where(F.length("text") > 0).select("analysis_id", F.col("path").alias(name), "text"))
        hashed = texts[-1].select("analysis_id", name, F.sha2("text", 256).alias("digest"))
        placed.append(numbered_widely(hashed, "k", ["analysis_id", "digest"], name))  # one content may be that of very many files
    same = cut(placed[0].join(placed[1], ["analysis_id", "digest", "k"]).select("analysis_id", "old_path", "new_path", F.lit(100).alias("similarity")))
    for name, side in zip(("old_path", "new_path"), texts):
        left = side.join(same, ["analysis_id", name], "left_anti").withColumn("name", basename(F.col(name)))
        alone = left.groupBy("analysis_id", "name").agg(F.count(F.lit(1)).alias("n"), F.first(name).alias(name)).where("n = 1").drop("n")
        rest.append((alone, left))
    pairs = rest[0][0].join(rest[1][0], ["analysis_id", "name"]).drop("name")
    size = lambda side, name: side.select("analysis_id", name, F.length("text").alias(f"size_{name}"))
    old = _line_weights(rest[0][1].join(pairs, ["analysis_id", "old_path"], "left_semi"), "analysis_id", "old_path")
    fresh = _line_weights(rest[1][1].join(pairs, ["analysis_id", "new_path"], "left_semi"), "analysis_id", "new_path").withColumnRenamed("n", "m")
    shared = pairs.join(old, ["analysis_id", "old_path"]).join(fresh, ["analysis_id", "new_path", "h", "size"]).groupBy("analysis_id", "old_path", "new_path").agg(F.sum(F.least("n", "m") * F.col("size")).alias("shared"))
    sized = shared.join(size(rest[0][1], "old_path"), ["analysis_id", "old_path"]).join(size(rest[1][1], "new_path"), ["analysis_id", "new_path"])
    percent = F.least(F.floor(100 * F.col("shared") / F.greatest("size_old_path", "size_new_path")), F.lit(100)).cast("int")
    return same.unionByName(sized.select("analysis_id", "old_path", "new_path", percent.alias("similarity")).where(F.col("similarity") >= SIMILAR))


def file_diffs(base: DataFrame, head: DataFrame, *, detect_renames: bool = True, context: int = CONTEXT) -> DataFrame:
    """(analysis_id, old_path, new_path, status, similarity, added, removed, diff) of files that differ, from two tables (analysis_id, path, content).

    A null content is an empty file; a path that repeats in an analysis meets all of its others. Both states meet once; what differs is written.
    """
    left, right = (f.select("analysis_id", "path", F.coalesce("content", F.lit("")).alias(text)) for f, text in ((base, "base_text"), (head, "head_text")))
    both = left.join(right, ["analysis_id", "path"], "full")
    both = cut(both.where(F.col("base_text").isNull() | F.col("head_text").isNull() | (F.col("base_text") != F.col("head_text"))))
    kept = both.where("base_text IS NOT NULL AND head_text IS NOT NULL").select("analysis_id", F.col("path").alias("old_path"), F.col("path").alias("new_path"), "base_text", "head_text")
    gone = both.where("head_text IS NULL").select("analysis_id", "path", F.col("base_text").alias("text"))
    new = both.where("base_text IS NULL").select("analysis_id", "path", F.col("head_text").alias("text"))
    none = F.lit(None).cast("string")
    columns = ["analysis_id", "old_path", "new_path", "base_text", "head_text", "status", "similarity"]
    parts = kept.withColumn("status", F.lit("modified")).withColumn("similarity", F.lit(None).cast("int")).select(columns)
    if detect_renames:
        moved = cut(renames(gone, new))
        texts = moved.join(gone.select("analysis_id", F.col("path").alias("old_path"), F.col("text").alias("base_text")), ["analysis_id", "old_path"]).join(new.select("analysis_id", F.col("path").alias("new_path"), F.col("text").alias("head_text")), ["analysis_id", "new_path"])
        parts = parts.unionByName(texts.withColumn("status", F.lit("renamed")).select(columns))
        gone = gone.join(moved.select("analysis_id", F.col("old_path").alias("path")), ["analysis_id", "path"], "left_anti")
        new = new.join(moved.select("analysis_id", F.col("new_path").alias("path")), ["analysis_id", "path"], "left_anti")
    parts = parts.unionByName(gone.select("analysis_id", F.col("path").alias("old_path"), F.col("path").alias("new_path"), F.col("text").alias("base_text"), none.alias("head_text"), F.lit("deleted").alias("status"), F.lit(None).cast("int").alias("similarity")))
    parts = parts.unionByName(new.select("analysis_id", F.col("path").alias("old_path"), F.col("path").alias("new_path"), none.alias("base_text"), F.col("text").alias("head_text"), F.lit("added").alias("status"), F.lit(None).cast("int").alias("similarity")))
    return _compare(parts, context).select("analysis_id", "old_path", "new_path", "status", "similarity", "added", "removed", F.concat(header(), "hunks").alias("diff"))


def header() -> Column:
    """The head of a file's diff, from old_path, new_path, status, similarity and hunks."""
    line = lambda *parts: F.concat(*[F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)], F.lit("\n"))
    status = F.col("status")
    mode = F.when(status == "added", "new file mode 100644\n").when(status == "deleted", "deleted file mode 100644\n").when(status == "renamed", F.concat(F.lit("similarity index "), F.col("similarity").cast("string"), F.lit("%\nrename from "), "old_path", F.lit("\nrename to "), "new_path", F.lit("\n"))).otherwise("")
    sides = F.concat(F.when(status == "added", "--- /dev/null\n").otherwise(line("--- a/", "old_path")), F.when(status == "deleted", "+++ /dev/null\n").otherwise(line("+++ b/", "new_path")))
    return F.concat(line("diff --git a/", "old_path", " b/", "new_path"), mode, F.when(F.col("hunks") != "", sides).otherwise(""))


def whole_diffs(files: DataFrame) -> DataFrame:
    """(analysis_id, diff): the diffs of an analysis in the order of paths, as one text."""
    return files.groupBy("analysis_id").agg(F.array_join(ordered_list(F.col("diff"), "new_path", "old_path"), "").alias("diff"))


def patch(base: DataFrame, files: DataFrame) -> DataFrame:
    """(analysis_id, path, content): the files of `base` after the diffs of `files`."""
    same = base.join(files.select("analysis_id", F.col("old_path").alias("path")).where(F.col("old_path").isNotNull()), ["analysis_id", "path"], "left_anti")
    return same.select("analysis_id", "path", "content").unionByName(patched(base, files))


def patched(base: DataFrame, files: DataFrame) -> DataFrame:
    """(analysis_id, path, content): the files that the diffs of `files` leave, read back by the parser of diffs.

    A line of the base goes where a removed line has its number; an added line comes before
    the base line that follows it in its hunk. Diffs do not travel with the texts that they change.
    """
    named = files.select("analysis_id", "old_path", "new_path", "status", "diff", F.md5(F.concat_ws("\x00", "analysis_id", "old_path", "new_path")).alias("file"))
    lines = diff.parse_lines(named.select(F.col("file").alias("analysis_id"), "diff"), strict=True)
    in_hunk = Window.partitionBy("analysis_id", "file_seq", "hunk_seq").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    eaten = F.coalesce(F.sum((F.col("type") != "added").cast("int")).over(in_hunk), F.lit(0))
    first = F.col("old_start") + F.when(F.col("old_count") == 0, 1).otherwise(0)
    lines = lines.select(F.col("analysis_id").alias("file"), "type", "content", "pos", (first + eaten).alias("no"))
    text = F.coalesce("content", F.lit(""))
    old = base.select("analysis_id", F.col("path").alias("old_path"), text.alias("text"), ((text != "") & ~text.endswith("\n")).alias("open_end"))
    marked = F.when(F.col("diff").rlike(r"\n[+ ][^\n]*\n\\ "), True).when(F.col("diff").rlike(r"\n-[^\n]*\n\\ "), False).alias("marked")
    touched = named.where("status <> 'deleted'").select("analysis_id", "old_path", "new_path", "status", "file", marked).join(old, ["analysis_id", "old_path"], "left")
    added = F.col("status") == "added"
    open_end = ~added & F.coalesce("open_end", F.lit(False))
    touched = touched.select("analysis_id", "new_path", "file", F.coalesce("marked", open_end).alias("missing"), F.when(added, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    split = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("text", r"\n\z", ""), "\n"))
    kept = touched.select("file", F.posexplode(split).alias("k", "content")).select("file", (F.col("k") + 1).alias("no"), "content")
    kept = kept.join(lines.where("type = 'removed'").select("file", "no"), ["file", "no"], "left_anti").select("file", "no", F.lit(1).alias("late"), F.lit(0).alias("pos"), "content")
    rows = kept.unionByName(lines.where("type = 'added'").select("file", "no", F.lit(0).alias("late"), "pos", "content"))
    text = rows.groupBy("file").agg(F.array_join(ordered_list(F.col("content"), "no", "late", "pos"), "\n").alias("body"))
    return touched.join(text, "file", "left").select("analysis_id", F.col("new_path").alias("path"), F.when(F.col("body").isNull(), "").otherwise(F.concat("body", F.when(F.col("missing"), "").otherwise("\n"))).alias("content"))


def merge_base(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(analysis_id, base, head, merge_base): best common ancestors of two commits, several where histories cross.

    `commits` has (analysis_id, commit, parents) and is written once; all pairs walk together, one written step for each
    generation. A step that is small is broadcast to what has been seen, so only large ones shuffle that again. What both sides reach is closed under parents, so the best are those that are no parent of another.
    """
    links = cut(commits.select("analysis_id", F.col("commit").alias("at"), F.explode("parents").alias("parent")))
    key = ["analysis_id", "base", "head"]
    seen = level = pairs.select(*key, F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("base").alias("at")), F.struct(F.lit(2).alias("side"), F.col("head").alias("at")))).alias("s")).select(*key, "s.side", "s.at").distinct()
    seen = level = cut(level)
    while not level.isEmpty():
        step = cut(level.join(links, ["analysis_id", "at"]).select(*key, "side", F.col("parent").alias("at")).distinct())
        known = seen.join(step, [*key, "side", "at"], "left_semi")
        level = cut(step.join(known, [*key, "side", "at"], "left_anti"))
        seen = seen.unionByName(level)
    common = cut(seen.groupBy(*key, "at").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n"))
    older = common.join(links, ["analysis_id", "at"]).select(*key, F.col("parent").alias("at"))
    return common.join(older, [*key, "at"], "left_anti").select(*key, F.col("at").alias("merge_base"))
