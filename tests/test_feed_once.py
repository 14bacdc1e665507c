"""The change feed shuffles texts once, writes no text but in diffs, and leaves no table behind that nothing reads."""

import json
import random

from jobs import change_feed
from rippletrace.functions import shared
from rippletrace.operators import linediff


def config():
    with open(change_feed.CONFIG) as file:
        return json.load(file)


def tables(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_a_batch_is_written_once_without_its_texts(spark, monkeypatch):
    written = []
    for module in (change_feed, linediff):
        monkeypatch.setattr(module, "cut", lambda *parts: written.append(shared.cut(*parts)) or written[-1])
    head, base = tables(spark, [(1, "a\nb", "en"), (2, "same\n", "de"), (3, None, None)]), tables(spark, [(1, "a\nc\n", "en"), (2, "same\n", "de"), (4, "x", "en")])
    changes, diffs = change_feed.compare(head, base, config())
    assert sorted((r.key, r.status, r.base_lines, r.head_lines) for r in changes.collect()) == [(1, "modified", 2, 2), (2, "unchanged", 1, 1), (3, "added", 0, 0)]
    assert diffs.where("key = 1").first().diff.endswith(" a\n-c\n+b\n\\ No newline at end of file\n") and diffs.count() == 2
    assert len(written) == 1 and not {"content", "base_text", "head_text"} & set(written[0].columns)


def test_slices_of_keys_change_no_rows(spark, monkeypatch):
    texts = [f"line {k}\n" * (k % 4) for k in range(40)]
    head, base = tables(spark, [(k, t + "x", "en") for k, t in enumerate(texts)]), shared.cut(tables(spark, [(k, t, "en") for k, t in enumerate(texts) if k % 5]))
    found = lambda: [sorted(map(tuple, df.collect())) for df in change_feed.compare(head, base, config())]
    want = found()
    monkeypatch.setattr(change_feed, "SLICE", 1)
    assert found() == want and len(want[0]) == 40


def test_a_run_leaves_only_its_tables(spark, tmp_path):
    tables(spark, [(1, "a\n", "en")]).write.parquet(str(tmp_path / "in"))
    before = list(shared._written)
    assert change_feed.run(spark, str(tmp_path / "in"), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), config()) == {"unchanged": 1}
    assert shared._written == before


def test_hunks_read_back_make_the_head():
    rng = random.Random(6)
    line = lambda: rng.choice(["a", "b", "", "@@ -1,2 +1,1 @@", "\\ x", "+q", "-z"]) + rng.choice(["\n", "\n", ""])
    for _ in range(2000):
        base, head = ("".join(line() for _ in range(rng.randrange(9))) for _ in range(2))
        assert linediff.applied(base, linediff.hunks(base, head, rng.randrange(4))[0]) == head
