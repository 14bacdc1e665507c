"""Clones as tables, held against what git itself says."""

import os
import random
import shutil
import subprocess

import pytest

from rippletrace.operators import linediff
from rippletrace.sources import repository as R

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="no git here")


def git(folder, *args, **more):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}
    return subprocess.run(["git", "-C", str(folder), *args], check=True, capture_output=True, env=env, **more).stdout


def build(folder, by_place):
    """Thirty commits on two branches, packed with deltas by place or by name, then loose ones, a remote branch and tags."""
    rng = random.Random(2)
    git(folder, "init", "-q", "-b", "main")
    git(folder, "config", "repack.useDeltaBaseOffset", by_place)
    lines = [f"export const x{k} = {rng.random()};" for k in range(400)]

    def commit(k):
        for _ in range(5):
            lines[rng.randrange(len(lines))] = f"// {rng.random()}"
        for name in ("src/big.ts", "src/deep/er/a.tsx", "db/schema.prisma", "node_modules/m/i.js", "notes.md", f"src/n{k % 7}.js"):
            os.makedirs(folder / os.path.dirname(name), exist_ok=True)
            (folder / name).write_text("\n".join(lines[: 400 if "big" in name else 5 + k]) + "\n")
        (folder / "src/odd é.ts").write_bytes(b"let a = '\xff\xe9';\n")
        git(folder, "add", "-A")
        git(folder, "commit", "-qm", f"c{k}")

    for k in range(20):
        commit(k)
    git(folder, "checkout", "-qb", "side", "HEAD~6")
    for k in range(20, 26):
        commit(k)
    git(folder, "tag", "-a", "v1", "-m", "one")
    git(folder, "repack", "-adfq", "--depth=20", "--window=20")
    git(folder, "pack-refs", "--all")
    git(folder, "checkout", "-q", "main")
    git(folder, "update-ref", "refs/remotes/origin/topic", "side~2")
    git(folder, "update-ref", "refs/heads/topic", "main~1")
    os.symlink("big.ts", folder / "src/link.ts")
    for k in range(26, 29):
        commit(k)
    git(folder, "merge", "-q", "-s", "ours", "-m", "join", "side~3")
    commit(29)
    return str(folder)


@pytest.fixture(scope="module")
def clone(tmp_path_factory):
    return build(tmp_path_factory.mktemp("clone"), "true")


def wanted(spark, *names):
    return spark.createDataFrame([(f"a-{n}", n) for n in names], "analysis_id string, ref string")


def expected(folder, commit):
    out = {}
    for line in git(folder, "ls-tree", "-rz", commit).decode("utf-8", "replace").split("\0")[:-1]:
        mode, _, oid = line.split("\t")[0].split()
        path = line.split("\t")[1]
        if mode != "120000" and path.endswith((".ts", ".tsx", ".js", ".prisma")) and "node_modules" not in path:
            out[path] = git(folder, "cat-file", "blob", oid).decode("utf-8", "replace")
    return out


@pytest.mark.parametrize("by_place", ["true", "false"])
def test_objects_equal_git(spark, tmp_path, by_place):
    clone = build(tmp_path, by_place)
    listed = dict(line.split()[:2] for line in git(clone, "cat-file", "--batch-all-objects", "--batch-check=%(objectname) %(objecttype)").decode().splitlines())
    spark.dataSource.register(R.GitObjects)
    found = {(r.oid, r.kind): bytes(r.data) for r in spark.read.format("git_objects").option("path", clone).option("range", 17).load().collect()}
    assert {o: k for o, k in found} == listed and len(found) > 150
    raw = git(clone, "cat-file", "--batch", input="\n".join(o for o, _ in found).encode())
    at = 0
    for (oid, kind), data in found.items():
        head = f"{oid} {kind} {len(data)}\n".encode()
        assert raw[at : at + len(head) + len(data)] == head + data
        at += len(head) + len(data) + 1


def test_files_at_refs_equal_a_checkout(spark, clone):
    names = {"main": "main", "topic": "side~2", "v1": "side", "missing": "HEAD", "side": "side"}
    got = {}
    for r in R.files_at(spark, clone, wanted(spark, *names)).collect():
        got.setdefault(r.analysis_id[2:], {})[r.path] = r.content
    assert got == {n: expected(clone, c) for n, c in names.items()}
    at = {r.ref: r.checkout for r in R.resolved(spark, clone, wanted(spark, *names)).collect()}
    assert at == {"main": "main", "topic": "origin/topic", "v1": "v1", "missing": "HEAD", "side": "side"}


def test_diff_of_two_refs_through_their_merge_base(spark, clone):
    ids = {n: git(clone, "rev-parse", n).decode().strip() for n in ("main", "side")}
    commits = R.commits(spark, clone).selectExpr("'a' AS analysis_id", "commit", "parents")
    base = linediff.merge_base(commits, spark.createDataFrame([("a", ids["main"], ids["side"])], "analysis_id string, base string, head string")).collect()
    assert {r.merge_base for r in base} == set(git(clone, "merge-base", "--all", "main", "side").decode().split())
    files = lambda ref: R.files_at(spark, clone, spark.createDataFrame([("a", ref)], "analysis_id string, ref string"))
    old, new = files("main"), files("side")
    diffs = linediff.file_diffs(old, new)
    assert {r.path: r.content for r in linediff.patch(old, diffs).collect()} == expected(clone, "side")


def test_an_empty_clone(spark, tmp_path):
    git(tmp_path, "init", "-q")
    assert R.refs(spark, str(tmp_path)).count() == 0 and R.files_at(spark, str(tmp_path), wanted(spark, "main")).count() == 0
