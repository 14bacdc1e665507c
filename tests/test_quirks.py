"""One small case for each behaviour that changes results, and for the flags that mend it."""

from pyspark.sql import functions as F

from rippletrace.functions import exprs as X
from rippletrace.operators import changes, diff, enrich, graph, prisma, rules, scoring, traverse, ts_scan, usage
from rippletrace.plans.analyze import Options, analyze
from rippletrace.sources import files as S

from . import fixture


def lines(spark, text, **flags):
    return diff.parse_lines(spark.createDataFrame([("a", text)], "analysis_id string, diff string"), **flags).orderBy("pos").collect()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


HEAD = "diff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n"


def test_q1_recorded_prisma_line_is_one_too_high(spark):
    f = spark.createDataFrame([("a", 1, "s.prisma", "model U {\n  id Int\n}\n")], "analysis_id string, file_seq int, path string, content string")
    row = lambda fix: prisma.symbols(f, line_fix=fix).where("type = 'database_field'").first()
    assert row(False).start_line == 3 and row(True).start_line == 2


def test_q2_q3_base_side_symbols(spark):
    head = {"a.ts": "export function kept() {\n  return 1;\n}\n"}
    base = {"a.ts": "export function kept() {\n  return 1;\n}\nexport function gone() {\n  return 2;\n}\n"}
    text = "diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -4,3 +3,0 @@\n-export function gone() {\n-  return 2;\n-}\n"
    files, diffs = fixture.frames(spark, files=head, diff=text)
    old, _ = fixture.frames(spark, files=base)
    assert analyze(files, diffs)["changes"].count() == 0
    found = analyze(files, diffs, base_files=old, options=Options(base_side_symbols=True))["changes"].collect()
    assert [(r.name, r.change_type) for r in found] == [("gone", "deleted")]


def test_q4_signature_change_needs_its_flag(spark):
    files = {"a.ts": "export function f(a: number, b: number) {\n  return a;\n}\n", "b.ts": 'import { f } from "./a";\nexport function g() {\n  return f(1);\n}\n'}
    text = "diff --git a/a.ts b/a.ts\n--- a/a.ts\n+++ b/a.ts\n@@ -1,3 +1,3 @@\n-export function f(a: number) {\n+export function f(a: number, b: number) {\n   return a;\n }\n"
    frames = fixture.frames(spark, files=files, diff=text)
    assert analyze(*frames)["risks"].count() == 0
    t = analyze(*frames, options=Options(detect_signature_change=True))
    assert [r.change_type for r in t["changes"].collect()] == ["signature_changed"] and [r.category for r in t["risks"].collect()] == ["api_breaking_change"]


def test_q5_unpaired_property_yields_nothing(spark):
    files, diffs = fixture.frames(spark, diff="diff --git a/src/types.ts b/src/types.ts\n--- a/src/types.ts\n+++ b/src/types.ts\n@@ -2,1 +2,1 @@\n-  name: string;\n+  email: string | null;\n")
    assert analyze(files, diffs)["changes"].count() == 0


def test_q6_headers_inside_hunks(spark):
    text = HEAD + "@@ -1,3 +1,2 @@\n--- old\n---x\n+a"
    assert [(r.type, r.content) for r in lines(spark, text)] == [("context", "---x"), ("added", "a")]
    assert [(r.type, r.content) for r in lines(spark, text, strict=True)] == [("removed", "-- old"), ("removed", "--x"), ("added", "a")]


def test_q7_trailing_line_and_lines_before_a_hunk(spark):
    got = lines(spark, HEAD + "noise\n@@ -5 +7 @@\n c\n\\ No newline\n")
    assert [(r.type, r.content, r.old_line, r.new_line) for r in got] == [("context", "c", 5, 7), ("context", "", 6, 8)]


def test_q8_top_level_b_is_lost(spark):
    assert one(spark, X.clean_diff_path(F.lit("a/b/x.ts"))) == "x.ts"


def test_q9_blank_edits(spark):
    kind = lambda b, a: one(spark, X.change_type(F.lit(b), F.lit(a)))
    assert [kind("", ""), kind("x", ""), kind("", "x"), kind("x", "y"), kind("x: a", "x: b")] == ["modified", "deleted", "added", "modified", "type_changed"]


def usages(spark, code):
    df = spark.createDataFrame([(code,)], "code string")
    return [(u.field, u.kind, u.method or u.callee) for u in usage.with_usages(df).first().usages]


def test_q10_optional_chains(spark):
    assert usages(spark, "f(u: U) { u.f?.m(); u?.g; }") == [("U.f", "property_access", None)]


def test_q11_nullable_text(spark):
    assert one(spark, X.is_nullable_text(F.lit("a ? b : c"))) is False and one(spark, X.is_nullable_text(F.lit("a?.b"))) is True


def test_q12_nested_call_goes_to_the_outer(spark):
    assert ("U.x", "argument", "f") in usages(spark, "h(u: U) { f(g(u.x)) }") and ("U.x", "argument", "g") not in usages(spark, "h(u: U) { f(g(u.x)) }")


def test_q13_declaring_file_is_not_reached(spark):
    t = analyze(*fixture.frames(spark))
    assert not any("types.ts" in r.node_id for r in t["affected"].collect())


def imports(spark, source, aliases=None):
    files = spark.createDataFrame([("a", "src/x.ts", 1), ("a", "src/y/index.ts", 2)], "analysis_id string, path string, file_rank int")
    decl = spark.createDataFrame([("a", "src/m.ts", 0, source, 1)], "analysis_id string, file_path string, import_seq int, source string, line int")
    return [r.target_path for r in graph.resolve_imports(files, decl, aliases).collect()]


def test_q14_aliases_and_extensions(spark):
    assert imports(spark, "@/x") == [] and imports(spark, "@/x", {"@/": "src/"}) == ["src/x.ts"]
    assert imports(spark, "./x.js") == [] and imports(spark, "./x") == ["src/x.ts"] and imports(spark, "./y") == ["src/y/index.ts"]


RISK = ("a", 1, "r", "t", "d", "type", "high", 0.9, "static", "c", "n", "c", "n", "f", None, 1, ["c", "n"], ["e"], None, None)
RISK_TYPE = "analysis_id string, risk_seq int, id string, title string, description string, category string, severity string, confidence double, source string, changed_node_id string, affected_node_id string, changed_symbol string, affected_symbol string, file_path string, line int, dependency_depth int, failure_path array<string>, evidence array<string>, suggested_fix string, metadata struct<reason:string>"


def test_q15_unknown_severity_of_an_enrichment(spark):
    risks = spark.createDataFrame([RISK], RISK_TYPE)
    rows = spark.createDataFrame([("a", "r", "new", "", "awful", 0.0)], "analysis_id string, id string, description string, suggestedFix string, severity string, confidence double")
    loose, strict = (scoring.score(enrich.enrich(risks, rows, validate=v)).first() for v in (False, True))
    assert (loose.severity, loose.score, loose.description, loose.confidence, loose.source) == ("awful", None, "new", 0.9, "ai") and strict.severity == "medium" and strict.score is not None


def test_q16_q17_ceiling_and_depth(spark):
    score = lambda depth: one(spark, X.risk_score(F.lit("critical"), F.lit(1.0), F.lit(depth), F.lit("security"), F.lit("static")))
    assert score(1) == 98 and score(4) == 85


def test_q18_same_names_collapse(spark):
    other = RISK[:1] + (2, "r2") + RISK[3:]
    assert rules.dedupe_rule_risks(spark.createDataFrame([RISK, other], RISK_TYPE), "risk_seq").count() == 1


def test_q19_database_declaration_is_preferred(spark):
    rows = [("a", 1, "field:U.e", "U.e", "type", "t.ts", "type_changed", "x", "x?"), ("a", 2, "field:U.e", "U.e", "database_field", "s.prisma", "type_changed", "x", "x?"), ("a", 3, "field:U.e", "U.e", "type", "t.ts", "type_changed", "y", "x?")]
    df = spark.createDataFrame(rows, "analysis_id string, change_seq int, node_id string, name string, type string, file_path string, change_type string, before string, after string")
    got = changes.dedupe_semantic(df).orderBy("change_seq").collect()
    assert [(r.change_seq, r.type) for r in got] == [(1, "database_field"), (3, "type")]


def graph_of(spark, pairs):
    return spark.createDataFrame([("a", k, s, t) for k, (s, t) in enumerate(pairs)], "analysis_id string, edge_seq long, source string, target string")


def test_q20_one_path_per_node(spark):
    edges = graph_of(spark, [("x", "s2"), ("x", "s1"), ("y", "x")])
    seeds = spark.createDataFrame([("a", 1, "s1"), ("a", 2, "s2")], "analysis_id string, seed_seq int, seed string")
    got = traverse.combine(traverse.dependents(edges, seeds)).orderBy("out_seq").collect()
    assert [(r.node_id, r.seed, r.path) for r in got] == [("x", "s1", ["s1", "x"]), ("y", "s1", ["s1", "x", "y"])]


def test_traversal_equals_a_queue(spark):
    import random

    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(80)]
    queue, seen, want = [("n0", ["n0"])], {"n0"}, []
    while queue:
        at, path = queue.pop(0)
        if len(path) > 4:
            continue
        for s, t in pairs:
            if t == at and s not in seen:
                seen.add(s)
                want.append((s, len(path), path + [s]))
                queue.append((s, path + [s]))
    seeds = spark.createDataFrame([("a", 1, "n0")], "analysis_id string, seed_seq int, seed string")
    got = traverse.dependents(graph_of(spark, pairs), seeds).orderBy("depth", "order_key").collect()
    assert [(r.node_id, r.depth, r.path) for r in got] == want


def test_q21_dollar_names_never_match_as_arguments(spark):
    assert all(kind != "argument" for _, kind, _ in usages(spark, "f(a$b: U) { g(a$b.x) }"))


def test_self_edges_and_repeated_ids_go(spark):
    e = spark.createDataFrame([("a", 2, "i", "x", "y"), ("a", 1, "i", "x", "y"), ("a", 3, "j", "x", "x")], "analysis_id string, edge_seq int, id string, source string, target string")
    assert [r.edge_seq for r in graph.dedupe_edges(e, "edge_seq").collect()] == [1]


def test_locators(spark):
    for text, want in {"https://github.com/a/b.git": ("a", "b"), " a/b ": ("a", "b"), "x/y/z": ("y", "z"), "z": ("repo", "z")}.items():
        assert tuple(one(spark, S.repo_locator(F.lit(text)))) == want


def test_directory_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "dist").mkdir()
    (tmp_path / "src/a.ts").write_text("é")
    (tmp_path / "dist/b.ts").write_text("x")
    (tmp_path / "c.md").write_text("x")
    assert [(r.path, r.size, r.language, r.file_seq) for r in S.scan_directory(spark, str(tmp_path), "g").collect()] == [("src/a.ts", 2, "typescript", 1)]


def test_scanner_declarations():
    code = 'import D, { a as b, c } from "./m";\nimport * as n from "./n";\n// function no() {}\nexport async function f(x: A): Promise<{ v: string }> {\n  return g(`t ${h(1)}`, "j(");\n}\nexport interface I { a: string }\ntype T =\n  | A\n  | B;\nexport const p = async (q) => q, r: Map<string, number> = new Map<string, number>(), s = /k(/;\nclass K { m() { this.z(); } }\nexport function POST() {}\n'
    imported, symbols = ts_scan.parse("app/api/x.ts", code)
    assert [(i["source"], i["imported_names"], i["default_import"], i["namespace_import"]) for i in imported] == [("./m", ["a", "c"], "D", None), ("./n", [], None, "n")]
    assert [(s["type"], s["name"], s["start_line"], s["end_line"], s["exported"]) for s in symbols] == [
        ("function", "f", 4, 6, True), ("api_route", "POST", 13, 13, True), ("class", "K", 12, 12, False), ("interface", "I", 7, 7, True), ("type", "T", 8, 10, False), ("function", "p", 11, 11, True), ("variable", "r", 11, 11, True), ("variable", "s", 11, 11, True)]
    assert [c["name"] for c in symbols[0]["calls"]] == ["g", "h"] and [c["name"] for c in symbols[2]["calls"]] == ["this.z"]


def test_scanner_survives_odd_input():
    for code in ("", None, "}}}}", "`${`${`", "/*", "const", "export", "function", "class {", "type X", "import", 'import "', "let a = b ? c : d\nlet e", "((((", "a" * 5000, " const x = 1"):
        ts_scan.parse("a.ts", code)


def test_clients_fail_softly(spark):
    class Broken:
        def analyze(self, prompt):
            raise RuntimeError("no")

        enrich = analyze

    files, diffs = fixture.frames(spark)
    assert analyze(files, diffs, client=Broken())["summary"].first().score == 88
    tried = []
    assert enrich.FallbackClient([lambda p: tried.append(1) or "", lambda p: "x"]).analyze("p") == "x" and tried == [1]


def test_dedupe_is_idempotent_and_keeps_evidence_order(spark):
    rows = [RISK[:1] + (k, f"r{k}") + RISK[3:7] + (c,) + RISK[8:17] + (e,) + RISK[18:] for k, c, e in ((1, 0.5, ["a", "b"]), (2, 90.0, ["b", "c"]), (3, 0.9, ["d"]))]
    once = scoring.dedupe(spark.createDataFrame(rows, RISK_TYPE))
    assert [(r.id, r.evidence, r.risk_seq) for r in once.collect()] == [("r2", ["a", "b", "c", "d"], 1)]
    assert scoring.dedupe(once).collect() == once.collect()


def test_the_scanner_takes_time_in_proportion_to_the_file():
    from rippletrace.operators.ts_scan import parse

    calls = parse("a.ts", "function f() {\n" + "".join(f"  g{i}(x.y);\n" for i in range(30_000)) + "}\n")[1][0]["calls"]
    assert len(calls) == 30_000 and calls[-1] == {"name": "g29999", "line": 30_001}
    open_calls = parse("a.ts", "function f() {" + "a(" * 30_000)[1][0]["calls"]  # brackets that never close
    assert len(open_calls) == 30_000
