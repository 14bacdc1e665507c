"""DuckDB SQL with the rows of the registered queries, written independently of the operators."""

from __future__ import annotations

WS = r"[ \t\n\x0B\f\r]"

_KEYS = {
    "region": ("r_regionkey", "r_name", 0), "nation": ("n_nationkey", "n_name", 1), "customer": ("c_custkey", "c_name", 2),
    "supplier": ("s_suppkey", "s_name", 3), "part": ("p_partkey", "p_name", 4), "orders": ("o_orderkey", "'orders:' || o_orderkey", 5),
}
LN = "ln AS (" + " UNION ALL ".join(
    f"SELECT CAST({k} AS BIGINT) + {i} * 1099511627776 AS node_seq, '{t}:' || {k} AS id, {n} AS name, '{t}' AS type FROM {t}" for t, (k, n, i) in _KEYS.items()
) + " UNION ALL SELECT l_orderkey * 8 + l_linenumber + 6 * 1099511627776, 'lineitem:' || l_orderkey || '-' || l_linenumber, 'lineitem:' || l_orderkey || '-' || l_linenumber, 'lineitem' FROM lineitem)"
_ITEM = "'lineitem:' || l_orderkey || '-' || l_linenumber"
LE = f"""le AS (
SELECT CAST(n_nationkey AS BIGINT) AS edge_seq, 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target FROM nation
UNION ALL SELECT c_custkey + 1099511627776, 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT s_suppkey + 2 * 1099511627776, 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT o_orderkey + 3 * 1099511627776, 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders
UNION ALL SELECT l_orderkey * 8 + l_linenumber + 4 * 1099511627776, {_ITEM}, 'orders:' || l_orderkey FROM lineitem
UNION ALL SELECT l_orderkey * 8 + l_linenumber + 5 * 1099511627776, {_ITEM}, 'part:' || l_partkey FROM lineitem
UNION ALL SELECT l_orderkey * 8 + l_linenumber + 6 * 1099511627776, {_ITEM}, 'supplier:' || l_suppkey FROM lineitem)"""
REGIONS = "SELECT r_regionkey AS seed_seq, 'region:' || r_regionkey AS seed FROM region"


def _levels(seeds: str, edges: str = "le", depth: int = 4) -> str:
    """CTEs l0..ln and `bfs`: breadth-first levels with the discovery order of lists of edge numbers."""
    out = [f"l0 AS MATERIALIZED (SELECT seed_seq, seed, seed AS node_id, 0 AS depth, CAST([] AS BIGINT[]) AS k, seed AS path FROM ({seeds}))"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed_seq, node_id FROM l{j}" for j in range(i))
        out.append(
            f"l{i} AS MATERIALIZED (SELECT seed_seq, seed, node_id, {i} AS depth, k, path FROM (SELECT p.seed_seq, p.seed, e.source AS node_id, list_append(p.k, e.edge_seq) AS k, p.path || '>' || e.source AS path, "
            f"row_number() OVER (PARTITION BY p.seed_seq, e.source ORDER BY p.k, e.edge_seq) AS r FROM l{i - 1} p JOIN {edges} e ON e.target = p.node_id "
            f"WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.seed_seq = p.seed_seq AND s.node_id = e.source)) WHERE r = 1)"
        )
    out.append("bfs AS (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, depth + 1)) + ")")
    return ", ".join(out)


# Files made of pages.
_PAGES = """p AS (SELECT page_id, ['src', 'node_modules', 'distant', 'a/dist'][page_id % 4 + 1] AS folder, ['.ts', '.tsx', '.JS', '.jsx', '.prisma', '.css'][page_id % 6 + 1] AS ext, coalesce(html, '') AS content FROM pages),
f AS (SELECT *, folder || '/f' || page_id || ext AS path FROM p)"""
_LANGUAGE = "CASE ext WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'tsx' WHEN '.JS' THEN 'javascript' WHEN '.jsx' THEN 'jsx' WHEN '.prisma' THEN 'prisma' ELSE 'unknown' END"

# Lines of the diffs made of events: numbers by counting, without reading the text.
_DIFF = """ev AS (SELECT CAST(user_id AS VARCHAR) AS a, user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
h AS (SELECT *, 1 + sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS hunk,
      CASE event_type WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'added' WHEN 'signup' THEN 'hunk' ELSE 'context' END AS t FROM ev),
st AS (SELECT *, coalesce(max(CASE WHEN t = 'hunk' THEN event_id END) OVER (PARTITION BY user_id, hunk), 1) AS start FROM h),
c AS (SELECT *, start + count(*) FILTER (t IN ('removed', 'context')) OVER w AS old_no, start + count(*) FILTER (t IN ('added', 'context')) OVER w AS new_no
      FROM st WINDOW w AS (PARTITION BY user_id, hunk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_EVENT_TEXT = "CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'purchase' THEN 'v: ' || event_id % 7 ELSE 'v ' || event_id % 5 END"
_EVENT_CHANGES = f"""ec AS (SELECT CAST(user_id AS VARCHAR) AS analysis_id, CAST(row_number() OVER w AS INTEGER) AS change_seq, 'field:f' || event_id % 3 AS node_id, 'f' || event_id % 3 AS name,
  CASE event_type WHEN 'click' THEN 'function' WHEN 'view' THEN 'database_field' WHEN 'signup' THEN 'variable' ELSE 'type' END AS type, event_type || '.ts' AS file_path,
  lag({_EVENT_TEXT}) OVER w AS before, {_EVENT_TEXT} AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
cc AS (SELECT *, CASE WHEN coalesce(before, '') = '' AND after <> '' THEN 'added' WHEN coalesce(before, '') <> '' AND after = '' THEN 'deleted'
  WHEN coalesce(before, '') <> after AND (before LIKE '%:%' OR after LIKE '%:%') THEN 'type_changed' ELSE 'modified' END AS change_type FROM ec)"""

_TOUCH = """ln_ AS (SELECT event_id, 'f' || user_id % 100 || '.ts' AS path, user_id % 100 AS file_seq, event_id % 50 AS hunk_seq, CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'removed' ELSE 'context' END AS t,
  CAST(event_id * 13 % 1000 AS INTEGER) AS no, 'k' || event_id % 3 || ': T' || event_id % 4 || ';' AS text FROM events),
rg AS (SELECT p_partkey AS seq, 'S' || p_partkey AS name, ['interface', 'type', 'function', 'database_field', 'variable'][p_partkey % 5 + 1] AS kind, 'f' || p_partkey % 100 || '.ts' AS path,
  CAST(p_partkey * 37 % 900 AS INTEGER) AS lo, CAST(p_partkey * 37 % 900 AS INTEGER) + p_size AS hi FROM part)"""
_NORMAL = f"""{_TOUCH},
hit AS (SELECT file_seq, seq, kind, rg.path, rg.path || ':' || kind || ':' || name AS id, t, hunk_seq, event_id, text FROM ln_ JOIN rg ON ln_.path = rg.path AND no BETWEEN lo AND hi WHERE t <> 'context' AND kind IN ('function', 'variable')),
sides AS (SELECT file_seq, seq, kind, path, id, coalesce(string_agg('  ' || text, chr(10) ORDER BY hunk_seq, event_id) FILTER (t = 'removed'), '') AS b, coalesce(string_agg('  ' || text, chr(10) ORDER BY hunk_seq, event_id) FILTER (t = 'added'), '') AS a FROM hit GROUP BY ALL),
normal AS (SELECT file_seq, id AS node_id, kind, path, CASE WHEN b = '' THEN 'added' WHEN a = '' THEN 'deleted' WHEN a <> b THEN 'type_changed' ELSE 'modified' END AS change_type, nullif(b, '') AS before, nullif(a, '') AS after FROM sides)"""
_PAIRS = f"""{_TOUCH},
rem AS (SELECT *, 'k' || event_id % 3 AS prop FROM ln_ WHERE t = 'removed'),
ad AS (SELECT file_seq, hunk_seq, 'k' || event_id % 3 AS prop, arg_min(text, event_id) AS text FROM ln_ WHERE t = 'added' GROUP BY ALL),
pr AS (SELECT rem.*, ad.text AS new_text FROM rem JOIN ad ON rem.file_seq = ad.file_seq AND rem.hunk_seq = ad.hunk_seq AND rem.prop = ad.prop),
en AS (SELECT pr.*, rg.name AS parent, row_number() OVER (PARTITION BY pr.event_id ORDER BY hi - lo, seq) AS r FROM pr JOIN rg ON rg.path = pr.path AND no BETWEEN lo AND hi WHERE kind IN ('interface', 'type')),
paired AS (SELECT file_seq, hunk_seq, event_id, 'field:' || parent || '.' || prop AS node_id, path, CASE WHEN text <> new_text THEN 'type_changed' ELSE 'modified' END AS change_type, text AS before, new_text AS after FROM en WHERE r = 1)"""

_CHANGED = """pc AS (SELECT CAST(p_partkey AS INTEGER) AS change_seq, 'part:' || p_partkey AS node_id, p_name AS name, p_type AS before,
  CASE p_size % 4 WHEN 0 THEN p_type || '?' WHEN 2 THEN NULL ELSE p_type END AS after, CASE p_size % 4 WHEN 0 THEN 'type_changed' WHEN 2 THEN 'deleted' WHEN 1 THEN 'signature_changed' ELSE 'modified' END AS change_type FROM part),
ue AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS edge_seq, 'supplier:' || l_suppkey AS source, 'part:' || l_partkey AS target, l_linenumber % 4 AS kind, l_suppkey,
  CASE WHEN l_linenumber % 4 = 1 THEN ['trim', 'push', 'split'][l_orderkey % 3 + 1] END AS method, CASE WHEN l_linenumber % 4 = 2 THEN ['send', 'store'][l_orderkey % 2 + 1] END AS callee FROM lineitem),
j AS (SELECT pc.*, ue.*, s.s_name AS sup FROM pc JOIN ue ON ue.target = pc.node_id JOIN supplier s ON 'supplier:' || s.s_suppkey = ue.source)"""
_RULE = {
    "method": ("kind = 1 AND change_type = 'type_changed' AND method IN ('trim', 'split')", "'nullable-method-' || method", "'Null may be dereferenced in ' || sup", "runtime", "critical", 0.99, "name || '.' || method || '()'",
               "name || ' was required and is now nullable.' || '>' || sup || ' runs ' || name || '.' || method || '().' || '>' || method || '() fails on a null value.'", "'Test ' || name || ' for null before ' || method || '(), or handle its absence in ' || sup || '.'"),
    "argument": ("kind = 2 AND change_type = 'type_changed'", "'nullable-argument-' || callee", "callee || ' may receive a null value'", "type", "high", 0.94, "callee",
                 "name || ' was required and is now nullable.' || '>' || sup || ' has ' || callee || '(' || name || ').'", "'Test ' || name || ' before the call of ' || callee || ', or let ' || callee || ' accept null.'"),
    "access": ("kind = 3 AND change_type = 'type_changed'", "'nullable-property-access'", "sup || ' reads ' || name || ', now nullable'", "business_logic", "medium", 0.78, None,
               "name || ' was required and is now nullable.' || '>' || sup || ' refers to the field.'", "'Check what ' || sup || ' does when ' || name || ' is null.'"),
    "deleted": ("change_type = 'deleted'", "'deleted-symbol'", "sup || ' needs ' || name || ', now deleted'", "dependency", "critical", 0.99, None,
                "name || ' was deleted.' || '>' || sup || ' keeps a dependency on it.'", "'Take the dependency on ' || name || ' out of ' || sup || ', or replace it.'"),
    "signature": ("change_type = 'signature_changed' AND kind = 0", "'signature-change'", "sup || ' may call ' || name || ' by its old signature'", "api_breaking_change", "high", 0.94, None,
                  "'Before: ' || before || '>' || 'After: ' || after", "'Bring the call of ' || name || ' in ' || sup || ' in line with the new signature.'"),
}


def _rule(name: str) -> str:
    where, rule, title, category, severity, confidence, last, evidence, fix = _RULE[name]
    path = f"name || '>' || sup{f" || '>' || {last}" if last else ''}"
    return f"""SELECT change_seq, edge_seq, 'static:' || {rule} || ':' || node_id || ':' || source AS id, {title} AS title, '{category}' AS category, '{severity}' AS severity, CAST({confidence} AS DOUBLE) AS confidence,
{path} AS failure_path, {evidence} AS evidence, {fix} AS suggested_fix, 'supplier.tbl' AS file_path FROM j WHERE {where}"""


_CASCADE = " UNION ALL ".join(f"SELECT {k} AS rule_rank, r.*, j2.name, j2.sup FROM ({_rule(n)}) r JOIN j j2 USING (change_seq, edge_seq)" for n, k in (("method", 0), ("argument", 0), ("access", 0), ("deleted", 1), ("signature", 2)))

#: The changed nations that get a context.
_CONTEXTS = """k AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS context_seq, 'nation:' || n_nationkey AS node_id, n_nationkey % 3 = 0 AS deleted FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0) WHERE context_seq <= 8)"""

#: The risks of all rules, `f` by first place and `n` by strength in each group.
CASCADE_RISKS = f"""WITH {_CHANGED.replace("FROM part),", "FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_type, p_size % 4 IN (1, 3), p_size % 4 = 0 ORDER BY p_partkey) = 1),", 1)}, a AS ({_CASCADE}), r AS (SELECT *, min((change_seq, rule_rank, edge_seq)) OVER (PARTITION BY category, name, sup, title) AS f, row_number() OVER (PARTITION BY category, name, sup, title ORDER BY confidence DESC, change_seq, rule_rank, edge_seq) AS n FROM a)"""

_RISKS = """ir AS (SELECT o_orderpriority AS analysis_id, ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS risk_seq, l_orderkey || '-' || l_linenumber AS id, ' Risk of ' || l_returnflag || l_linestatus AS title,
  ['security', 'runtime', 'type', 'dependency', 'performance', 'other'][l_partkey % 6 + 1] AS category, ['critical', 'high', 'medium', 'low'][l_suppkey % 4 + 1] AS severity,
  CASE WHEN l_linenumber = 1 THEN l_discount * 1000 ELSE l_discount * 10 END AS confidence, ['static', 'ai', 'hybrid', 'manual'][l_linenumber % 4 + 1] AS source,
  CASE WHEN l_linenumber % 2 = 0 THEN 'part:' || l_partkey % 20 ELSE 'p' || l_partkey % 20 END AS changed, 'p' || l_partkey % 20 AS changed_symbol, 'supplier:' || l_suppkey % 10 AS affected,
  CASE WHEN l_linenumber < 7 THEN l_linenumber END AS depth, CASE WHEN l_linenumber > 1 THEN ['a', l_returnflag, l_linestatus] ELSE ['a'] END AS failure_path,
  [l_returnflag, 'q' || CAST(l_quantity AS INTEGER)] AS evidence, o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nr AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) AS n FROM ir),
sr AS (SELECT *, CAST(floor(greatest(0.0::DOUBLE, least(98.0::DOUBLE,
  CASE severity WHEN 'critical' THEN 100.0::DOUBLE WHEN 'high' THEN 80.0::DOUBLE WHEN 'medium' THEN 55.0::DOUBLE ELSE 30.0::DOUBLE END * n
  * CASE WHEN depth IS NULL OR depth <= 1 THEN 1.0::DOUBLE WHEN depth = 2 THEN 0.9::DOUBLE WHEN depth = 3 THEN 0.8::DOUBLE WHEN depth = 4 THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END
  * CASE category WHEN 'security' THEN 1.15::DOUBLE WHEN 'runtime' THEN 1.05::DOUBLE WHEN 'type' THEN 1.0::DOUBLE WHEN 'dependency' THEN 0.95::DOUBLE WHEN 'performance' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END
  * CASE source WHEN 'hybrid' THEN 1.08::DOUBLE WHEN 'static' THEN 1.05::DOUBLE WHEN 'ai' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)) + 0.5) AS INTEGER) AS score FROM nr),
g AS (SELECT *, row_number() OVER w AS r, min(risk_seq) OVER p AS first_seq, count(*) OVER p AS size, analysis_id || '|' || category || '|' || changed || '|' || affected || '|' || lower(trim(title)) AS fp FROM sr
  WINDOW p AS (PARTITION BY analysis_id, category, changed, affected, lower(trim(title))), w AS (PARTITION BY analysis_id, category, changed, affected, lower(trim(title)) ORDER BY n DESC, risk_seq)),
ue_ AS (SELECT fp, string_agg(e, '>' ORDER BY place) AS evidence FROM (SELECT fp, e, min(risk_seq * 2 + i) AS place FROM (SELECT fp, risk_seq, unnest(evidence) AS e, unnest([0, 1]) AS i FROM g) GROUP BY fp, e) GROUP BY fp),
dd AS (SELECT g.* REPLACE (first_seq AS risk_seq), CASE WHEN size > 1 THEN ue_.evidence ELSE array_to_string(g.evidence, '>') END AS ev FROM g JOIN ue_ USING (fp) WHERE r = 1),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY score DESC, confidence DESC, risk_seq) AS INTEGER) AS rank FROM dd)"""
_OVERALL = """w AS (SELECT analysis_id, count(*) AS risks, list_sum(list(CASE WHEN rank <= 5 THEN score * (1.0::DOUBLE / rank) ELSE 0.0::DOUBLE END ORDER BY rank)) / list_sum(list(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END ORDER BY rank)) AS base FROM rk GROUP BY analysis_id),
an AS (SELECT DISTINCT o_orderpriority AS analysis_id FROM orders UNION ALL SELECT 'none'),
ov AS (SELECT analysis_id, coalesce(risks, 0) AS risks, coalesce(CASE WHEN risks IS NOT NULL THEN CAST(floor(greatest(0.0::DOUBLE, least(98.0::DOUBLE, base + least(risks * 1.5::DOUBLE, 10.0::DOUBLE))) + 0.5) AS INTEGER) END, 0) AS score FROM an LEFT JOIN w USING (analysis_id))"""
_LABEL = "CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END"

_VIEW = f"""RECURSIVE {LN}, {LE},
ch AS (SELECT 'region:' || r_regionkey AS id FROM region), aff AS (SELECT id FROM ln WHERE type = 'nation'), chosen AS (SELECT id FROM ch UNION SELECT id FROM aff),
near AS (SELECT id FROM chosen UNION SELECT source FROM le JOIN chosen ON target = id UNION SELECT target FROM le JOIN chosen ON source = id),
shown AS (SELECT * FROM ln WHERE id IN (SELECT id FROM near) ORDER BY node_seq LIMIT 60),
reach AS (SELECT id, 0 AS depth FROM ch UNION SELECT le.source, reach.depth + 1 FROM reach JOIN le ON le.target = reach.id WHERE reach.depth < 6),
dp AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"""

# Symbols of the files made of nations, customers and suppliers, as their texts declare them; fields of a model are one line late by default.
_TREE = """sy AS (
SELECT 'src/n' || n_nationkey || '.ts' AS path, 'interface' AS type, 'N' || n_nationkey AS name, true AS exported, 1 AS lo, 3 AS hi FROM nation
UNION ALL SELECT 'src/n' || n_nationkey || '.ts', 'type', 'A' || n_nationkey, true, 4, 6 FROM nation
UNION ALL SELECT 'src/n' || n_nationkey || '.ts', 'function', 'g' || n_nationkey, true, 7, 9 FROM nation
UNION ALL SELECT 'src/c' || c_custkey || '.ts', 'function', 'f' || c_custkey, true, 2, 5 FROM customer
UNION ALL SELECT 'src/c' || c_custkey || '.ts', 'class', 'K' || c_custkey, false, 6, 10 FROM customer
UNION ALL SELECT 'db/s' || s_suppkey || '.prisma', 'database_model', 'M' || s_suppkey, true, 1, 4 FROM supplier
UNION ALL SELECT 'db/s' || s_suppkey || '.prisma', 'database_field', 'M' || s_suppkey || '.id', true, 3, 3 FROM supplier
UNION ALL SELECT 'db/s' || s_suppkey || '.prisma', 'database_field', 'M' || s_suppkey || '.note', true, 4, 4 FROM supplier),
d AS (SELECT path || ':' || type || ':' || name AS id, *, CASE WHEN type = 'database_field' THEN name LIKE '%.note' END AS nullable FROM sy),
fl AS (SELECT DISTINCT path, path || ':file:' || path AS id FROM sy),
ed AS (
SELECT fl.id AS source, d.id AS target, 'contains' AS type, NULL AS method, NULL AS field FROM d JOIN fl USING (path)
UNION ALL SELECT 'src/c' || c_custkey || '.ts:file:src/c' || c_custkey || '.ts', 'src/n' || c_nationkey || '.ts:file:src/n' || c_nationkey || '.ts', 'imports', NULL, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'src/c' || c_custkey || '.ts:function:f' || c_custkey, 'src/n' || n_nationkey || '.ts:function:g' || n_nationkey, 'calls', NULL, NULL FROM customer JOIN nation ON n_nationkey = c_custkey % 40
UNION ALL SELECT 'src/c' || c_custkey || '.ts:function:f' || c_custkey, 'field:N' || c_nationkey || '.label', 'uses_field', 'trim', 'N' || c_nationkey || '.label' FROM customer JOIN nation ON n_nationkey = c_nationkey)"""

_ANSWERED = """e AS (SELECT event_id, user_id, event_type, value, event_id % 4 AS m FROM events WHERE event_id % 4 IN (0, 3))"""
_CODE = """c AS (SELECT p_partkey AS symbol_seq, 'User' || p_size % 5 AS u, 'b' || p_size % 3 AS b, 'c' || p_size % 2 AS c FROM part)"""

ORACLE_SQL = {
    "scan_supported_files": f"WITH {_PAGES} SELECT path, CAST(octet_length(encode(content)) AS BIGINT) AS size, {_LANGUAGE} AS language FROM f WHERE folder IN ('src', 'distant') AND ext NOT IN ('.JS', '.css')",
    "ignored_dirs": f"WITH {_PAGES} SELECT path, folder IN ('node_modules', 'a/dist') AS ignored, ext NOT IN ('.JS', '.css') AS supported FROM f",
    "detect_language": f"WITH {_PAGES} SELECT {_LANGUAGE} AS language, count(*) AS n FROM f GROUP BY 1",
    "repo_locator": """WITH i AS (SELECT DISTINCT input FROM (SELECT url AS input FROM pages UNION ALL SELECT lang || '/' || source || '.git' FROM documents)),
p AS (SELECT input, list_filter(string_split(regexp_replace(input, '\\.git$', ''), '/'), lambda x: x <> '') AS parts FROM i),
o AS (SELECT input, parts[-2] AS owner, parts[-1] AS repo FROM p)
SELECT input, owner, repo, CASE WHEN input LIKE 'http%' THEN input ELSE 'https://github.com/' || owner || '/' || repo || '.git' END AS address, regexp_replace(owner || '_' || repo, '[^a-zA-Z0-9_-]', '_', 'g') AS folder FROM o""",
    "diff_source": "SELECT event_id, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' ELSE props END AS diff FROM events",
    "request_defaults": """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 400 ELSE 200 END AS status, CASE WHEN event_id % 4 < 2 THEN 'main' ELSE 'dev' END AS base, CASE WHEN event_id % 5 < 2 THEN 'HEAD' ELSE 'topic' END AS head,
CASE WHEN event_id % 3 < 2 OR event_id % 5 < 2 THEN 400 ELSE 200 END AS page_status FROM events""",
    "checkout_ref": """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS analysis_id, 'r' || c_custkey % 11 AS ref, CASE WHEN c_custkey % 2 = 0 THEN 'origin/r' || c_custkey % 7 ELSE 'r' || c_custkey % 5 END AS name FROM customer),
n AS (SELECT analysis_id, ref, list(name) AS names FROM c GROUP BY ALL)
SELECT analysis_id, ref, CASE WHEN list_contains(names, 'origin/' || ref) THEN 'origin/' || ref WHEN list_contains(names, ref) THEN ref END AS checkout FROM n""",
    "union_sources": "SELECT 'documents' AS origin, doc_id AS id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents UNION ALL SELECT 'pages', page_id, CAST(octet_length(encode(html)) AS BIGINT) FROM pages",
    "distinct_ids": "SELECT user_id AS id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'error'",
    "diff_lines": f"""WITH {_DIFF} SELECT a AS analysis_id, CAST(hunk AS INTEGER) AS hunk_seq, CAST(i + CASE WHEN user_id % 3 = 0 THEN 4 ELSE 3 END AS INTEGER) AS pos, t AS type, CASE t WHEN 'removed' THEN 'e' WHEN 'added' THEN 'p' ELSE 'c' END || event_id AS content,
CAST(CASE WHEN t <> 'added' THEN old_no - (CASE WHEN hunk > 1 THEN 0 ELSE 0 END) END AS INTEGER) AS old_line, CAST(CASE WHEN t <> 'removed' THEN new_no END AS INTEGER) AS new_line,
CAST(start AS INTEGER) AS old_start, CASE WHEN hunk = 1 THEN 3 ELSE 1 END AS old_count, CAST(start AS INTEGER) AS new_start, CASE WHEN hunk = 1 THEN 1 ELSE 2 END AS new_count, CASE WHEN user_id % 3 = 0 THEN 'added' ELSE 'modified' END AS status FROM c WHERE t <> 'hunk'""",
    "diff_files": "SELECT CAST(user_id AS VARCHAR) AS analysis_id, 1 AS file_seq, 'u' || user_id || '.ts' AS old_path, 'u' || user_id || '.ts' AS new_path, CASE WHEN user_id % 3 = 0 THEN 'added' ELSE 'modified' END AS status FROM (SELECT DISTINCT user_id FROM events)",
    "diff_line_class": """WITH t AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'hunk' WHEN 'error' THEN 'removed' WHEN 'purchase' THEN 'added' ELSE 'plain' END AS class, 1 AS n FROM events
UNION ALL SELECT user_id, 'hunk', 1 FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 'plain', CASE WHEN user_id % 3 = 0 THEN 4 ELSE 3 END FROM (SELECT DISTINCT user_id FROM events))
SELECT CAST(user_id AS VARCHAR) AS analysis_id, class, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL""",
    "prisma_models": """WITH t AS (SELECT n_nationkey AS k, 'model N' || n_nationkey || ' {' || chr(10) || '  id Int @id' || chr(10) || chr(10) || '  name String?' || chr(10) || '  // note' || chr(10) || '  @@index([id])' || chr(10) || '  r ' || n_name || '[] @x @y' || chr(10) || '}' AS code FROM nation)
SELECT 'n' || k || '.prisma:database_model:N' || k AS id, 'N' || k AS name, k % 3 + 1 AS start_line, k % 3 + 8 AS end_line, 'model N' || k AS signature, code FROM t""",
    "prisma_fields": """WITH f AS (SELECT n_nationkey AS k, * FROM nation, (VALUES ('id', 'Int', '@id', 1), ('name', 'String?', '', 3), ('r', '', '@x @y', 6)) v(field, t, attributes, i)),
g AS (SELECT k, field, CASE WHEN field = 'r' THEN n_name || '[]' ELSE t END AS t, attributes, i FROM f WHERE field <> 'r' OR n_name NOT LIKE '% %')
SELECT 'n' || k || '.prisma:database_field:N' || k || '.' || field AS id, k % 3 + 1 + i + 1 AS start_line, field || ' ' || t AS signature, trim(field || ' ' || t || ' ' || attributes) AS code, t AS field_type, t LIKE '%?' AS nullable, attributes FROM g
UNION ALL SELECT 'n' || n_nationkey || '.prisma:database_field:N' || n_nationkey || '.r', n_nationkey % 3 + 8, 'r ' || split_part(n_name, ' ', 1), 'r ' || n_name || '[] @x @y', split_part(n_name, ' ', 1), false, trim(substr(n_name, strpos(n_name, ' '))) || '[] @x @y' FROM nation WHERE n_name LIKE '% %'""",
    "typed_vars": f"WITH {_CODE} SELECT symbol_seq, pos, var, CASE var WHEN 'u' THEN u ELSE 'Order' END AS type FROM c, (VALUES (0, 'u'), (1, 'o')) v(pos, var)",
    "field_usages": f"""WITH {_CODE}, x AS (
SELECT symbol_seq, 0 AS pos, u || '.a' AS field, 'method_call' AS kind, 'trim' AS method, NULL AS callee, 'u.a.trim()' AS expression FROM c
UNION ALL SELECT symbol_seq, 1, 'Order.y', 'method_call', 'z', NULL, 'o.y.z()' FROM c
UNION ALL SELECT symbol_seq, 2, u || '.a', 'argument', NULL, 'if', 'if(u.a)' FROM c
UNION ALL SELECT symbol_seq, 3, u || '.' || b, 'argument', NULL, 'send', 'send(u.' || b || ')' FROM c
UNION ALL SELECT symbol_seq, 4, 'Order.x', 'argument', NULL, 'send', 'send(o.x)' FROM c
UNION ALL SELECT symbol_seq, 5, u || '.' || c, 'property_access', NULL, NULL, 'u.' || c FROM c)
SELECT symbol_seq, pos, field, kind, method, callee, expression FROM x""",
    "interface_fields": """WITH v AS (SELECT * FROM nation, (VALUES (0), (1), (2)) t(pos) WHERE n_nationkey % 3 <> 0)
SELECT 'T' || n_nationkey AS name, pos, 'T' || n_nationkey || '.' || CASE pos WHEN 0 THEN 'id' || n_nationkey WHEN 1 THEN lower(n_name) ELSE 'nested' END AS field FROM v WHERE pos <> 1 OR regexp_full_match(lower(n_name), '[a-z_$][a-z0-9_$]*')""",
    "call_extract": """WITH s AS (SELECT page_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(coalesce(html, ''), '<script>(.*?)</script>', 1), ' '), 'track[(]')) AS x FROM pages)
SELECT 'f' || page_id || '.js:function:run' AS id, 'function' AS type, true AS exported, 'run = ()' AS signature, 'track' AS call, 1 AS line FROM s""",
    "call_resolution": """WITH n AS (SELECT 'f' || c_nationkey AS name, min(c_custkey) AS k FROM customer GROUP BY 1),
c AS (SELECT c_custkey, 0 AS call_seq, 3 AS line, 'f' || c_custkey % 60 AS name FROM customer UNION ALL SELECT c_custkey, 2, 5, 'f' || c_custkey % 25 FROM customer)
SELECT 'customer:' || c_custkey AS source, call_seq, line, 'customer:' || k AS target FROM c JOIN n USING (name)""",
    "import_resolution": """SELECT 'src/a/c' || c_custkey || '.ts' AS file_path, CASE c_nationkey % 3 WHEN 0 THEN 'src/n' || c_nationkey || '.ts' ELSE 'src/n' || c_nationkey || '/index.tsx' END AS target_path
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 < 2 AND c_nationkey % 3 < 2 OR c_custkey % 4 = 3 AND c_nationkey % 3 = 0""",
    "ts_property_lines": "SELECT event_id, event_type AS name, CASE WHEN event_id % 3 = 0 THEN '?' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'string | null' END AS type FROM events",
    "graph_nodes": f"WITH {LN} SELECT type, count(*) AS n, min(node_seq) AS first, max(node_seq) AS last FROM ln GROUP BY type",
    "graph_edges": f"WITH {LE} SELECT target, count(*) AS n, min(edge_seq) AS first FROM le GROUP BY target",
    "tree_declarations": f"WITH {_TREE} SELECT id, name, type, exported, lo AS start_line, hi AS end_line FROM d",
    "route_declarations": """WITH f AS (SELECT c_custkey % 3 < 2 AS routed, CASE c_custkey % 3 WHEN 0 THEN 'app/api/c' || c_custkey || '/route.ts' WHEN 1 THEN 'src/api/c' || c_custkey || '.ts' ELSE 'lib/c' || c_custkey || '.ts' END AS path FROM customer),
r AS (SELECT path, unnest([{'n': 'GET', 't': CASE WHEN routed THEN 'api_route' ELSE 'function' END, 'e': true, 'l': 1}, {'n': 'POST', 't': CASE WHEN routed THEN 'api_route' ELSE 'function' END, 'e': true, 'l': 4}, {'n': 'PUT', 't': 'function', 'e': false, 'l': 7}, {'n': 'helper', 't': 'function', 'e': true, 'l': 10}]) AS s FROM f)
SELECT path || ':' || s.t || ':' || s.n AS id, s.n AS name, s.t AS type, s.e AS exported, s.l AS start_line FROM r""",
    "tree_references": f"""WITH {_TREE} SELECT id, unnest(['label', 'trim']) AS reference, 4 AS line FROM d WHERE type = 'function' AND path LIKE 'src/c%'
UNION ALL SELECT id, split_part(name, '.', 1), lo FROM d WHERE type = 'database_field'""",
    "tree_nodes": f"""WITH {_TREE} SELECT id, name, type, path AS file_path, lo AS start_line, NULL AS parent_type, nullable FROM d UNION ALL SELECT id, path, 'file', path, NULL, NULL, NULL FROM fl
UNION ALL SELECT 'field:' || name, name, type, path, NULL, NULL, nullable FROM d WHERE type = 'database_field'
UNION ALL SELECT 'field:' || f.name, f.name, 'type', path, NULL, d.name, NULL FROM d, LATERAL (SELECT d.name || CASE d.type WHEN 'type' THEN '.size' ELSE '.label' END AS name) f WHERE type IN ('interface', 'type')""",
    "tree_edges": f"WITH {_TREE} SELECT source || '->' || target || ':' || type || CASE WHEN type = 'uses_field' THEN ':method_call:trim' ELSE '' END AS id, source, target, type, method, field FROM ed",
    "edge_dedupe": "SELECT min(event_id) AS edge_seq, 'u' || user_id % 20 || '->u' || event_id % 20 || ':' || event_type AS id FROM events WHERE user_id % 20 <> event_id % 20 GROUP BY 2",
    "bfs_dependents": f"WITH {LE}, {_levels(REGIONS)} SELECT seed, node_id, depth, path FROM bfs",
    "blast_radius": f"""WITH {LE}, {_levels(REGIONS)}
SELECT seed, count(node_id) AS total_affected, coalesce(arg_min(node_id, (depth, k)), '') AS first, coalesce(arg_max(node_id, (depth, k)), '') AS last FROM ({REGIONS}) LEFT JOIN (SELECT seed_seq, node_id, depth, k FROM bfs) USING (seed_seq) GROUP BY seed""",
    "combined_blast": f"""WITH {LE}, {_levels("SELECT CAST(c_custkey AS INTEGER) AS seed_seq, 'customer:' || c_custkey AS seed FROM customer UNION ALL SELECT 100000000 - n_nationkey, 'nation:' || n_nationkey FROM nation")},
f AS (SELECT node_id, arg_min((depth, seed, path), (depth, seed_seq)) AS w, min((seed_seq, depth, k)) AS first FROM bfs GROUP BY node_id),
g AS (SELECT node_id, w[1] AS depth, w[2] AS seed, w[3] AS path, first FROM f)
SELECT CAST(row_number() OVER (ORDER BY depth, first) AS INTEGER) AS out_seq, node_id, depth, seed, path FROM g""",
    "direct_dependents": "SELECT 'part:' || l_partkey AS target, 'supplier:' || l_suppkey AS id, s_name AS name, count(*) AS edges FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL",
    "induced_subgraph": f"WITH {LN}, {LE}, {_levels("SELECT 0 AS seed_seq, 'region:0' AS seed")}, chosen AS (SELECT DISTINCT node_id FROM bfs UNION ALL SELECT 'region:0') SELECT edge_seq, source, target FROM le WHERE source IN (SELECT node_id FROM chosen) AND target IN (SELECT node_id FROM chosen)",
    "node_lookup": "SELECT DISTINCT 'customer:' || c_custkey AS id, c_name AS name, 'customer' AS type FROM events JOIN customer ON c_custkey = user_id",
    "symbol_lookup": "SELECT 'f' || c_nationkey AS name, 'customer:' || min(c_custkey) AS first, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY c_nationkey",
    "line_range_join": f"WITH {_TOUCH} SELECT CAST(event_id AS INTEGER) AS pos, rg.path || ':' || kind || ':' || name AS id, no, t AS line_type FROM ln_ JOIN rg ON ln_.path = rg.path AND no BETWEEN lo AND hi WHERE t <> 'context'",
    "enclosing_type": f"WITH {_TOUCH}, x AS (SELECT event_id, name, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, seq) AS r FROM ln_ JOIN rg ON ln_.path = rg.path AND no BETWEEN lo AND hi WHERE kind IN ('interface', 'type')) SELECT CAST(event_id AS INTEGER) AS pos, name AS parent FROM x WHERE r = 1",
    "property_pairing": f"WITH {_PAIRS} SELECT CAST(hunk_seq AS BIGINT) AS a, CAST(event_id AS INTEGER) AS b, node_id, path AS file_path, change_type, before, after FROM paired",
    "symbol_changes": f"WITH {_NORMAL} SELECT CAST(file_seq AS INTEGER) AS file_seq, node_id, change_type, before, after FROM normal",
    "changes_detected": f"""WITH {_NORMAL}, {_PAIRS.split(_TOUCH + ",")[1]}, every AS (SELECT 'type' AS type, node_id, path, change_type, before, after FROM paired UNION ALL SELECT kind, node_id, path, change_type, before, after FROM normal),
one AS (SELECT type, change_type FROM every GROUP BY type, change_type, node_id, path, coalesce(before, ''), coalesce(after, '')) SELECT type, change_type, count(*) AS n FROM one GROUP BY ALL""",
    "change_classify": f"WITH {_EVENT_CHANGES} SELECT analysis_id, change_seq, change_type FROM cc",
    "prisma_changes": f"""WITH {_TOUCH}, hit AS (SELECT file_seq, seq, replace(rg.path, '.ts', '.prisma') AS path, 'field:' || name || '.k' || seq % 3 AS node_id, t, hunk_seq, event_id, text
  FROM ln_ JOIN rg ON ln_.path = rg.path AND no BETWEEN lo AND hi WHERE t <> 'context' AND kind = 'database_field' AND event_id % 3 = seq % 3),
sides AS (SELECT file_seq, seq, path, node_id, string_agg(text, chr(10) ORDER BY hunk_seq, event_id) FILTER (t = 'removed') AS b, string_agg(text, chr(10) ORDER BY hunk_seq, event_id) FILTER (t = 'added') AS a FROM hit GROUP BY ALL)
SELECT CAST(file_seq AS INTEGER) AS file_seq, node_id, path AS file_path, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'deleted' WHEN a <> b THEN 'type_changed' ELSE 'modified' END AS change_type, b AS before, a AS after FROM sides""",
    "id_lists": """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS analysis_id, string_agg('c' || c_custkey, '>' ORDER BY c_custkey) AS changed_ids FROM customer GROUP BY 1),
a AS (SELECT CAST(s_nationkey + 1 AS VARCHAR) AS analysis_id, string_agg('s' || s_suppkey, '>' ORDER BY s_suppkey DESC) AS affected_ids FROM supplier GROUP BY 1)
SELECT analysis_id, changed_ids, affected_ids FROM c FULL JOIN a USING (analysis_id)""",
    "change_dedupe": f"WITH {_EVENT_CHANGES} SELECT analysis_id, min(change_seq) AS change_seq, node_id FROM ec GROUP BY analysis_id, node_id, file_path, coalesce(before, ''), coalesce(after, '')",
    "semantic_dedupe": f"""WITH {_EVENT_CHANGES}, r AS (SELECT *, min(change_seq) OVER p AS first_seq, row_number() OVER (PARTITION BY analysis_id, name, coalesce(before, ''), coalesce(after, '') ORDER BY CASE type WHEN 'database_field' THEN 0 ELSE 1 END, change_seq) AS r
FROM ec WINDOW p AS (PARTITION BY analysis_id, name, coalesce(before, ''), coalesce(after, ''))) SELECT analysis_id, first_seq AS change_seq, name, type, file_path FROM r WHERE r = 1""",
    "high_impact": f"WITH {_EVENT_CHANGES} SELECT analysis_id, change_seq, change_type FROM cc WHERE change_type IN ('deleted', 'type_changed')",
    "filter_by_type": f"WITH {_EVENT_CHANGES} SELECT analysis_id, change_seq, type FROM ec WHERE type IN ('function', 'variable')",
    "nullable_transition": "SELECT 'part:' || p_partkey AS node_id, p_size % 4 = 0 AS became_nullable FROM part",
    **{f"rule_{n}": f"WITH {_CHANGED} {_rule(n)}" for n in _RULE},
    "line_diffs": """WITH d AS (SELECT doc_id, doc_id % 13 AS kind, 'd' || doc_id AS analysis_id, coalesce(text, '') AS content, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT *, array_to_string(flatten(list_transform(range(0, len(lines)), lambda i: list_concat(CASE WHEN (i + doc_id) % 7 = 3 THEN CAST([] AS VARCHAR[]) WHEN (i + doc_id) % 5 = 2 THEN [lines[CAST(i + 1 AS BIGINT)] || '!'] ELSE [lines[CAST(i + 1 AS BIGINT)]] END,
       CASE WHEN (i + doc_id) % 11 = 4 THEN ['new ' || i] ELSE CAST([] AS VARCHAR[]) END))), chr(10)) AS edited FROM d),
s AS (SELECT analysis_id, kind, doc_id, CASE WHEN kind <> 6 THEN content END AS base, CASE WHEN kind = 7 THEN content WHEN kind <> 5 THEN edited END AS head FROM e),
w AS (SELECT doc_id, side, line, count(*) AS n FROM (SELECT doc_id, 'b' AS side, unnest(string_split(regexp_replace(base, '\n$', ''), chr(10))) AS line FROM s WHERE kind = 8
      UNION ALL SELECT doc_id, 'h', unnest(string_split(regexp_replace(head, '\n$', ''), chr(10))) FROM s WHERE kind = 8) GROUP BY ALL),
m AS (SELECT doc_id, sum(least(a.n, b.n) * (length(line) + 1)) AS shared FROM (SELECT * FROM w WHERE side = 'b') a JOIN (SELECT * FROM w WHERE side = 'h') b USING (doc_id, line) GROUP BY doc_id),
r AS (SELECT s.*, CASE WHEN base = '' OR head = '' THEN NULL WHEN base = head THEN 100 WHEN kind = 8 AND floor(100 * shared / greatest(length(base), length(head))) >= 50 THEN CAST(least(100, floor(100 * shared / greatest(length(base), length(head)))) AS INTEGER) END AS sim FROM s LEFT JOIN m USING (doc_id)),
f AS (SELECT analysis_id, 't/' || doc_id || '.txt' AS old_path, CASE WHEN kind IN (7, 8) AND sim IS NOT NULL THEN 'moved/' ELSE 't/' END || doc_id || '.txt' AS new_path,
        CASE WHEN kind = 5 THEN 'deleted' WHEN kind = 6 THEN 'added' WHEN kind IN (7, 8) AND sim IS NOT NULL THEN 'renamed' WHEN kind IN (7, 8) THEN 'split' ELSE 'modified' END AS status, CASE WHEN kind IN (7, 8) THEN sim END AS similarity, base, head, doc_id FROM r WHERE kind IN (5, 6, 7, 8) OR base <> head),
g AS (SELECT analysis_id, old_path, new_path, status, similarity, base, head FROM f WHERE status <> 'split'
      UNION ALL SELECT analysis_id, old_path, old_path, 'deleted', NULL, base, NULL FROM f WHERE status = 'split'
      UNION ALL SELECT analysis_id, 'moved/' || doc_id || '.txt', 'moved/' || doc_id || '.txt', 'added', NULL, NULL, head FROM f WHERE status = 'split'),
k AS (SELECT *, coalesce(length(head) - length(replace(head, chr(10), '')) + CAST(head <> '' AND NOT ends_with(head, chr(10)) AS INTEGER), 0) AS lh, coalesce(length(base) - length(replace(base, chr(10), '')) + CAST(base <> '' AND NOT ends_with(base, chr(10)) AS INTEGER), 0) AS lb FROM g)
SELECT analysis_id, old_path, new_path, status, similarity, CAST(lh - lb AS BIGINT) AS net, sha256(head) AS patched_sha256 FROM k""",
    "merge_bases": """WITH RECURSIVE o AS (SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 3 AS m, CAST(lag(o_orderkey, 1) OVER w AS VARCHAR) AS p1, CAST(lag(o_orderkey, 2) OVER w AS VARCHAR) AS p2, CAST(lag(o_orderkey, 3) OVER w AS VARCHAR) AS p3,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS age FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l AS (SELECT c, id, CASE WHEN m = 1 THEN p2 ELSE p1 END AS up FROM o UNION ALL SELECT c, id, p3 FROM o WHERE m = 0),
q AS (SELECT c, min_by(id, age) AS base, max_by(id, age) AS head FROM o WHERE age <= 2 GROUP BY c),
a AS (SELECT c, 1 AS side, base AS id FROM q UNION SELECT c, 2, head FROM q UNION SELECT a.c, a.side, l.up FROM a JOIN l ON l.c = a.c AND l.id = a.id WHERE l.up IS NOT NULL),
b AS (SELECT c, id FROM a GROUP BY c, id HAVING count(*) = 2)
SELECT q.c AS analysis_id, base, head, b.id AS merge_base FROM q JOIN b USING (c) WHERE NOT EXISTS (SELECT 1 FROM b x JOIN l ON l.c = x.c AND l.id = x.id WHERE x.c = b.c AND l.up = b.id)""",
    "rule_cascade": f"""{CASCADE_RISKS}
SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS risk_seq, id, severity FROM r WHERE n = 1""",
    "rule_dedupe": f"""WITH {_RISKS}, r AS (SELECT analysis_id, risk_seq, min(risk_seq) OVER (PARTITION BY analysis_id, category, changed_symbol, title) AS first_seq, row_number() OVER (PARTITION BY analysis_id, category, changed_symbol, title ORDER BY confidence DESC, risk_seq) AS n FROM ir)
SELECT analysis_id, risk_seq, first_seq FROM r WHERE n = 1""",
    "risk_dedupe": f"WITH {_RISKS} SELECT analysis_id, risk_seq, id, confidence, ev AS evidence FROM dd",
    "score_risk": f"WITH {_RISKS} SELECT risk_seq, score FROM sr",
    "rank_risks": f"WITH {_RISKS} SELECT analysis_id, rank, risk_seq, score FROM rk",
    "blast_score": f"WITH {_RISKS}, {_OVERALL} SELECT analysis_id, risks, score FROM ov",
    "score_label": f"WITH {_RISKS} SELECT upper({_LABEL}) AS label, {_LABEL} AS severity, count(*) AS n FROM rk GROUP BY ALL",
    "summary_counts": f"""WITH {_RISKS}, {_OVERALL}, o AS (SELECT o_orderpriority AS analysis_id, count(*) AS changed FROM orders GROUP BY 1), i AS (SELECT analysis_id, count(*) AS affected FROM ir GROUP BY 1),
c AS (SELECT analysis_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM rk GROUP BY 1)
SELECT analysis_id, coalesce(changed, 0) AS changed, coalesce(affected, 0) AS affected, risks, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, score, upper({_LABEL}) AS label FROM ov LEFT JOIN o USING (analysis_id) LEFT JOIN i USING (analysis_id) LEFT JOIN c USING (analysis_id)""",
    "sanitize_confidence": """WITH v AS (SELECT event_id, value / 50 - 0.2::DOUBLE AS c, value / 3 AS m FROM events)
SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 0.5::DOUBLE WHEN c > 1 THEN least(c / 100, 1.0::DOUBLE) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) END AS confidence, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN m > 1 THEN m / 100 ELSE m END)) AS normalized FROM v""",
    "validate_enums": """WITH p AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS word, p_brand FROM part UNION SELECT 'high', 'type' UNION SELECT 'critical', 'security')
SELECT word, p_brand, CASE WHEN word IN ('critical', 'high', 'medium', 'low') THEN word ELSE 'medium' END AS severity, CASE WHEN p_brand IN ('type', 'security') THEN p_brand ELSE 'unknown' END AS category FROM p""",
    "affected_context": f"""WITH {LE}, {_CONTEXTS},
a AS (SELECT target AS node_id, source AS id, 1 AS depth, [edge_seq] AS way FROM le WHERE starts_with(target, 'nation:') UNION ALL SELECT x.target, e.source, 2, [x.edge_seq, e.edge_seq] FROM le x JOIN le e ON e.target = x.source WHERE starts_with(x.target, 'nation:')),
d AS (SELECT context_seq, k.node_id, id, depth, row_number() OVER (PARTITION BY context_seq ORDER BY depth, way) AS r FROM k JOIN a USING (node_id)),
t AS (SELECT context_seq, string_agg(id || '=' || depth || '=' || node_id, '>' ORDER BY r) AS components FROM d WHERE r <= 10 GROUP BY context_seq),
i AS (SELECT context_seq, id FROM d WHERE r <= 10 UNION SELECT context_seq, node_id FROM k),
g AS (SELECT x.context_seq, count(*) AS edges FROM le JOIN i x ON x.id = source JOIN i y ON y.id = target AND y.context_seq = x.context_seq GROUP BY x.context_seq)
SELECT CAST(context_seq AS INTEGER) AS context_seq, node_id, components, CAST(edges AS INTEGER) AS edges FROM k LEFT JOIN t USING (context_seq) LEFT JOIN g USING (context_seq) WHERE components IS NOT NULL OR deleted""",
    "model_risks": f"""WITH {LE}, {_CONTEXTS}, n AS (SELECT context_seq, k.node_id, CAST(split_part(k.node_id, ':', 2) AS INTEGER) AS nation, least(count(source), 10) AS parts, deleted FROM k LEFT JOIN le ON le.target = k.node_id GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY context_seq) AS INTEGER) AS risk_seq, 'ai:' || node_id || ':' || parts || ' parts' AS id, 'On ' || nation AS title, 'why' AS description, 'high' AS severity, 0.5::DOUBLE AS confidence, 'ai' AS source FROM n WHERE nation % 4 >= 2 AND (parts > 0 OR deleted)""",
    "llm_context": f"""WITH {LE}, c AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS context_seq, 'nation:' || n_nationkey AS node_id, n_nationkey % 3 = 0 AS deleted FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0),
k AS (SELECT * FROM c WHERE context_seq <= 8),
d AS (SELECT context_seq, node_id, e.source, row_number() OVER (PARTITION BY context_seq ORDER BY edge_seq) AS r FROM k JOIN le e ON e.target = k.node_id),
t AS (SELECT context_seq, string_agg(d.source || '=' || coalesce(s_name, '-'), '>' ORDER BY r) AS components, count(DISTINCT d.source) AS edges FROM d LEFT JOIN supplier ON 'supplier:' || s_suppkey = d.source WHERE r <= 10 GROUP BY context_seq)
SELECT CAST(context_seq AS INTEGER) AS context_seq, node_id, components, CAST(edges AS INTEGER) AS edges FROM k LEFT JOIN t USING (context_seq) WHERE components IS NOT NULL OR deleted""",
    "llm_parse": "SELECT event_id AS context_seq, CASE WHEN event_id % 4 IN (0, 3) THEN 2 ELSE 0 END AS risks FROM events",
    "llm_to_risk": f"""WITH {_ANSWERED} SELECT event_id AS context_seq, 0 AS index, 'ai:c' || user_id || ':s' AS id, 'T' || event_id AS title, 'why' AS description, 'security' AS category, 'medium' AS severity,
round(CASE WHEN value > 1 THEN least(value / 100, 1.0::DOUBLE) ELSE greatest(0.0::DOUBLE, value) END, 9) AS confidence, NULL AS affected_node_id, 's' AS affected_symbol, 'f.ts' AS file_path, 'why' AS reason FROM e
UNION ALL SELECT event_id, 1, 'ai:c' || user_id || ':n', 'U', 'd', 'unknown', 'low', 0.25::DOUBLE, 'n', NULL, 'f.ts', NULL FROM e""",
    "enrich_join": f"""WITH {_RISKS} SELECT id, CASE WHEN l_linenumber = 1 THEN (SELECT o_orderstatus FROM orders o WHERE o.o_orderkey = ir.o_orderkey) ELSE 'd' END AS description,
CASE WHEN l_linenumber = 1 AND o_orderkey % 2 = 1 THEN 'fix' END AS suggested_fix, CASE WHEN l_linenumber = 1 AND o_orderkey % 5 = 0 THEN 'low' ELSE severity END AS severity,
round(CASE WHEN l_linenumber = 1 AND o_orderkey % 7 <> 0 THEN 0.5::DOUBLE ELSE confidence END, 9) AS confidence, CASE WHEN l_linenumber = 1 THEN 'ai' ELSE source END AS source FROM ir""",
    "risk_card": f"""WITH {_RISKS} SELECT analysis_id, rank, category, severity, score, CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS percent, CASE source WHEN 'static' THEN 'Static' WHEN 'ai' THEN 'AI' ELSE 'Hybrid' END AS source_label,
array_to_string(string_split(ev, '>')[1:4], '>') AS evidence FROM rk""",
    "playback_schedule": f"""WITH {_RISKS}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY rank) AS INTEGER) AS q FROM rk WHERE len(failure_path) >= 2),
b AS (SELECT *, coalesce(sum(len(failure_path) * 850 + 700) OVER (PARTITION BY analysis_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM k)
SELECT analysis_id, q AS playback_seq, CAST(step AS INTEGER) AS step, failure_path[step + 1] AS name, CAST(begins + step * 850 AS BIGINT) AS at_ms, step = len(failure_path) - 1 AS is_last FROM b, UNNEST(range(0, len(failure_path))) AS u(step)""",
    "graph_view_depth": f"WITH {_VIEW} SELECT id, depth FROM dp",
    "graph_view_layout": f"""WITH {_VIEW}, x AS (SELECT shown.id, name, node_seq, coalesce(dp.depth, 5) AS depth FROM shown LEFT JOIN dp ON dp.id = shown.id)
SELECT id, name, depth, depth * 280 AS x, CAST((row_number() OVER (PARTITION BY depth ORDER BY node_seq) - 1) * 110 AS INTEGER) AS y, CASE WHEN id IN (SELECT id FROM ch) THEN 'changed' WHEN id IN (SELECT id FROM aff) THEN 'affected' ELSE 'other' END AS node_class FROM x""",
    "graph_view_joined": f"""WITH RECURSIVE {LE}, b AS MATERIALIZED (SELECT source AS u, target AS v, edge_seq AS e FROM le UNION ALL SELECT target, source, edge_seq FROM le),
j(id, t) USING KEY (id) AS (SELECT 'part:' || p_partkey, CAST(-1 AS BIGINT) FROM part WHERE p_size = 7
  UNION ALL (SELECT b.v, min(b.e) FROM j JOIN b ON b.u = j.id AND b.e > j.t LEFT JOIN recurring.j k ON k.id = b.v GROUP BY b.v, k.t HAVING k.t IS NULL OR min(b.e) < k.t))
SELECT id, CASE WHEN t >= 0 THEN t END AS joined FROM j""",
    "graph_view_edges": f"WITH {_VIEW} SELECT source || '->' || target || ':depends_on' AS id, target AS source, source AS target, target IN (SELECT id FROM ch) AS animated FROM le WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)",
}
ORACLE_SQL["diff_long_lines"] = ORACLE_SQL["diff_lines"]
