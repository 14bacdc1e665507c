"""The golden repository and diff: six files, one field that becomes nullable."""

FILES = {
    "app/api/users/route.ts": 'import { sendWelcome } from "../../../src/mailer";\n\nexport async function POST(request: Request) {\n  return sendWelcome(await request.json());\n}\n',
    "src/billing.ts": 'import { User } from "./types";\n\nexport function syncBilling(user: User) {\n  return user.email.toLowerCase();\n}\n',
    "src/mailer.ts": 'import { User } from "./types";\nimport { syncBilling } from "./billing";\n\nexport function sendWelcome(user: User) {\n  deliver(user.email);\n  return syncBilling(user);\n}\n',
    "src/profile.ts": 'import { User } from "./types";\n\nexport const label = (user: User) => {\n  const shown = user.email;\n  return shown;\n};\n',
    "src/types.ts": "export interface User {\n  id: string;\n  email: string | null;\n}\n",
    "prisma/schema.prisma": "model User {\n  id    String  @id\n  email String?\n  phone String?\n}\n",
}

DIFF = """diff --git a/prisma/schema.prisma b/prisma/schema.prisma
--- a/prisma/schema.prisma
+++ b/prisma/schema.prisma
@@ -1,4 +1,5 @@
 model User {
   id    String  @id
-  email String
+  email String?
+  phone String?
 }
diff --git a/src/types.ts b/src/types.ts
--- a/src/types.ts
+++ b/src/types.ts
@@ -1,4 +1,4 @@
 export interface User {
   id: string;
-  email: string;
+  email: string | null;
 }
"""


def frames(spark, analysis_id="g", files=None, diff=DIFF):
    files = FILES if files is None else files
    rows = [(analysis_id, k, p, c) for k, (p, c) in enumerate(files.items(), 1)]
    return spark.createDataFrame(rows, "analysis_id string, file_seq int, path string, content string"), spark.createDataFrame([(analysis_id, diff)], "analysis_id string, diff string")


GOLDEN_IDS = {
    "route": "app/api/users/route.ts", "billing": "src/billing.ts", "mailer": "src/mailer.ts", "profile": "src/profile.ts", "types": "src/types.ts", "schema": "prisma/schema.prisma",
}


def golden_values() -> dict[str, str]:
    f = {k: f"{p}:file:{p}" for k, p in GOLDEN_IDS.items()}
    post, sync, send, label = "app/api/users/route.ts:api_route:POST", "src/billing.ts:function:syncBilling", "src/mailer.ts:function:sendWelcome", "src/profile.ts:function:label"
    user, model = "src/types.ts:interface:User", "prisma/schema.prisma:database_model:User"
    fields = [f"prisma/schema.prisma:database_field:User.{x}" for x in ("id", "email", "phone")]
    nodes = [(f["route"], "file"), (post, "api_route"), (f["billing"], "file"), (sync, "function"), (f["mailer"], "file"), (send, "function"), (f["profile"], "file"), (label, "function"), (f["types"], "file"), (user, "interface"), (f["schema"], "file"), (model, "database_model")]
    nodes += [(x, "database_field") for x in fields] + [("field:User.id", "type"), ("field:User.email", "type"), ("field:User.phone", "database_field")]
    email = "field:User.email"
    edges = [(f["route"], post, "contains"), (f["billing"], sync, "contains"), (f["mailer"], send, "contains"), (f["profile"], label, "contains"), (f["types"], user, "contains"), (f["schema"], model, "contains")] + [(f["schema"], x, "contains") for x in fields]
    edges += [(f["route"], f["mailer"], "imports"), (f["billing"], f["types"], "imports"), (f["mailer"], f["types"], "imports"), (f["mailer"], f["billing"], "imports"), (f["profile"], f["types"], "imports"), (post, send, "calls"), (send, sync, "calls")]
    ids = [f"{a}->{b}:{t}" for a, b, t in edges] + [f"{sync}->{email}:uses_field:method_call:toLowerCase", f"{send}->{email}:uses_field:argument:deliver", f"{label}->{email}:uses_field:property_access:access"]
    types = [t for *_, t in edges] + ["uses_field"] * 3
    affected = [(sync, 1), (send, 1), (label, 1), (f["billing"], 2), (f["mailer"], 2), (post, 2), (f["profile"], 2), (f["route"], 3)]
    risks = [(f"static:nullable-method-toLowerCase:{email}:{sync}", "critical", 98), (f"static:nullable-argument-deliver:{email}:{send}", "high", 79), (f"static:nullable-property-access:{email}:{label}", "medium", 45)]
    q = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"
    table = lambda rows, *names: "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"
    return {
        "golden_nodes": table([(k, *n) for k, n in enumerate(nodes, 1)], "node_seq", "id", "type"),
        "golden_edges": table([(k, i, t) for k, (i, t) in enumerate(zip(ids, types), 1)], "edge_seq", "id", "type"),
        "golden_affected": table([(k, *a) for k, a in enumerate(affected, 1)], "out_seq", "node_id", "depth"),
        "golden_risks": table([(k, *r) for k, r in enumerate(risks, 1)], "rank", "id", "severity", "score"),
        "golden_summary": "SELECT CAST(1 AS BIGINT) AS changed, CAST(8 AS BIGINT) AS affected, CAST(3 AS BIGINT) AS risks, CAST(1 AS BIGINT) AS critical, CAST(1 AS BIGINT) AS high, 88 AS score",
        "golden_fixed": table([(1, email, "database_field", "type_changed", "email String", "email String?"), (2, "field:User.phone", "database_field", "added", None, "phone String?"), (3, email, "type", "type_changed", "email: string;", "email: string | null;")], "change_seq", "node_id", "type", "change_type", "before", "after"),
    }
