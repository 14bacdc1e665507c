"""Schemas of the tables that the engine passes between its operators."""

from __future__ import annotations

SOURCE_FILE = "analysis_id string, file_seq int, path string, content string, size bigint"
DIFF_INPUT = "analysis_id string, base string, head string, diff string"
IMPORT_DECL = "analysis_id string, file_seq int, file_path string, import_seq int, source string, imported_names array<string>, default_import string, namespace_import string, line int"
CALLS = "array<struct<name:string,line:int>>"
SYMBOL_META = "struct<model:string,field:string,field_type:string,nullable:boolean,attributes:string>"
SYMBOL = (
    "analysis_id string, symbol_seq bigint, id string, name string, type string, file_path string, start_line int, end_line int, "
    f"exported boolean, signature string, code string, calls {CALLS}, references {CALLS}, metadata {SYMBOL_META}"
)
LLM_RISKS = (
    "struct<risks:array<struct<title:string,description:string,category:string,severity:string,confidence:double,reason:string,"
    "failurePath:array<string>,evidence:array<string>,suggestedFix:string,affectedSymbol:string,affectedNodeId:string>>>"
)
LLM_ENRICHMENT = "struct<enrichedRisks:array<struct<id:string,description:string,suggestedFix:string,severity:string,confidence:double>>>"
