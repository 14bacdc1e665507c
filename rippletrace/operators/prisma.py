"""Models and fields of Prisma schemas, by regular expressions over whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.exprs import WS, symbol_id, trim_ws
from rippletrace.schemas import CALLS, SYMBOL_META

MODEL = rf"model{WS}+(\w+){WS}*\{{([\s\S]*?)\}}"
FIELD = rf"^(\w+){WS}+([^\s]+)(.*)$"


def models(files: DataFrame) -> DataFrame:
    """(analysis_id, file_seq, path, model_seq, name, body, code, start_line)."""
    matched = files.withColumn("m", F.arrays_zip(F.regexp_extract_all("content", F.lit(MODEL), 0).alias("code"), F.regexp_extract_all("content", F.lit(MODEL), 1).alias("name"), F.regexp_extract_all("content", F.lit(MODEL), 2).alias("body")))
    # Where each match begins: after the end of the one before it.
    step = lambda s, m: F.struct(
        (F.call_function("locate", m["code"], F.col("content"), s["end"]) + F.length(m["code"])).cast("int").alias("end"),
        F.array_append(s["starts"], F.call_function("locate", m["code"], F.col("content"), s["end"]).cast("int")).alias("starts"),
    )
    zero = F.struct(F.lit(1).alias("end"), F.array().cast("array<int>").alias("starts"))
    matched = matched.withColumn("starts", F.aggregate("m", zero, step, lambda s: s["starts"]))
    rows = matched.select("analysis_id", "file_seq", "path", "content", F.posexplode(F.arrays_zip("m", "starts")).alias("model_seq", "x"))
    before = F.substring(F.col("content"), F.lit(1), F.col("x.starts") - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return rows.select("analysis_id", "file_seq", "path", "model_seq", F.col("x.m.name").alias("name"), F.col("x.m.body").alias("body"), F.col("x.m.code").alias("code"), line.cast("int").alias("start_line"))


def fields(found: DataFrame, *, line_fix: bool = False) -> DataFrame:
    """One row for each field line; recorded lines are one too high unless `line_fix`."""
    rows = found.select("analysis_id", "file_seq", "path", "model_seq", F.col("name").alias("model"), "start_line", F.posexplode(F.split("body", "\n")).alias("index", "raw"))
    rows = rows.withColumn("raw", trim_ws(F.col("raw")))
    rows = rows.where((F.col("raw") != "") & ~F.col("raw").startswith("//") & ~F.col("raw").startswith("@@") & F.col("raw").rlike(FIELD))
    part = lambda i: F.regexp_extract("raw", FIELD, i)
    line = (F.col("start_line") + F.col("index") + (0 if line_fix else 1)).cast("int")
    return rows.select("analysis_id", "file_seq", "path", "model_seq", "model", "index", "raw", part(1).alias("field"), part(2).alias("field_type"), trim_ws(part(3)).alias("attributes"), part(2).endswith("?").alias("nullable"), line.alias("line"))


def symbols(files: DataFrame, *, line_fix: bool = False) -> DataFrame:
    """Symbol rows of both, with the order (file_seq, kind_rank, pos): a model, then its fields."""
    found = models(files)
    none, no_meta = F.array().cast(CALLS), F.lit(None).cast(SYMBOL_META)
    height = F.length("code") - F.length(F.replace(F.col("code"), F.lit("\n"), F.lit("")))
    top = found.select(
        "analysis_id", "file_seq", F.col("model_seq").alias("kind_rank"), F.lit(-1).alias("pos"), symbol_id(F.col("path"), F.lit("database_model"), F.col("name")).alias("id"),
        "name", F.lit("database_model").alias("type"), F.col("path").alias("file_path"), "start_line", (F.col("start_line") + height).cast("int").alias("end_line"),
        F.lit(True).alias("exported"), F.concat(F.lit("model "), F.col("name")).alias("signature"), "code", none.alias("calls"), none.alias("references"), no_meta.alias("metadata"),
    )
    full = F.concat_ws(".", "model", "field")
    meta = F.struct("model", "field", "field_type", "nullable", "attributes").cast(SYMBOL_META)
    low = fields(found, line_fix=line_fix).select(
        "analysis_id", "file_seq", F.col("model_seq").alias("kind_rank"), F.col("index").alias("pos"), symbol_id(F.col("path"), F.lit("database_field"), full).alias("id"),
        full.alias("name"), F.lit("database_field").alias("type"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        F.lit(True).alias("exported"), F.concat_ws(" ", "field", "field_type").alias("signature"), F.col("raw").alias("code"), none.alias("calls"),
        F.array(F.struct(F.col("model").alias("name"), F.col("line").alias("line"))).cast(CALLS).alias("references"), meta.alias("metadata"),
    )
    return top.unionByName(low)
