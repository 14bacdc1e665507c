"""From raw documents to token ids: five stages, each over all that the one before kept.

Stages give rows with the columns of `documents`; the last adds token ids. `run`
writes every stage's rows as Parquet in the shared folder and reads them again.

Defined cases, in every stage: an empty table gives an empty one; further columns of any name and
type pass through; null and empty texts are documents without words, bytes or data, so they are
scored as such, are copies of nothing, hold no benchmark passage and no personal data, and have no
tokens; rows without an id stay unless their own text is toxic or contaminated; equal rows are
copies, of which one stays (all of them without an id or without words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.llm import bpe, decontaminate, jaccard, pii, toxicity
from rippletrace.llm._common import cut, table
from rippletrace.llm.queries import tokenizer


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the field is fitted on labelled rows outside the held-out part."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train_on=~toxicity.held_out())
    return toxicity.reject(docs, model)


def jaccard_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near and exact copies."""
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text; these columns replace others of their names."""
    coded = bpe.encode(docs, *tokenizer())
    text = F.col(f"in_{docs.columns.index('text')}")
    own = [F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("n_tokens", "token_ids", "round_trip")]
    return coded.select(*own, "n_tokens", F.col("ids").alias("token_ids"), (F.coalesce(text, F.lit("")).cast("binary") == F.col("decoded")).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", jaccard_deduplication),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("byte_bpe", byte_bpe),
]

#: Fitted models and merges are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
