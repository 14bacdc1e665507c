"""Dedupe, score and rank risks; one overall score and summary for each analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippletrace.functions.exprs import SCORE_CEILING, clamp, normalize_confidence, risk_score
from rippletrace.functions.ordering import numbered_widely, ordered_list
from rippletrace.functions.shared import cut

TOP = 5
#: Order of ranks: by score, then confidence, then first seen.
BEST_FIRST = {"score": F.desc, "confidence": F.desc, "risk_seq": F.asc}


def dedupe(risks: DataFrame) -> DataFrame:
    """One risk for each fingerprint: the most confident, with the evidence of all in order, at the place of the first.

    Fingerprint: category, changed id or name, affected id or name, title without case and outer blanks.
    Risks that come without the column evidence are merged without reading any, in one grouping.
    """
    text = lambda *cs: F.coalesce(*cs, F.lit(""))
    title = F.lower(F.regexp_replace("title", r"^\s+|\s+$", ""))
    key = F.struct(text("category").alias("k"), text("changed_node_id", "changed_symbol").alias("c"), text("affected_node_id", "affected_symbol").alias("a"), text(title).alias("t"))
    keyed = risks.withColumn("_k", key)
    # Winners and evidence are aggregates that combine before they are shuffled, so one fingerprint may hold very many rows.
    strongest = F.struct(normalize_confidence(F.col("confidence")).alias("n"), (-F.col("risk_seq")).alias("s"))
    # Each column is picked on its own, so those that nobody reads are left out before rows are sorted and grouped.
    rest = [c for c in risks.columns if c not in ("analysis_id", "risk_seq")]
    best = keyed.groupBy("analysis_id", "_k").agg(*[F.max_by(c, strongest).alias(c) for c in rest], F.min("risk_seq").alias("risk_seq"), F.count(F.lit(1)).alias("_size"))
    if "evidence" not in rest:
        return best.select(*risks.columns)
    # A least number for each text and place is hashed, without sorting; what is left of the rows is put in order.
    texts = keyed.select("analysis_id", "_k", "risk_seq", F.posexplode("evidence").alias("pos", "e")).groupBy("analysis_id", "_k", "e", "pos").agg(F.min("risk_seq").alias("risk_seq"))
    texts = texts.groupBy("analysis_id", "_k", "e").agg(F.min(F.struct("risk_seq", "pos")).alias("at"))
    texts = texts.groupBy("analysis_id", "_k").agg(ordered_list(F.col("e"), "at").alias("_all"))
    merged = best.join(texts, ["analysis_id", "_k"], "left")
    evidence = F.when(F.col("_size") > 1, F.coalesce("_all", F.array().cast("array<string>"))).otherwise(F.col("evidence"))
    return merged.select(*[evidence.alias(c) if c == "evidence" else F.col(c) for c in risks.columns])


def score(risks: DataFrame) -> DataFrame:
    return risks.withColumn("score", risk_score(F.col("severity"), F.col("confidence"), F.col("dependency_depth"), F.col("category"), F.col("source")))


def rank(scored: DataFrame) -> DataFrame:
    """Rank from 1 by score, then confidence, then first seen."""
    return numbered_widely(scored, "rank", ["analysis_id"], *(way(c) for c, way in BEST_FIRST.items()))


def overall(scored: DataFrame, analyses: DataFrame) -> DataFrame:
    """(analysis_id, risks, score): the five best scores weighted by 1 / rank, plus a bonus for many risks; 0 without any."""
    return _overall(_graded(scored), analyses)


def _graded(scored: DataFrame) -> DataFrame:
    """What the sums read of scored risks, written once: it is read for the best, for counts and for grades."""
    return cut(scored.select("analysis_id", "risk_seq", "severity", "confidence", "score"))


def _overall(scored: DataFrame, analyses: DataFrame) -> DataFrame:
    # Only the best of each analysis are numbered; the limit holds before the shuffle too.
    best_first = Window.partitionBy("analysis_id").orderBy(F.desc("score"), F.desc("confidence"), "risk_seq")
    top = scored.select("analysis_id", "score", F.row_number().over(best_first).alias("rank")).where(F.col("rank") <= TOP)
    # Terms are added in rank order, so the double sum is the same wherever it is computed.
    terms = lambda f: F.aggregate(ordered_list(f, "rank"), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    weight = F.lit(1.0) / F.col("rank")
    best = top.groupBy("analysis_id").agg(terms(F.col("score") * weight).alias("weighted"), terms(weight).alias("weights"))
    counts = scored.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("risks"))
    base = F.col("weighted") / F.col("weights") + F.least(F.col("risks") * 1.5, F.lit(10.0))
    total = F.floor(clamp(base, 0.0, SCORE_CEILING) + 0.5).cast("int")
    out = analyses.select("analysis_id").distinct().join(counts, "analysis_id", "left").join(best, "analysis_id", "left")
    return out.select("analysis_id", F.coalesce("risks", F.lit(0).cast("long")).alias("risks"), F.coalesce(total, F.lit(0)).alias("score"))


def summary(analyses: DataFrame, changes: DataFrame, affected: DataFrame, scored: DataFrame) -> DataFrame:
    """(analysis_id, changed, affected, risks, critical, high, score)."""
    count = lambda df, name: df.groupBy("analysis_id").agg(F.count(F.lit(1)).alias(name))
    scored = _graded(scored)
    grades = scored.groupBy("analysis_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"))
    out = _overall(scored, analyses).join(count(changes, "changed"), "analysis_id", "left").join(count(affected, "affected"), "analysis_id", "left").join(grades, "analysis_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("analysis_id", zero("changed"), zero("affected"), "risks", zero("critical"), zero("high"), "score")
