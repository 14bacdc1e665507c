"""Column expressions of the risk model: clamps, weights, classifiers, string and path helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the risk model.
SEVERITY_WEIGHT = {"critical": 100.0, "high": 80.0, "medium": 55.0, "low": 30.0}
CATEGORY_MULTIPLIER = {
    "security": 1.15, "data_integrity": 1.12, "database": 1.08, "runtime": 1.05, "api_breaking_change": 1.05,
    "type": 1.0, "business_logic": 1.0, "dependency": 0.95, "performance": 0.9,
}
OTHER_CATEGORY = 0.85
SOURCE_MULTIPLIER = {"hybrid": 1.08, "static": 1.05, "ai": 0.95}
CATEGORIES = ("type", "runtime", "api_breaking_change", "data_integrity", "database", "security", "performance", "dependency", "business_logic", "unknown")
SEVERITIES = ("critical", "high", "medium", "low")
#: String methods that throw on a missing value.
DANGEROUS_METHODS = ("trim", "toLowerCase", "toUpperCase", "substring", "slice", "replace", "split", "includes", "startsWith", "endsWith", "charAt", "match")
STRUCTURAL_TYPES = ("database_model", "database_field", "interface", "type")
HIGH_IMPACT = ("deleted", "signature_changed", "type_changed")
SCORE_CEILING = 98.0

#: White space and word edges as ECMAScript regular expressions see them.
WS = r"[\s ﻿  -     　]"
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
IDENT = r"[A-Za-z_$][\w$]*"


def _lookup(value: Column, table: dict[str, float], other: float) -> Column:
    out = None
    for key, number in table.items():
        out = F.when(value == key, F.lit(number)) if out is None else out.when(value == key, F.lit(number))
    return out.otherwise(F.lit(other))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def normalize_confidence(c: Column) -> Column:
    """Percentages above one become shares; then 0 to 1."""
    return clamp(F.when(c > 1, c / 100).otherwise(c), 0.0, 1.0)


def sanitize_confidence(c: Column) -> Column:
    """Half where the number is missing or not finite."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(~finite, F.lit(0.5)).when(c > 1, F.least(c / 100, F.lit(1.0))).otherwise(clamp(c, 0.0, 1.0))


def severity_weight(severity: Column) -> Column:
    return _lookup(severity, SEVERITY_WEIGHT, float("nan"))


def proximity_multiplier(depth: Column) -> Column:
    return F.when(depth.isNull() | (depth <= 1), F.lit(1.0)).when(depth == 2, F.lit(0.9)).when(depth == 3, F.lit(0.8)).when(depth == 4, F.lit(0.7)).otherwise(F.lit(0.6))


def category_multiplier(category: Column) -> Column:
    return _lookup(category, CATEGORY_MULTIPLIER, OTHER_CATEGORY)


def source_multiplier(source: Column) -> Column:
    return _lookup(source, SOURCE_MULTIPLIER, 1.0)


def raw_score(severity: Column, confidence: Column, depth: Column, category: Column, source: Column) -> Column:
    return severity_weight(severity) * normalize_confidence(confidence) * proximity_multiplier(depth) * category_multiplier(category) * source_multiplier(source)


def risk_score(severity: Column, confidence: Column, depth: Column, category: Column, source: Column) -> Column:
    """0 to 98, rounded half up; null where the severity is unknown."""
    raw = raw_score(severity, confidence, depth, category, source)
    return F.when(~F.isnan(raw), F.floor(clamp(raw, 0.0, SCORE_CEILING) + 0.5).cast("int"))


def score_severity(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def score_label(score: Column) -> Column:
    return F.upper(score_severity(score))


def valid_severity(s: Column) -> Column:
    return F.when(s.isin(*SEVERITIES), s).otherwise("medium")


def valid_category(c: Column) -> Column:
    return F.when(c.isin(*CATEGORIES), c).otherwise("unknown")


def is_nullable_text(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text.contains("null") | text.contains("undefined") | text.rlike(r"\w+\?")


def became_nullable(before: Column, after: Column) -> Column:
    return ~is_nullable_text(before) & is_nullable_text(after)


def is_dangerous_method(method: Column) -> Column:
    return F.coalesce(method.isin(*DANGEROUS_METHODS), F.lit(False))


def change_type(before: Column, after: Column) -> Column:
    """added, deleted, type_changed or modified, from the texts on both sides."""
    b, a = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    typed = lambda x: x.contains(":") | x.contains("String") | x.contains("?") | x.contains("|")
    return F.when((b == "") & (a != ""), "added").when((b != "") & (a == ""), "deleted").when((b != a) & (typed(b) | typed(a)), "type_changed").otherwise("modified")


def is_high_impact(change: Column) -> Column:
    return change.isin(*HIGH_IMPACT)


def trim_ws(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def filled(x: Column, other: Column) -> Column:
    """`other` where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), other)


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("int")


def normal_path(p: Column) -> Column:
    return F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"^\./", "")


def clean_diff_path(p: Column) -> Column:
    """A path of a diff header without its side prefix; one `a/`, then one `b/`."""
    return trim_ws(F.regexp_replace(F.regexp_replace(p, "^a/", ""), "^b/", ""))


def without_extension(p: Column) -> Column:
    return F.regexp_replace(p, r"\.(tsx?|jsx?)$", "")


def dirname(p: Column) -> Column:
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(".")


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def join_path(directory: Column, relative: Column) -> Column:
    """The joined path with `.` and `..` resolved."""
    parts = F.filter(F.split(F.concat(directory, F.lit("/"), relative), "/"), lambda x: (x != "") & (x != "."))

    def step(kept, part):
        up = (part == "..") & (F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, part))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", ".").otherwise(joined)


def last_dotted(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def clean_callee(name: Column) -> Column:
    """The last name of a call chain, without the arguments inside it."""
    return last_dotted(F.regexp_replace(name, r"\([^)]*\)", ""))


def symbol_id(path: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", path, kind, name)


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit(":"), kind)


def field_id(name: Column) -> Column:
    return F.concat(F.lit("field:"), name)
