"""Fields of interfaces, typed variables and field usages, as array expressions over a symbol's code.

All work for one symbol happens inside its row; rows are dealt once before, as a small file may hold very many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippletrace.functions.exprs import EDGE, IDENT, WS
from rippletrace.functions.ordering import spread

FIELD_LINE = rf"(?:^|\n){WS}*(?:readonly{WS}+)?({IDENT})\??{WS}*:{WS}*([^;\n}}]+)"
TYPED = rf"{EDGE}({IDENT}){WS}*:{WS}*({IDENT}){EDGE}"
METHOD = rf"{EDGE}({IDENT})\.({IDENT})\.({IDENT}){WS}*\("
CALL = rf"{EDGE}({IDENT}){WS}*\(([^)]*)\)"
ACCESS = rf"{EDGE}({IDENT})\.({IDENT}){EDGE}"


def _groups(text: Column, pattern: str, *names: str) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), i + 1).alias(n) for i, n in enumerate(names)])


def _hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once a row: a generator of one row keeps the optimizer from
    writing their expressions into every later use, above all into array lambdas."""
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", held.alias("_held")).select(*df.columns, *[F.col(f"_held.{n}").alias(n) for n in columns])


def _first_of(items: str, keys: str) -> Column:
    """The first item of each key, given both as columns."""
    return F.filter(items, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def interface_fields(symbols: DataFrame) -> DataFrame:
    """(…, pos, field): `Type.property` of interfaces and type aliases, repeated ones too."""
    typed = symbols.where(F.col("type").isin("interface", "type"))
    found = F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(FIELD_LINE), 1)
    return typed.select("*", F.posexplode(F.transform(found, lambda f: F.concat_ws(".", "name", f))).alias("pos", "field"))


def _last_types(pairs: Column) -> Column:
    last = lambda v: F.element_at(F.filter(pairs, lambda p: p["var"] == v), -1)["type"]
    return F.transform(F.array_distinct(F.transform(pairs, lambda p: p["var"])), lambda v: F.struct(v.alias("var"), last(v).alias("type")))


def with_variables(symbols: DataFrame) -> DataFrame:
    """symbols with `variables`, array<struct<var, type>>: last type of each variable, in order of first mention."""
    df = _hold(spread(symbols, *[c for c in ("analysis_id", "symbol_seq") if c in symbols.columns]), _pairs=_groups(F.coalesce("code", F.lit("")), TYPED, "var", "type"))
    return _hold(df, variables=_last_types(F.col("_pairs"))).drop("_pairs")


def _type_of(variables: Column, var: Column) -> Column:
    return F.try_element_at(F.filter(variables, lambda v: v["var"] == var), F.lit(1))["type"]


def _usage(field, var, prop, kind, method, callee, expression) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(field.alias("field"), var.alias("variable"), prop.alias("property"), F.lit(kind).alias("kind"), (none if method is None else method).alias("method"), (none if callee is None else callee).alias("callee"), expression.alias("expression"))


def with_usages(symbols: DataFrame) -> DataFrame:
    """symbols with `usages`: method calls, then arguments, then plain accesses of fields not used before."""
    code, vars_ = F.coalesce("code", F.lit("")), F.col("variables")
    df = _hold(with_variables(symbols), _m=_groups(code, METHOD, "v", "p", "m"), _c=_groups(code, CALL, "callee", "args"), _a=_groups(code, ACCESS, "v", "p"))
    name = lambda v, p: F.concat_ws(".", _type_of(vars_, v), p)
    typed = lambda items: F.filter(items, lambda x: F.exists(vars_, lambda v: v["var"] == x["v"]))
    methods = F.transform(typed("_m"), lambda x: _usage(name(x["v"], x["p"]), x["v"], x["p"], "method_call", x["m"], None, F.concat(x["v"], F.lit("."), x["p"], F.lit("."), x["m"], F.lit("()"))))
    props = lambda v, args: F.regexp_extract_all(args, F.concat(F.lit(EDGE), v["var"], F.lit(rf"\.({IDENT}){EDGE}")), F.lit(1))
    passed = lambda c, v, p: _usage(F.concat_ws(".", v["type"], p), v["var"], p, "argument", None, c["callee"], F.concat(c["callee"], F.lit("("), v["var"], F.lit("."), p, F.lit(")")))
    arguments = F.flatten(F.transform("_c", lambda c: F.flatten(F.transform(vars_, lambda v: F.transform(props(v, c["args"]), lambda p: passed(c, v, p))))))
    plain = F.transform(typed("_a"), lambda x: _usage(name(x["v"], x["p"]), x["v"], x["p"], "property_access", None, None, F.concat_ws(".", x["v"], x["p"])))
    df = _hold(df, _methods=methods, _arguments=arguments, _plain=plain)
    df = _hold(df, _mk=F.transform("_methods", lambda u: F.concat_ws(":", u["field"], u["method"])), _ak=F.transform("_arguments", lambda u: F.concat_ws(":", u["field"], u["callee"])), _pk=F.transform("_plain", lambda u: u["field"]))
    df = _hold(df, _used=F.concat(_first_of("_methods", "_mk"), _first_of("_arguments", "_ak")), _new=_first_of("_plain", "_pk"))
    df = _hold(df, _known=F.transform("_used", lambda u: u["field"]))
    usages = F.concat("_used", F.filter("_new", lambda u: ~F.array_contains("_known", u["field"])))
    return df.withColumn("usages", usages).select(*symbols.columns, "usages")
