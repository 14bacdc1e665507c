"""Changed lines in files where very many symbols share a span: what is compared grows with the different spans."""

from pyspark.sql import functions as F

from rippletrace.operators import changes
from rippletrace.schemas import SYMBOL_META

LINES, SYMBOLS = 300, 400


def most_rows(df):
    """(rows of the result, most rows that any step of the plan put out)."""
    found, todo, most = len(df.collect()), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        children = node.children()
        todo += [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
    return found, most


def tables(spark, kind, path="f.ts"):
    n = F.col("id")
    lines = spark.range(LINES).select(
        F.lit("a").alias("analysis_id"), F.lit(1).alias("file_seq"), (n % 7).cast("int").alias("hunk_seq"), n.cast("int").alias("pos"), F.lit(path).alias("old_path"), F.lit(path).alias("new_path"), F.lit("modified").alias("status"),
        F.when(n % 2 == 0, "added").otherwise("removed").alias("type"), F.concat(F.lit("k: "), n.cast("string")).alias("content"), F.lit(15).alias("old_line"), F.lit(15).alias("new_line"),
    )
    name = F.concat(F.lit("S"), n.cast("string"), F.lit(".k"))
    symbols = spark.range(SYMBOLS).select(F.lit("a").alias("analysis_id"), n.alias("symbol_seq"), name.alias("id"), name.alias("name"), F.lit(kind).alias("type"), F.lit(path).alias("file_path"), F.lit(10).alias("start_line"), F.lit(20).alias("end_line"), F.lit(None).cast(SYMBOL_META).alias("metadata"))
    return lines, symbols


def test_symbols_of_one_span_are_no_product_with_its_lines(spark):
    found, most = most_rows(changes.symbol_changes(*tables(spark, "function")))
    assert found == SYMBOLS and most < 10 * (LINES + SYMBOLS)
    found, most = most_rows(changes.prisma_field_changes(*tables(spark, "database_field", "f.prisma")))
    assert found == SYMBOLS and most < 10 * (LINES + SYMBOLS)


def test_points_of_one_line_are_no_product_with_the_types_around_it(spark):
    lines, symbols = tables(spark, "interface")
    points = lines.select("analysis_id", F.col("new_path").alias("path_key"), F.col("new_line").alias("no"), "pos")
    df = changes.enclosing_type(points, symbols)
    found, most = most_rows(df)
    assert found == LINES and most < 10 * (LINES + SYMBOLS) and {r.parent for r in df.collect()} == {"S0.k"}


def test_changes_are_compared_by_digests(spark):
    lines, symbols = tables(spark, "function")
    twice = symbols.unionByName(symbols.withColumn("symbol_seq", F.col("symbol_seq") + SYMBOLS).withColumn("start_line", F.lit(9)))
    df = changes.detect(lines, twice)
    found, most = most_rows(df)
    rows = df.orderBy("change_seq").collect()
    want = "\n".join(f"k: {n}" for _, n in sorted((n % 7, n) for n in range(1, LINES, 2)))
    assert found == SYMBOLS and most < 20 * (LINES + SYMBOLS) and [r.change_seq for r in rows] == list(range(1, SYMBOLS + 1))
    assert {r.before for r in rows} == {want} and {r.change_type for r in rows} == {"type_changed"} and rows[0].node_id == "S0.k"
