"""Sources and sinks: repository locators, directory scans, diffs, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.functions.exprs import filled, trim_ws
from rippletrace.functions.ordering import numbered

# What a scan reads, and path segments it leaves out.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".prisma")
IGNORED_SEGMENTS = (".git", "node_modules", ".next", "dist", "build", "coverage", "vendor", ".turbo", ".cache")


def repo_locator(text: Column) -> Column:
    """struct<owner, repo> of an address, of `owner/repo`, or of the last two parts of a path."""
    clean = F.regexp_replace(trim_ws(text), r"\.git$", "")
    found = lambda pattern, group: F.nullif(F.regexp_extract(clean, pattern, group), F.lit(""))
    hosted, short = r"github\.com/([^/]+)/([^/]+)", r"^([^/]+)/([^/]+)$"
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    owner = F.coalesce(found(hosted, 1), found(short, 1), F.try_element_at(parts, F.lit(-2)), F.lit("repo"))
    repo = F.coalesce(found(hosted, 2), found(short, 2), F.try_element_at(parts, F.lit(-1)), F.lit("repo"))
    return F.struct(owner.alias("owner"), repo.alias("repo"))


def remote_address(text: Column) -> Column:
    """The address a locator is fetched from; short forms are hosted."""
    at, text = repo_locator(text), trim_ws(text)
    return F.when(text.startswith("http"), text).otherwise(F.concat(F.lit("https://github.com/"), at["owner"], F.lit("/"), at["repo"], F.lit(".git")))


def cache_name(text: Column) -> Column:
    """The folder name under which a repository is kept."""
    at = repo_locator(text)
    return F.regexp_replace(F.concat_ws("_", at["owner"], at["repo"]), "[^a-zA-Z0-9_-]", "_")


def is_supported(path: Column) -> Column:
    out = F.lit(False)
    for e in EXTENSIONS:
        out = out | path.endswith(e)
    return out


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_SEGMENTS)))


def language(path: Column) -> Column:
    p = F.lower(path)
    return F.when(p.endswith(".tsx"), "tsx").when(p.endswith(".ts"), "typescript").when(p.endswith(".jsx"), "jsx").when(p.endswith(".js"), "javascript").when(p.endswith(".prisma"), "prisma").otherwise("unknown")


def select_files(files: DataFrame) -> DataFrame:
    """Supported files outside ignored folders, with size and language."""
    kept = files.where(is_supported(F.col("path")) & ~is_ignored(F.col("path")))
    return kept.withColumn("size", F.octet_length("content").cast("long")).withColumn("language", language(F.col("path")))


def scan_directory(spark: SparkSession, root: str, analysis_id: str) -> DataFrame:
    """Source files under a folder, ordered by path; read as whole texts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    bare = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    relative = F.when(F.locate(base, bare) > 0, F.substring_index(bare, base, -1)).otherwise(bare)
    files = select_files(raw.select(F.lit(analysis_id).alias("analysis_id"), relative.alias("path"), F.decode("content", "UTF-8").alias("content")))
    return numbered(files, "file_seq", ["analysis_id"], "path")


def pick_ref(refs: DataFrame) -> DataFrame:
    """For each wanted (analysis_id, ref): the remote branch if there is one, else the local name, else null (what lies on disk)."""
    wanted = refs.groupBy("analysis_id", "ref").agg(F.collect_set("available").alias("names"))
    remote = F.concat(F.lit("origin/"), F.col("ref"))
    return wanted.select("analysis_id", "ref", F.when(F.array_contains("names", remote), remote).when(F.array_contains("names", F.col("ref")), F.col("ref")).alias("checkout"))


def diff_text(remote: Column, local: Column) -> Column:
    """The diff of the remote refs, or of the local ones where that is blank; never null."""
    return F.when(F.coalesce(trim_ws(remote), F.lit("")) != "", remote).otherwise(F.coalesce(local, F.lit("")))


def requests(df: DataFrame) -> DataFrame:
    """Analysis requests with defaults: base `main`, head `HEAD`; rows without a repository are marked invalid."""
    url = trim_ws(F.coalesce("repo_url", F.lit("")))
    base, head = (filled(trim_ws(F.coalesce(c, F.lit(""))), F.lit(d)) for c, d in (("base", "main"), ("head", "HEAD")))
    return df.withColumn("status", F.when(url == "", 400).otherwise(200)).withColumn("base", base).withColumn("head", head)


def page_arguments(df: DataFrame) -> DataFrame:
    """Stricter form for views: repository and head must both be given."""
    ok = (trim_ws(F.coalesce("repo_url", F.lit(""))) != "") & (trim_ws(F.coalesce("head", F.lit(""))) != "")
    return requests(df.withColumn("_ok", ok)).withColumn("status", F.when(F.col("_ok"), 200).otherwise(400)).drop("_ok")


def to_json_result(df: DataFrame, key: str = "analysis_id") -> DataFrame:
    """One JSON document for each row."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"}).alias("body"))


def json_fragments(head: DataFrame, lists: dict[str, tuple[DataFrame, str]], key: str = "analysis_id") -> DataFrame:
    """(key, section, place, text): pieces that make one JSON document for each row of `head`, read by section and place.

    The document is that of `head`'s columns and, for each list, an array of its rows in the order of its
    column. No row holds an array, so a list may be of any length. Lists of keys without a row in `head` are left out.
    """
    columns = [c for c in head.columns if c != key]
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}) if columns else F.lit("{}")
    opened = F.regexp_replace(body, r"\}$", "")
    parts = [head.select(key, F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), opened.alias("text"))]
    for k, (name, (rows, order)) in enumerate(lists.items()):
        comma = "," if columns or k else ""
        label = F.lit(f'{comma}"{name}":[')
        parts.append(head.select(key, F.lit(2 * k + 1).alias("section"), F.lit(0).cast("long").alias("place"), label.alias("text")))
        row = F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"})
        first = rows.groupBy(key).agg(F.min(order).alias("_first"))
        put = F.concat(F.when(F.col(order) == F.col("_first"), "").otherwise(","), row)
        known = rows.join(head.select(key), key, "left_semi").join(first, key)
        parts.append(known.select(key, F.lit(2 * k + 2).alias("section"), F.col(order).cast("long").alias("place"), put.alias("text")))
        parts.append(head.select(key, F.lit(2 * k + 2).alias("section"), F.lit(2**62).cast("long").alias("place"), F.lit("]").alias("text")))
    parts.append(head.select(key, F.lit(2 * len(lists) + 1).alias("section"), F.lit(0).cast("long").alias("place"), F.lit("}").alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_fragments(fragments: DataFrame, folder: str, key: str = "analysis_id") -> None:
    """Fragments as text files below a folder for each key: their lines, files in order of name, are the document.

    Ranges of the order go to tasks, so a document of any size is written by many of them.
    """
    order = [key, "section", "place"]
    fragments.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "text").write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").text(folder)


def save_keyed(tables: dict[str, DataFrame], folder: str, key: str = "analysis_id") -> None:
    """Each table as Parquet below a folder for each key. Keys in the table replace what stood there; others stay.

    A write that is stopped or runs again leaves each key's rows of one run: Spark publishes the folders at the end of the job.
    """
    for name, df in tables.items():
        df.repartition(key).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder.rstrip('/')}/{name}")


def save_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Each table as Parquet under its name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def save_managed(tables: dict[str, DataFrame], database: str, mode: str = "overwrite") -> None:
    """Each table as a managed table of a database."""
    for name, df in tables.items():
        df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        df.write.mode(mode).saveAsTable(f"{database}.{name}")
