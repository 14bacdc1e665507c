"""Impact report: what breaks in the users of changed catalogue fields, ranked and partitioned.

Reads the star-schema tables: parts are the changed fields, line items the uses that suppliers make of
them. The library's rules turn changes and uses into risks, which are merged, scored and ranked;
those of at least the config's score are written under `risks`, partitioned by the config's columns. A run
replaces the whole report by an equal one where the tables are the same.

    python -m jobs.impact_report --tables DIR --out OUT [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippletrace.operators import rules, scoring
from rippletrace.plans import testdata

LOG = logging.getLogger("jobs.impact_report")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "impact_report.json")
COLUMNS = ("rank", "id", "title", "category", "severity", "confidence", "score", "changed_node_id", "affected_node_id")


def run(spark: SparkSession, tables: str, out: str, config: dict) -> dict[str, int]:
    """Write the report; rows written, by severity."""
    changes, uses, nodes = testdata.part_changes(spark, tables), testdata.usage_edges(spark, tables), testdata.lineage_nodes(spark, tables)
    LOG.info("read %s changed fields and %s uses of %s", changes.count(), uses.count(), tables)
    ranked = scoring.rank(scoring.score(scoring.dedupe(rules.run(changes, uses, nodes))))
    kept = ranked.where(F.col("score") >= config["least_score"]).select(*COLUMNS)
    kept.write.partitionBy(*config["partition"]).mode("overwrite").parquet(f"{out.rstrip('/')}/risks")
    written = {r["severity"]: r["count"] for r in report(spark, out).groupBy("severity").count().collect()}
    LOG.info("wrote %s risks to %s", written, out)
    return written


def report(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out.rstrip('/')}/risks")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("--tables", required=True)
    args.add_argument("--out", required=True)
    args.add_argument("--config", default=CONFIG)
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO)
    with open(given.config, encoding="utf-8") as file:
        config = json.load(file)
    spark = SparkSession.builder.appName("impact_report").getOrCreate()
    try:
        run(spark, given.tables, given.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
