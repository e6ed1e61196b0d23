"""Reports of findings: SARIF, text and JSON; append-only logs; published tables with a checksum."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: severity -> level of the SARIF format
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}


def sarif_results(violations: DataFrame, path: str, line: str) -> DataFrame:
    """One SARIF 2.1.0 result per violation, as JSON text (column ``result``)."""
    level = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.upper("severity")), F.lit("warning"))
    region = F.struct(F.greatest(F.coalesce(F.col(line).cast("int"), F.lit(1)), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col(path).cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return violations.select(F.to_json(result).alias("result"))


def write_sarif(violations: DataFrame, path: str, line: str, target: str, tool: str = "ledgerloom") -> None:
    """A folder with the results as JSON lines (``results``) and the run's envelope (``run.json``)."""
    sarif_results(violations, path, line).write.mode("overwrite").text(os.path.join(target, "results"))
    rules = [r.rule_id for r in violations.select("rule_id").distinct().orderBy("rule_id").limit(10_000).collect()]
    envelope = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": "results/"}]}
    violations.sparkSession.createDataFrame([(json.dumps(envelope),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(target, "run"))


def text_report(violations: DataFrame, path: str, line: str) -> DataFrame:
    """One readable line per violation."""
    return violations.select(F.format_string("%s:%d [%s] %s: %s", F.col(path).cast("string"), F.col(line).cast("int"), F.col("severity"), F.col("rule_id"), F.col("message")).alias("value"))


def append_log(rows: DataFrame, target: str) -> None:
    rows.write.mode("append").json(target)


def read_recent(spark: SparkSession, target: str, schema: str, n: int, order: str = "timestamp") -> DataFrame:
    """The n latest entries of an append-only log."""
    return spark.read.schema(schema).json(target).orderBy(F.col(order).desc()).limit(n)


def publish(df: DataFrame, target: str, meta: dict) -> str:
    """Write a table with a sidecar of its metadata and content checksum; returns the checksum.

    The checksum is a sum of row hashes, so it does not depend on the order or the files of the rows.
    """
    df.write.mode("overwrite").parquet(os.path.join(target, "data"))
    digest = content_hash(df.sparkSession.read.parquet(os.path.join(target, "data")))
    df.sparkSession.createDataFrame([(json.dumps(meta | {"checksum": digest}),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(target, "meta"))
    return digest


def content_hash(df: DataFrame) -> str:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{row.n}:{row.s}:{','.join(df.columns)}".encode()).hexdigest()


def load_published(spark: SparkSession, target: str, expected: dict | None = None) -> DataFrame | None:
    """The table if its checksum and the expected metadata hold, else None."""
    meta = json.loads(spark.read.text(os.path.join(target, "meta")).first().value)
    df = spark.read.parquet(os.path.join(target, "data"))
    if any(meta.get(k) != v for k, v in (expected or {}).items()) or content_hash(df) != meta["checksum"]:
        return None
    return df


# -- which files have changed, and which configurations there are
def stale_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """path, state ('new', 'changed', 'gone') of a listing (path, length, modificationTime) against the one kept before."""
    now = listing.select("path", F.struct("length", "modificationTime").alias("now"))
    then = known.select("path", F.struct("length", "modificationTime").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, "path", "full").select("path", state.alias("state")).where("state IS NOT NULL")


def registry_put(spark: SparkSession, target: str, name: str, path: str) -> None:
    """Add a configuration to the registry, or give it another path: an entry is appended, the latest one counts."""
    spark.createDataFrame([(name, path, False)], "name string, path string, removed boolean").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(target)


def registry_remove(spark: SparkSession, target: str, name: str) -> None:
    spark.createDataFrame([(name, None, True)], "name string, path string, removed boolean").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(target)


def registry_list(spark: SparkSession, target: str) -> DataFrame:
    """name, path of the configurations that are registered."""
    latest = spark.read.parquet(target).groupBy("name").agg(F.max_by(F.struct("path", "removed"), "at").alias("x"))
    return latest.where("NOT x.removed").select("name", "x.path")
