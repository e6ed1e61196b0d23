"""Service-level indicators, code metrics, verdicts and quota operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: service-level objective (p99 in ms, error share, success share)
SLO = {"p99": 5000.0, "errors": 0.05, "success": 0.95}
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def nth_values(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, Column]) -> DataFrame:
    """keys and, per name, the value at a 0-based position of the sorted values (the position may use ``n``, the count).

    Works on the histogram of values, so a key that holds a third of all rows is no larger than its different values.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    cum = hist.withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return cum.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") > p, F.col(value))).alias(name) for name, p in points.items()))


def sli(calls: DataFrame, tool: str, ok: Column, latency: str) -> DataFrame:
    """Per tool: total, failures, error and success rate, average, p50 (sorted[n//2]) and p99 (sorted[int(n*0.99)])."""
    base = calls.select(F.col(tool).alias("tool"), ok.alias("ok"), F.col(latency).alias("latency"))
    sums = base.groupBy("tool").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.round(F.avg("latency"), 6).alias("avg_latency")
    )
    spots = nth_values(base, ["tool"], "latency", {"p50": F.floor(F.col("n") / 2), "p99": F.floor(F.col("n") * 0.99)})
    rate = F.col("failed") / F.col("total")
    return sums.join(spots, "tool", "left").select("tool", "total", "failed", F.round(rate, 6).alias("error_rate"), F.round(1 - rate, 6).alias("success_rate"), "avg_latency", "p50", "p99")


def slo_check(indicators: DataFrame) -> DataFrame:
    """Which objectives each tool meets; a tool without calls meets all."""
    empty = F.col("total") == 0
    return indicators.select(
        "tool", (empty | (F.col("p99") < SLO["p99"])).alias("latency_ok"), (empty | (F.col("error_rate") < SLO["errors"])).alias("errors_ok"), (empty | (F.col("success_rate") > SLO["success"])).alias("success_ok")
    )


def verdict(violations: DataFrame, subject: str, severity: str, rule: str) -> DataFrame:
    """Per subject: counts by severity, verdict (errors, warnings, ready) and the three gravest rules."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.upper(F.col(severity)))
    per = violations.groupBy(subject, F.upper(F.col(severity)).alias("severity"), F.col(rule).alias("rule"), rank.alias("r")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(subject).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("r") <= 2, F.col("n")).otherwise(0)).alias("must_fix"),
        F.when(F.min("r") <= 2, "errors").otherwise("warnings").alias("verdict"),
        F.slice(F.transform(F.array_sort(F.collect_set(F.struct("r", "rule"))), lambda x: x["rule"]), 1, 3).alias("top3"),
    )


def rate_limit(events: DataFrame, key: str, ts: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """events with ``accepted``: a call is accepted if fewer than ``limit`` accepted calls of its key lie in the window
    before it.  Rejected calls do not count, so the decision depends on the order of the calls; null times are refused.

    After a pause as long as the window nothing before it matters: a key's calls fall into stretches without such a pause,
    found by a window on the JVM, and each stretch is read for itself, holding at most ``limit`` times.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", accepted boolean"
    order = [ts, *[c for c in events.columns if c not in (key, ts)]]
    w = Window.partitionBy(key).orderBy(*order)
    pause = F.coalesce(F.col(ts).cast("timestamp").cast("double") - F.lag(ts).over(w).cast("timestamp").cast("double") >= seconds, F.lit(True))
    parts = events.withColumn("__new", F.when(pause, 1).otherwise(0)).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, []
        for b in batches:
            flags = []
            for k, part, t in zip(b[key], b["__part"], b[ts]):
                if (k, part) != current:
                    current, window = (k, part), []
                if pd.isna(t):
                    flags.append(False)
                    continue
                window = [x for x in window if (t - x).total_seconds() < seconds]
                ok = len(window) < limit
                if ok:
                    window.append(t)
                flags.append(ok)
            yield b.drop(columns="__part").assign(accepted=flags)

    return parts.repartition(key, "__part").sortWithinPartitions(key, "__part", *order).mapInPandas(run, schema)


def ttl_fifo(items: DataFrame, owner: str, ts: str, tie: str, now: Column, ttl_seconds: int = 3600, cap: int = 20) -> DataFrame:
    """What is left of each owner's items: not older than the time to live, and of those the newest ``cap``."""
    alive = items.where(F.col(ts) >= F.timestamp_add("SECOND", F.lit(-ttl_seconds), now))
    w = Window.partitionBy(owner).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return alive.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


# fixed values: keywords that open a branch, for cyclomatic complexity
BRANCHES = r"(?iu)(?<![\p{L}\p{N}_.])(если|иначеесли|для|пока|исключение|и|или|не|if|elsif|for|while|except|and|or|not)(?![\p{L}\p{N}_])"


def code_metrics(code: DataFrame, key: str, text: str) -> DataFrame:
    """Per file: lines total, code, comment, blank; methods; cyclomatic complexity (1 + branch words outside comments)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+", ""))
    comment = F.size(F.filter(trimmed, lambda x: x.startswith("//")))
    blank = F.size(F.filter(trimmed, lambda x: F.regexp_replace(x, r"\s", "") == ""))
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r'//[^\r\n]*|"[^"\r\n]*"', "")
    methods = F.regexp_count(bare, F.lit(r"(?imU)^\s*(процедура|функция|procedure|function)\s+\w"))
    return code.select(
        key,
        F.size(lines).cast("bigint").alias("total"),
        (F.size(lines) - comment - blank).cast("bigint").alias("code"),
        comment.cast("bigint").alias("comment"),
        blank.cast("bigint").alias("blank"),
        methods.cast("bigint").alias("methods"),
        (1 + F.regexp_count(bare, F.lit(BRANCHES))).cast("bigint").alias("cyclomatic"),
    )


def health(metrics: DataFrame) -> DataFrame:
    """metrics with issues and a health score: 100 less points for a god object and for complexity."""
    god = (F.col("total") > 1000) | (F.col("methods") > 50)
    score = 100 - F.when(god, 30).otherwise(0) - F.least(F.lit(10), F.greatest(F.lit(0), F.col("cyclomatic") - 10))
    issues = F.filter(F.array(F.when(god, F.lit("god_object")), F.when(F.col("cyclomatic") > 15, F.lit("high_complexity"))), lambda x: x.isNotNull())
    return metrics.withColumn("issues", issues).withColumn("health", score.cast("bigint"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """One row: files, sums and averages of the code metrics, and the hours of debt (an hour for each oversized file, five
    minutes for each branch over ten)."""
    god = (F.col("total") > 1000) | (F.col("methods") > 50)
    debt = F.sum(F.when(god, 60).otherwise(0) + 5 * F.greatest(F.lit(0), F.col("cyclomatic") - 10))
    sums = [F.sum(c).alias(c) for c in ("total", "code", "comment", "blank", "methods", "cyclomatic")]
    return metrics.agg(F.count(F.lit(1)).alias("files"), *sums, F.round(F.avg("cyclomatic"), 4).alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.round(debt / 60, 4).alias("debt_hours"))


def duplicate_blocks(code: DataFrame, key: str, text: str, size: int = 6) -> DataFrame:
    """Blocks of ``size`` consecutive code lines (without blank and comment lines) that occur more than once in the table:
    block hash, occurrences, files.  Blocks are hashed where they are read; only hashes are shuffled, partly summed."""
    kept = F.filter(F.transform(F.split(F.col(text), r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~x.startswith("//"))
    blocks = F.transform(F.sequence(F.lit(1), F.size("k") - size + 1), lambda i: F.xxhash64(F.array_join(F.slice("k", i, size), "\n")))
    hashed = code.where(F.col(text).isNotNull()).select(key, kept.alias("k")).where(F.size("k") >= size).select(key, F.explode(blocks).alias("block"))
    per_file = hashed.groupBy("block", key).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("block").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("files")).where("occurrences > 1")


def duplicates_per_file(code: DataFrame, key: str, text: str, size: int = 6) -> DataFrame:
    """key, n: how many blocks of ``size`` code lines of a file are copies of an earlier one in it; the last block of a file
    is not looked at."""
    kept = F.filter(F.transform(F.split(F.col(text), r"\r\n|\n|\r"), F.trim), lambda x: (x != "") & ~x.startswith("//"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size("k") - size, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("k", i, size), "\n")))
    held = code.where(F.col(text).isNotNull()).select(key, kept.alias("k")).where(F.size("k") > size).select(key, blocks.alias("b"))
    return held.select(key, (F.size("b") - F.size(F.array_distinct("b"))).alias("n")).where("n > 0")
