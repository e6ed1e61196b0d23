"""Structured Streaming pipelines over event streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, glob: str = "events*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder; ``ts`` becomes a timestamp for watermarks."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, failures and latency sum per window and type: tumbling, or sliding with ``slide``."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions per user: closed by a gap without events."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_sli(calls: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """Per window and tool: calls, failures, mean latency (calls: ts, tool, ok, latency)."""
    out = calls.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "tool").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.round(F.avg("latency"), 6).alias("avg_latency"))
    return out.select(F.col("w.start").alias("start"), "tool", "total", "failed", "avg_latency")


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rate_limited(events: DataFrame, key: str, limit: int = 100, seconds: int = 60) -> DataFrame:
    """key, ts, accepted: the sliding-window limit per key; the state holds at most ``limit`` times per key, and stays.
    Calls are taken in the order of their times within a micro-batch, and batch after batch in the order they arrive."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts")
        flags = []
        for t in pdf["ts"]:
            at = t.timestamp()
            window = [x for x in window if at - x < seconds]
            ok = len(window) < limit
            if ok:
                window.append(at)
            flags.append(ok)
        state.update((window,))
        yield pd.DataFrame({"key": [str(k[0])] * len(pdf), "ts": pdf["ts"], "accepted": flags})

    return events.groupBy(key).applyInPandasWithState(run, "key string, ts timestamp, accepted boolean", "window array<double>", "append", GroupStateTimeout.NoTimeout)


def new_against_baseline(stream: DataFrame, baseline: DataFrame, key: str, target: str, checkpoint: str):
    """Writes rows whose key is not in the baseline, batch by batch (exactly once per batch id)."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.join(baseline.select(key), key, "left_anti").write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and return what it gave, read from files below ``folder``.

    In append mode every batch writes its own part, again under the same name if it is repeated; in complete mode each
    batch replaces the whole result, so at the end windows and sessions still open are there too.
    """

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={epoch if mode == 'append' else 0}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
