"""Structured Streaming jobs over event tables; each runs to the end of what is there and can be resumed from its checkpoint.

The watermarks and windows are this engine's own choice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from palimpsest.sources.storage import shared_dir


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream."""
    return read_table(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream; its name may be a file or a folder."""
    stream = spark.readStream.schema(spark.read.option("recursiveFileLookup", "true").parquet(path).schema).option("recursiveFileLookup", "true")
    return stream.parquet(f"{path.rstrip('/')}*")


def run_available(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what is available into a Parquet table of the shared folder, and read that table.

    Complete results overwrite the table in each micro-batch, appended ones are added.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/palimpsest/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if batch is None and mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(batch or (lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out"))).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def daily_counts(events: DataFrame) -> DataFrame:
    """Events and value by UTC day and type, as a running result."""
    return events.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding_counts(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "2 days").groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "8 hours") -> DataFrame:
    return events.withWatermark("ts", "2 days").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame) -> DataFrame:
    """The first event of each (user, type) within the watermark."""
    return events.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])


def token_bucket(events: DataFrame, rate_per_hour: float = 0.05, capacity: float = 2.0) -> DataFrame:
    """(user_id, allowed, refused): each event takes a token; tokens refill evenly up to the capacity; state is kept per user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at, allowed, refused = state.get if state.exists else (capacity, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts in rows["ts"].astype("int64") / 3.6e12 if str(rows["ts"].dtype).startswith("datetime64[ns") else rows["ts"].astype("int64") / 3.6e9:
            tokens = min(capacity, tokens + (0.0 if at is None else max(0.0, ts - at) * rate_per_hour))
            at = ts
            if tokens >= 1:
                tokens, allowed = tokens - 1, allowed + 1
            else:
                refused += 1
        state.update((float(tokens), float(at), int(allowed), int(refused)))
        yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "refused": [refused]})

    return events.select("user_id", "ts", "event_id").groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, allowed bigint, refused bigint", "tokens double, at double, allowed bigint, refused bigint", "update", "NoTimeout")


def circuit_breaker(events: DataFrame, failures: int = 3, within_s: float = 86_400.0, open_s: float = 43_200.0) -> DataFrame:
    """(user_id, opened, rejected): a breaker opens after so many errors within a span, rejects while open, and closes on the
    first success after it; an error then opens it again."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, until, opened, rejected = state.get if state.exists else ("", 0.0, 0, 0)
        times = [float(x) for x in recent.split(",") if x]
        rows = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        for sec, bad in zip(rows["sec"], rows["bad"], strict=True):
            if sec < until:
                rejected += 1
                continue
            half_open = until > 0
            if not bad:
                times, until = [], 0.0
                continue
            times = [x for x in times if sec - x <= within_s] + [sec]
            if half_open or len(times) >= failures:
                times, until, opened = [], sec + open_s, opened + 1
        state.update((",".join(map(repr, times)), float(until), int(opened), int(rejected)))
        yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "rejected": [rejected]})

    rows = events.select("user_id", "event_id", F.col("ts").cast("double").alias("sec"), (F.col("event_type") == "error").alias("bad"))
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, opened bigint, rejected bigint", "recent string, until double, opened bigint, rejected bigint", "update", "NoTimeout")
