"""Streaming operators; each takes a streaming or a batch DataFrame of events."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed weights of engagement events.
HALF_LIFE_S, DECAY = 300.0, 0.693


def event_stream(spark: SparkSession, path: str, like: DataFrame, name: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """A file stream over Parquet with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(path)


def tumbling(events: DataFrame, width: str, keys: list[str], aggs: list[Column], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and aggregates per window (sliding with ``slide``); rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.unix_micros("w.start").alias("window_start"), *[c for c in out.columns if c != "w"])


def sessions(events: DataFrame, gap: str, keys: list[str], aggs: list[Column], late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.unix_micros("w.start").alias("session_start"), F.unix_micros("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def trending(events: DataFrame, item: str, now_us: int, k: int) -> DataFrame:
    """Top k by count in 24 h, decayed by the age of the last event; momentum compares the last minute with the hour's mean."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))

    def within(seconds: int) -> Column:
        return F.count(F.when((t > now_us - seconds * 1_000_000) & (t <= now_us), 1))

    c = events.groupBy(item).agg(within(60).alias("n_1m"), within(300).alias("n_5m"), within(3600).alias("n_1h"), within(86400).alias("n_24h"), F.max(F.when(t <= now_us, t)).alias("last"))
    age = (F.lit(now_us) - F.col("last")) / 1e6
    score = F.col("n_24h") * F.exp(-DECAY / HALF_LIFE_S * age)
    momentum = F.coalesce(F.try_divide(F.col("n_1m"), F.col("n_1h") / 60), F.lit(0.0))
    return c.select(item, "n_1m", "n_5m", "n_1h", "n_24h", score.alias("score"), momentum.alias("momentum")).where("n_24h > 0").orderBy(F.col("score").desc(), item).limit(k)


def engagement(kind: Column, value: Column) -> Column:
    """Weight of an engagement event by its type and magnitude."""
    return (
        F.when(kind == "watch", value * 3)
        .when(kind == "like", 2.0)
        .when(kind == "share", 2.5)
        .when(kind == "skip", F.when(value < 2, -1.0).otherwise(-0.5))
        .when(kind == "search", 1.0)
        .when(kind == "impression", 0.1)
        .when(kind == "scroll", F.when(value > 5, -0.3).otherwise(0.0))
        .otherwise(0.0)
    )


def glob_to_regex(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def change_feed(changes: DataFrame, operations: list[str] | None = None, key_glob: str | None = None, tables: list[str] | None = None, after: int | None = None) -> DataFrame:
    """Change events filtered by operation, key pattern and table, after a resume token (event id)."""
    out = changes
    if operations:
        out = out.where(F.col("operation").isin(*operations))
    if key_glob:
        out = out.where(F.col("key").rlike(glob_to_regex(key_glob)))
    if tables:
        out = out.where(F.col("table").isin(*tables))
    return out if after is None else out.where(F.col("id") > after)


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a streaming query over all available input into a table in memory, for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def merge_counters(parts: DataFrame) -> DataFrame:
    """Grow-only counters (counter, replica, n): the maximum per replica, then the sum."""
    return parts.groupBy("counter", "replica").agg(F.max("n").alias("n")).groupBy("counter").agg(F.sum("n").alias("value"))


def decay_at(seconds: float) -> float:
    return math.exp(-DECAY / HALF_LIFE_S * seconds)
