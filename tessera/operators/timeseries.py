"""Time-series operators as DataFrame functions over (series keys, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Aggregations over a bucket; first and last are by time, the percentile takes the truncated index.
AGGREGATES = ("sum", "count", "mean", "min", "max", "first", "last", "stddev", "variance")


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def aggregate(kind: str, value: str, time: str, tie: str | None = None) -> Column:
    order = F.struct(time, tie) if tie else F.col(time)
    return {
        "sum": lambda: F.sum(value),
        "count": lambda: F.count(value),
        "mean": lambda: F.avg(value),
        "min": lambda: F.min(value),
        "max": lambda: F.max(value),
        "first": lambda: F.min_by(value, order),
        "last": lambda: F.max_by(value, order),
        "stddev": lambda: F.coalesce(F.stddev_samp(value), F.lit(0.0)),
        "variance": lambda: F.coalesce(F.var_samp(value), F.lit(0.0)),
    }[kind]()


def percentile_index(value: str, p: int) -> Column:
    """Value at the truncated index p/100 * (n - 1) of the sorted values.

    The index comes from exact counts per distinct value, which combine before
    the shuffle.
    """
    ordered = F.array_sort(F.collect_list(value))
    return F.get(ordered, F.floor((F.size(ordered) - 1) * (p / 100)).cast("int"))


def bucketed(df: DataFrame, keys: list[str], time: str, value: str, step_us: int, kinds=AGGREGATES, tie: str | None = None) -> DataFrame:
    """Epoch-aligned buckets ``floor(t / step) * step``; empty ones are left out."""
    b = (F.floor(micros(time) / step_us) * step_us).cast("long").alias("bucket")
    return df.groupBy(*keys, b).agg(*[aggregate(k, value, time, tie).alias(k) for k in kinds])


def downsampled(df: DataFrame, keys: list[str], time: str, value: str, step_us: int, kind: str = "mean") -> DataFrame:
    """Buckets aligned to the first point of each series."""
    first = df.groupBy(*keys).agg(F.min(micros(time)).alias("_t0"))
    joined = df.join(first, keys) if keys else df.crossJoin(first)
    b = (F.col("_t0") + F.floor((micros(time) - F.col("_t0")) / step_us) * step_us).cast("long").alias("bucket")
    return joined.groupBy(*keys, b).agg(aggregate(kind, value, time).alias("value"))


def in_range(df: DataFrame, time: str, start_us: int, end_us: int, closed: bool = True) -> DataFrame:
    """Points in [start, end], or in [start, end) when not ``closed``."""
    t = micros(time)
    return df.where((t >= start_us) & ((t <= end_us) if closed else (t < end_us)))


def filled(df: DataFrame, keys: list[str], time: str, value: str, step_us: int, kind: str = "mean", fill: str | float = "null") -> DataFrame:
    """Regular buckets from the first to the last of each series; ``fill``: none, null, previous, linear or a number."""
    base = bucketed(df, keys, time, value, step_us, [kind]).withColumnRenamed(kind, "value")
    if fill == "none":
        return base
    ends = base.groupBy(*keys).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    grid = ends.select(*keys, F.explode(F.sequence("a", "b", F.lit(step_us))).alias("bucket"))
    full = grid.join(base, [*keys, "bucket"], "left")
    w = Window.partitionBy(*keys).orderBy("bucket")
    if fill == "previous":
        return full.withColumn("value", F.last("value", True).over(w))
    if fill == "linear":
        back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
        at = F.when(F.col("value").isNotNull(), F.col("bucket"))
        t0, t1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
        v0, v1 = F.last("value", True).over(back), F.first("value", True).over(ahead)
        return full.withColumn("value", F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (F.col("bucket") - t0) / (t1 - t0)))
    return full if fill == "null" else full.withColumn("value", F.coalesce("value", F.lit(float(fill))))


def gaps(df: DataFrame, keys: list[str], time: str, longer_us: int, tie: str) -> DataFrame:
    """Pairs of successive points farther apart than ``longer_us``."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    t = micros(time)
    prev = F.lag(t).over(w)
    return df.select(*keys, prev.alias("gap_start"), t.alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") > longer_us)


def moving_average(df: DataFrame, keys: list[str], time: str, value: str, n: int, tie: str) -> DataFrame:
    """Mean of the last n points; the head is shorter."""
    w = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(-(n - 1), 0)
    return df.withColumn("moving_avg", F.avg(value).over(w))


def rate_of_change(df: DataFrame, keys: list[str], time: str, value: str, tie: str) -> DataFrame:
    """Change per millisecond from the previous point; NULL for the first and at equal times."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    dt = (micros(time) - F.lag(micros(time)).over(w)) / 1000
    return df.withColumn("rate", F.try_divide(F.col(value) - F.lag(value).over(w), dt))


def ewm(df: DataFrame, keys: list[str], time: str, value: str, decay: float, tie: str) -> DataFrame:
    """Last exponentially weighted mean of each series: s = decay * s + (1 - decay) * x, from the first value."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(time, tie, value))), lambda x: x[value])
    out = F.aggregate(F.slice("_xs", 2, F.size("_xs")), F.get("_xs", F.lit(0)), lambda s, x: s * decay + x * (1 - decay))
    return df.groupBy(*keys).agg(ordered.alias("_xs")).select(*keys, out.alias("ewm"))


def merged(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both series; the right one wins where both have a point."""
    l, r = left.select(*keys, F.col(value).alias("_l")), right.select(*keys, F.col(value).alias("_r"))
    return l.join(r, keys, "full").select(*keys, F.coalesce("_r", "_l").alias(value))


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, right_time: str, tie: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    Both sides are unioned and one running ``last`` per key carries the right
    row forward: one shuffle and sort, no pairs. ``tie`` orders right rows of
    equal time.
    """
    r = right.select(F.col(by).alias("_by"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*[c for c in right.columns]).alias("_right"), F.lit(None).alias("_left"), F.col(tie).cast("long").alias("_tie"))
    l = left.select(F.col(by).alias("_by"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_right"), F.struct(*left.columns).alias("_left"), F.lit(None).cast("long").alias("_tie"))
    w = Window.partitionBy("_by").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("_seen", F.last("_right", True).over(w)).where("_side = 1")
    names = [c for c in right.columns if c != by]
    return both.select("_left.*", *[F.col(f"_seen.{c}").alias(c if c not in left.columns else f"right_{c}") for c in names])


def overlap_join(left: DataFrame, right: DataFrame, bin_us: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows (start, end in microseconds, half-open) that overlap.

    Each interval goes to every time bin that it touches, bins are joined by
    equality, and a pair is given by the bin of the later start only, so it
    comes once.
    """
    keys = keys or []

    def binned(df: DataFrame, p: str) -> DataFrame:
        renamed = df.select(*keys, *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in keys])
        s, e = F.col(f"{p}start"), F.col(f"{p}end")
        return renamed.where(s < e).withColumn("_bin", F.explode(F.sequence(F.floor(s / bin_us), F.floor((e - 1) / bin_us))))

    both = binned(left, "l_").join(binned(right, "r_"), [*keys, "_bin"])
    start = F.greatest("l_start", "r_start")
    return both.where((start < F.least("l_end", "r_end")) & (F.floor(start / bin_us) == F.col("_bin"))).drop("_bin")


def bucket_counts(df: DataFrame, key: str, start: str, end: str, first_us: int, last_us: int, step_us: int) -> DataFrame:
    """(bucket, count, keys): rows whose [start, end) in microseconds overlaps each bucket of [first, last), and their distinct keys; empty buckets too.

    Null or empty intervals count nowhere.
    """
    buckets = df.sparkSession.range(first_us, last_us, step_us).withColumnRenamed("id", "bucket")
    a, b = F.col(start), F.col(end)
    low = F.greatest(F.floor((a - first_us) / step_us), F.lit(0)).cast("long")
    high = F.least(F.floor((b - 1 - first_us) / step_us), F.lit((last_us - 1 - first_us) // step_us)).cast("long")
    live = df.where((a < b) & (a < last_us) & (b > first_us)).select(F.col(key).alias("_k"), F.explode(F.sequence(low, high)).alias("_n"))
    counts = live.groupBy((F.col("_n") * step_us + first_us).alias("bucket"), "_k").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.groupBy("bucket").agg(F.sum("_c").alias("count"), F.count("_k").alias("keys"))
    return buckets.join(counts, "bucket", "left").na.fill(0, ["count", "keys"])


class PointStore:
    """Points (``ts`` and further columns) in folders by hour, so that ranges prune and retention deletes whole folders."""

    HOUR = 3_600_000_000

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, df: DataFrame) -> None:
        """Append points; hours that hold many are split over tasks."""
        hour = F.floor(micros("ts") / self.HOUR).cast("long")
        df.withColumn("hour", hour).hint("rebalance", F.col("hour")).write.mode("append").partitionBy("hour").parquet(self.folder)

    def range(self, start_us: int, end_us: int) -> DataFrame:
        """Points from start to end, both included."""
        rows = self.spark.read.parquet(self.folder).where(F.col("hour").between(start_us // self.HOUR, end_us // self.HOUR))
        return in_range(rows, "ts", start_us, end_us).drop("hour")

    def retain(self, now_us: int, keep_us: int) -> int:
        """Delete the hours that end at or before ``now - keep``; their number."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs, gone = at.getFileSystem(self.spark._jsc.hadoopConfiguration()), 0
        for f in fs.listStatus(at):
            name = f.getPath().getName()
            if name.startswith("hour=") and name[5:].lstrip("-").isdigit() and (int(name[5:]) + 1) * self.HOUR <= now_us - keep_us:
                gone += bool(fs.delete(f.getPath(), True))
        return gone

    def downsample(self, target: "PointStore", keys: list[str], value: str, step_us: int, kind: str, now_us: int, keep_us: int, target_keep_us: int) -> None:
        """A policy: hours that leave this store go to ``target`` as one value per key and bucket; both stores are then cut."""
        old = self.spark.read.parquet(self.folder).where((F.col("hour") + 1) * self.HOUR <= now_us - keep_us)
        small = bucketed(old, keys, "ts", value, step_us, [kind])
        target.write(small.select(F.timestamp_micros("bucket").alias("ts"), *keys, F.col(kind).alias(value)))
        self.retain(now_us, keep_us)
        target.retain(now_us, target_keep_us)
