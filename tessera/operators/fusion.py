"""Alignment of signals to events and fusion of several signals into one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scan import scan_sorted


def epochs(samples: DataFrame, events: DataFrame, keys: list[str], pre_us: int, post_us: int) -> DataFrame:
    """Samples (keys, t, value) around events (keys, event, at): (keys, event, offset, value) for offsets in [-pre, post).

    Joined by bins as wide as an epoch, so a sample meets events of two bins at most.
    """
    width = pre_us + post_us
    low, high = F.floor((F.col("at") - pre_us) / width), F.floor((F.col("at") + post_us - 1) / width)
    e = events.select(*keys, "event", "at", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("_bin"))
    s = samples.select(*keys, "t", "value", F.floor(F.col("t") / width).cast("long").alias("_bin"))
    near = e.join(s, [*keys, "_bin"]).where((F.col("t") >= F.col("at") - pre_us) & (F.col("t") < F.col("at") + post_us))
    return near.select(*keys, "event", (F.col("t") - F.col("at")).alias("offset"), "value")


def epoch_mean(aligned: DataFrame, keys: list[str], step_us: int, kind: str = "mean") -> DataFrame:
    """(keys, offset, value): ``mean`` or ``median`` across epochs by offset in steps, or ``grand_mean``: the mean of the epochs' own means."""
    at = (F.floor(F.col("offset") / step_us) * step_us).cast("long").alias("offset")
    if kind == "grand_mean":
        own = aligned.groupBy(*keys, "event", at).agg(F.avg("value").alias("value"))
        return own.groupBy(*keys, "offset").agg(F.avg("value").alias("value"))
    return aligned.groupBy(*keys, at).agg((F.median if kind == "median" else F.avg)("value").alias("value"))


def weighted(df: DataFrame, values: list[str], weights: list[float]) -> DataFrame:
    """``fused``: the weighted mean of the values that are there; null where none is."""
    total = sum((F.when(F.col(v).isNotNull(), F.col(v) * w).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    share = sum((F.when(F.col(v).isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    return df.withColumn("fused", F.try_divide(total, share))


def complementary(df: DataFrame, keys: list[str], order: list[str], rate: str, level: str, alpha: float) -> DataFrame:
    """``fused``: alpha of what ``rate`` adds to the last estimate and the rest of ``level``; a group starts at its first level."""

    def step(state, pdf):
        out = np.empty(len(pdf))
        for i, (r, v) in enumerate(zip(pdf[rate].to_numpy(float), pdf[level].to_numpy(float))):
            state = v if state is None else alpha * (state + r) + (1 - alpha) * v
            out[i] = state
        return state, {"fused": out}

    return scan_sorted(df, keys, order, "fused double", lambda: None, step)


def kalman(df: DataFrame, keys: list[str], order: list[str], values: list[str], noise: list[float], drift: float) -> DataFrame:
    """``fused`` and its ``variance``: a random walk of variance ``drift`` a step, measured by several sensors of variances ``noise``.

    Null measurements are left out; a group is null up to its first measurement.
    """

    def step(state, pdf):
        x, p = state
        out = np.full((2, len(pdf)), np.nan)
        columns = [pdf[v].to_numpy(float) for v in values]
        for i in range(len(pdf)):
            p = p if x is None else p + drift
            for column, r in zip(columns, noise):
                z = column[i]
                if np.isnan(z):
                    continue
                if x is None:
                    x, p = z, r
                else:
                    gain = p / (p + r)
                    x, p = x + gain * (z - x), (1 - gain) * p
            if x is not None:
                out[:, i] = x, p
        return (x, p), {"fused": out[0], "variance": out[1]}

    scanned = scan_sorted(df, keys, order, "fused double, variance double", lambda: (None, 0.0), step)
    return scanned.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("fused", "variance")})
