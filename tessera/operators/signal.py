"""Signal operators: transforms and aggregates of sampled channels.

Order-free aggregates are built-in expressions; transforms that need only
neighbours are windows; spectra and recursive filters run per channel in numpy
(a channel is one signal and must fit in a task).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AGGREGATES = {
    "mean": lambda x, t: F.avg(x),
    "std": lambda x, t: F.coalesce(F.stddev_samp(x), F.lit(0.0)),
    "var": lambda x, t: F.coalesce(F.var_samp(x), F.lit(0.0)),
    "rms": lambda x, t: F.sqrt(F.avg(x * x)),
    "peak": lambda x, t: F.max(x),
    "trough": lambda x, t: F.min(x),
    "peak_to_peak": lambda x, t: F.max(x) - F.min(x),
    "slope": lambda x, t: F.regr_slope(x, t),
    "skewness": lambda x, t: F.skewness(x),
    "kurtosis": lambda x, t: F.kurtosis(x),
    "energy": lambda x, t: F.sum(x * x),
}
ELEMENTWISE = {"abs": F.abs, "square": lambda x: x * x, "sqrt": F.sqrt, "log": F.log, "log10": F.log10, "exp": F.exp}


def transform(df: DataFrame, channel: str, order: list[str], value: str, name: str, *args: float) -> DataFrame:
    """``df`` with ``value`` replaced by the named transform of its channel."""
    w, whole = Window.partitionBy(channel).orderBy(*order), Window.partitionBy(channel)
    x = F.col(value)
    if name in ELEMENTWISE:
        out: Column = ELEMENTWISE[name](x)
    elif name == "scale":
        out = x * args[0]
    elif name == "offset":
        out = x + args[0]
    elif name == "diff":
        out = x - F.lag(x).over(w)
    elif name == "cumsum":
        out = F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif name == "zscore":
        sd = F.stddev_samp(x).over(whole)
        out = F.when(sd < 1e-10, 0.0).otherwise((x - F.avg(x).over(whole)) / sd)
    elif name == "detrend":
        if args and args[0] >= 1:
            i = F.row_number().over(w).cast("double")
            df = df.withColumn("_i", i)
            out = x - (F.regr_slope(x, F.col("_i")).over(whole) * F.col("_i") + F.regr_intercept(x, F.col("_i")).over(whole))
        else:
            out = x - F.avg(x).over(whole)
    elif name == "median":
        half = int(args[0]) // 2 if args else 1
        out = F.median(x).over(w.rowsBetween(-half, half))
    elif name == "decimate":
        df = df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % int(args[0]) == 0).drop("_n")
        out = x
    elif name in ("lowpass", "highpass", "bandpass", "notch", "envelope"):
        return _per_channel(df, channel, order, value, lambda v: spectral_filter(v, name, *args))
    else:
        raise ValueError(f"unknown transform {name}")
    return df.withColumn(value, out).drop("_i")


def spectral_filter(v: np.ndarray, name: str, *args: float) -> np.ndarray:
    """Zero-phase filters with arguments (sample rate, cut [, cut]), and the Hilbert envelope."""
    n = len(v)
    if n == 0:
        return v
    if name == "envelope":
        s, h = np.fft.fft(v), np.zeros(n)
        h[0] = 1
        h[1 : (n + 1) // 2] = 2
        if n % 2 == 0:
            h[n // 2] = 1
        return np.abs(np.fft.ifft(s * h))
    f, s = np.fft.rfftfreq(n, 1 / args[0]), np.fft.rfft(v)
    if name == "lowpass":
        gain = 1 / np.sqrt(1 + (f / args[1]) ** 8)
    elif name == "highpass":
        gain = np.where(f > 0, 1 / np.sqrt(1 + (args[1] / np.maximum(f, 1e-12)) ** 8), 0)
    elif name == "bandpass":
        gain = ((f >= args[1]) & (f <= args[2])).astype(float)
    else:
        gain = (np.abs(f - args[1]) > (args[2] if len(args) > 2 else 1.0)).astype(float)
    return np.fft.irfft(s * gain, n)


def _per_channel(df: DataFrame, channel: str, order: list[str], value: str, fn) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf[value] = fn(pdf[value].to_numpy(float))
        return pdf

    return df.groupBy(channel).applyInPandas(run, df.schema)


def zero_crossings(df: DataFrame, channel: str, order: list[str], value: str) -> DataFrame:
    """Sign changes of successive samples, zero counted as positive."""
    w = Window.partitionBy(channel).orderBy(*order)
    s = F.col(value) >= 0
    return df.withColumn("_c", (s != F.lag(s).over(w)).cast("long")).groupBy(channel).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("zero_crossings"))


def spectrum(df: DataFrame, channel: str, order: list[str], value: str, rate: float) -> DataFrame:
    """(channel, bin, frequency, power) of the real FFT of each channel."""
    kind = df.schema[channel].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].to_numpy(float)
        p = np.abs(np.fft.rfft(v)) ** 2 / max(len(v), 1)
        return pd.DataFrame({channel: [pdf[channel].iloc[0]] * len(p), "bin": np.arange(len(p)), "frequency": np.fft.rfftfreq(len(v), 1 / rate), "power": p})

    return df.select(channel, *[c for c in order if c != channel], value).groupBy(channel).applyInPandas(run, f"{channel} {kind}, bin long, frequency double, power double")


def spectral_summary(spec: DataFrame, channel: str) -> DataFrame:
    """Dominant frequency, centroid, entropy and flatness over the bins above zero."""
    s = spec.where("bin > 0").withColumn("_t", F.sum("power").over(Window.partitionBy(channel)))
    p = F.try_divide("power", "_t")
    return s.groupBy(channel).agg(
        F.max_by("frequency", F.struct("power", -F.col("bin"))).alias("dominant"),
        F.sum(F.col("frequency") * p).alias("centroid"),
        F.sum(F.when(p > 0, -p * F.log2(p)).otherwise(0.0)).alias("entropy"),
        F.try_divide(F.exp(F.avg(F.log(F.greatest("power", F.lit(1e-30))))), F.avg("power")).alias("flatness"),
    )


def taper(kind: str, i: Column, n: Column) -> Column:
    """Weight of sample ``i`` (from 0) of ``n`` in a window; 1 for a single sample."""
    x = 2 * math.pi * i / (n - 1)
    terms = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}
    if kind == "rectangular":
        return F.lit(1.0)
    if kind == "bartlett":
        return F.when(n == 1, 1.0).otherwise(1 - F.abs(2 * i / (n - 1) - 1))
    a, b, c = terms[kind]
    return F.when(n == 1, 1.0).otherwise(a - b * F.cos(x) + c * F.cos(2 * x))


def tapered(df: DataFrame, channel: str, order: list[str], value: str, kind: str) -> DataFrame:
    """``df`` with ``value`` of each channel multiplied by the window's weights; a channel is sorted, not gathered."""
    w = Window.partitionBy(channel)
    i = F.row_number().over(w.orderBy(*order)) - 1
    placed = df.withColumns({"_i": i, "_n": F.count("*").over(w)})
    return placed.withColumn(value, F.col(value) * taper(kind, F.col("_i"), F.col("_n"))).drop("_i", "_n")


def cross_correlation(left: DataFrame, right: DataFrame, time: str, value: str, max_lag: int) -> DataFrame:
    """(lag, r, n): Pearson's r of left(t) and right(t + lag) over common times, for whole lags up to ``max_lag``.

    The right samples are copied to each lag before an equality join by time,
    and the moments add up before the shuffle by lag.
    """
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    moved = right.select(F.col(time).alias("_t"), F.col(value).alias("_y"), lags).withColumn("_t", F.col("_t") - F.col("lag"))
    both = left.select(F.col(time).alias("_t"), F.col(value).alias("_x")).join(moved, "_t")
    return both.groupBy("lag").agg(F.corr("_x", "_y").alias("r"), F.count("*").alias("n"))


def repair_artefacts(df: DataFrame, channel: str, order: list[str], value: str, limit: float = 3.0) -> DataFrame:
    """``clean``: samples further than ``limit`` sample deviations from their channel's mean are drawn between their neighbours by position.

    Runs at the ends are null, as they have one neighbour only; ``artefact`` tells which samples were rejected.
    """
    sums = df.groupBy(F.col(channel).alias("_ch")).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    joined = df.join(sums, F.col(channel).eqNullSafe(F.col("_ch")), "left").drop("_ch")
    w = Window.partitionBy(channel).orderBy(*order)
    bad = F.coalesce(F.abs(F.col(value) - F.col("_m")) > limit * F.col("_s"), F.lit(False))
    rows = joined.withColumns({"artefact": bad, "_i": F.row_number().over(w)}).drop("_m", "_s")
    good, place = F.when(~F.col("artefact"), F.col(value)), F.when(~F.col("artefact"), F.col("_i"))
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(channel).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a frame to the end would be read again for each row
    rows = rows.withColumns({"_v0": F.last(good, True).over(back), "_i0": F.last(place, True).over(back), "_v1": F.last(good, True).over(ahead), "_i1": F.last(place, True).over(ahead)})
    drawn = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    return rows.withColumn("clean", F.when(F.col("artefact"), drawn).otherwise(F.col(value))).drop("_i", "_v0", "_i0", "_v1", "_i1")


def frequency_bins(spec: DataFrame, channel: str, low: float, high: float, count: int, logarithmic: bool = False) -> DataFrame:
    """(channel, window, power): a spectrum's power in ``count`` windows of [low, high), of equal width or equal ratio."""
    f = F.col("frequency")
    part = F.log(f / low) / math.log(high / low) if logarithmic else (f - low) / (high - low)
    window = F.least(F.floor(part * count), F.lit(count - 1)).cast("int")
    return spec.where((f >= low) & (f < high)).groupBy(channel, window.alias("window")).agg(F.sum("power").alias("power"))
