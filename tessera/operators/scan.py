"""Recurrences along sorted rows, with a state per group that is carried from batch to batch.

Rows go to their group's task and are sorted there by Spark, which spills;
Python sees one Arrow batch at a time, so memory does not grow with a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: step(state, values of a run of rows of one group) -> (new state, output columns by name)
Step = Callable[[object, pd.DataFrame], tuple[object, dict[str, np.ndarray]]]


def scan_sorted(df: DataFrame, keys: list[str], order: list[str], outputs: str, start: Callable[[], object], step: Step) -> DataFrame:
    """``df`` with the columns of the schema text ``outputs``, computed in the order of each group.

    Null keys form a group; rows that tie in ``order`` may take either place,
    so give a column that breaks ties. Empty tables give empty results. The
    output names must not be among the columns of ``df``.
    """
    extra = StructType.fromDDL(outputs)
    clash = set(extra.names) & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    key = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
    mark = "_scan_key"
    while mark in df.columns:
        mark += "_"
    marked = df.withColumn(mark, key)
    dealt = marked.repartition(F.col(mark)) if keys else marked.repartition(1)
    rows = dealt.sortWithinPartitions(mark, *order)
    names = [*df.columns, *extra.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            marks = pdf[mark].to_numpy()
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1), len(pdf)]
            parts = []
            for a, b in zip(cuts, cuts[1:]):
                if marks[a] != last:
                    last, state = marks[a], start()
                state, columns = step(state, pdf.iloc[a:b])
                parts.append(pdf.iloc[a:b].assign(**columns))
            yield pd.concat(parts)[names]

    return rows.mapInPandas(run, StructType([*df.schema.fields, *extra.fields]))


def exponential(values: np.ndarray, weight: float, before: float | None) -> np.ndarray:
    """Exponential moving average; the first value of a group is its own average."""
    out = np.empty(len(values))
    for i, v in enumerate(values):
        before = v if before is None else v * weight + before * (1 - weight)
        out[i] = before
    return out


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, period: int, name: str = "ema") -> DataFrame:
    """Exponential moving average with weight 2 / (period + 1)."""

    def step(state, pdf):
        out = exponential(pdf[value].to_numpy(float), 2 / (period + 1), state)
        return out[-1], {name: out}

    return scan_sorted(df, keys, order, f"{name} double", lambda: None, step)


def macd(df: DataFrame, keys: list[str], order: list[str], value: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of a fast and a slow average, that difference's own average, and what is between the two."""

    def step(state, pdf):
        v = pdf[value].to_numpy(float)
        f, s = exponential(v, 2 / (fast + 1), state[0]), exponential(v, 2 / (slow + 1), state[1])
        line = f - s
        smooth = exponential(line, 2 / (signal + 1), state[2])
        return (f[-1], s[-1], smooth[-1]), {"macd": line, "signal": smooth, "histogram": line - smooth}

    return scan_sorted(df, keys, order, "macd double, signal double, histogram double", lambda: (None, None, None), step)


def rsi(df: DataFrame, keys: list[str], order: list[str], value: str, period: int = 14) -> DataFrame:
    """Relative strength by Wilder's smoothing; null until ``period`` changes are known, a ratio of 100 without losses."""

    def step(state, pdf):
        seen, before, gain, loss = state
        out = np.full(len(pdf), np.nan)
        for i, v in enumerate(pdf[value].to_numpy(float)):
            if before is not None:
                seen += 1
                up, down = max(v - before, 0.0), max(before - v, 0.0)
                if seen <= period:
                    gain, loss = gain + up / period, loss + down / period
                else:
                    gain, loss = (gain * (period - 1) + up) / period, (loss * (period - 1) + down) / period
                if seen >= period:
                    ratio = gain / loss if loss >= np.finfo(float).eps else 100.0
                    out[i] = 100 - 100 / (1 + ratio)
            before = v
        return (seen, before, gain, loss), {"rsi": out}

    scanned = scan_sorted(df, keys, order, "rsi double", lambda: (0, None, 0.0, 0.0), step)
    return scanned.withColumn("rsi", F.when(~F.isnan("rsi"), F.col("rsi")))


def bounded_sessions(df: DataFrame, keys: list[str], time_us: str, tie: str, gap_us: int, longest_us: int) -> DataFrame:
    """``df`` with ``session_start``: a session ends after a gap of more than ``gap_us`` or when a row lies ``longest_us`` or more after its start."""

    def step(state, pdf):
        begun, last = state
        out = np.empty(len(pdf), np.int64)
        for i, t in enumerate(pdf[time_us].to_numpy(np.int64)):
            if begun is None or t - last > gap_us or t - begun >= longest_us:
                begun = t
            out[i], last = begun, t
        return (begun, last), {"session_start": out}

    return scan_sorted(df.where(F.col(time_us).isNotNull()), keys, [time_us, tie], "session_start long", lambda: (None, None), step)


def landmark_windows(df: DataFrame, keys: list[str], time_us: str, tie: str, start: str, end: str) -> DataFrame:
    """Rows inside windows from a row for which the SQL predicate ``start`` holds to the next for which ``end`` holds, both included, with ``window_start``.

    A start inside an open window opens no other; a window without an end runs on.
    """
    marked = df.withColumns({"_opens": F.coalesce(F.expr(start), F.lit(False)), "_closes": F.coalesce(F.expr(end), F.lit(False))})

    def step(state, pdf):
        out = np.full(len(pdf), -1, np.int64)
        for i, (t, a, b) in enumerate(zip(pdf[time_us].to_numpy(np.int64), pdf["_opens"].to_numpy(bool), pdf["_closes"].to_numpy(bool))):
            if state < 0 and a:
                state = t
            out[i] = state
            if b:
                state = -1
        return state, {"window_start": out}

    times = marked.where(F.col(time_us) >= 0)
    return scan_sorted(times, keys, [time_us, tie], "window_start long", lambda: -1, step).where("window_start >= 0").drop("_opens", "_closes")
