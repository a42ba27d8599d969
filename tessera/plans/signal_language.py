"""The signal language: FROM, WHERE, TRANSFORM, WINDOW, AGGREGATE, INTERPRET, CORRELATE.

``FROM table CHANNEL c TIME t VALUE v`` names the signals;
``TRANSFORM zscore, scale(2)`` applies in order; ``WINDOW TUMBLING 1h`` or
``SLIDING 1h 15m`` groups by time; ``AGGREGATE mean AS m, rms`` summarises;
``INTERPRET mean > 10 AS 'high' SEVERITY 2`` adds text and severity.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import signal
from tessera.operators.timeseries import micros
from tessera.plans.metrics import duration_us

_WORDS = r"FROM|WHERE|TRANSFORM|WINDOW|AGGREGATE|INTERPRET|RETURNING"


def clauses(text: str) -> dict[str, list[str]]:
    parts = re.split(rf"\b({_WORDS})\b(?=(?:[^']*'[^']*')*[^']*$)", text.strip().rstrip(";"))[1:]
    out: dict[str, list[str]] = {}
    for k, v in zip(parts[::2], parts[1::2]):
        out.setdefault(k.upper(), []).append(v.strip())
    return out


def run_signal(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    c = clauses(text)
    source = re.match(r"(\w+)(?:\s+CHANNEL\s+(\w+))?(?:\s+TIME\s+(\w+))?(?:\s+VALUE\s+(\w+))?(?:\s+ORDER\s+(\w+))?$", c["FROM"][0], re.I)
    df, channel, time, value = tables[source[1]], source[2] or "channel", source[3] or "ts", source[4] or "value"
    order = [time] + ([source[5]] if source[5] else [])
    for w in c.get("WHERE", []):
        df = df.where(w)
    for step in re.findall(r"(\w+)(?:\(([^)]*)\))?", ",".join(c.get("TRANSFORM", []))):
        df = signal.transform(df, channel, order, value, step[0].lower(), *[float(x) for x in step[1].split(",") if x.strip()])
    keys = [F.col(channel)]
    for w in c.get("WINDOW", []):
        kind, *sizes = w.split()
        if kind.upper() == "SESSION":
            keys.append(F.session_window(F.col(time).cast("timestamp"), f"{duration_us(sizes[0])} microseconds").alias("_w"))
        else:
            args = [f"{duration_us(s)} microseconds" for s in sizes]
            keys.append(F.window(F.col(time).cast("timestamp"), *args).alias("_w"))
    aggs = []
    x, t = F.col(value).cast("double"), micros(time) / 1e6
    for item in re.findall(r"(\w+)(?:\s*\(\s*(\d+)\s*\))?(?:\s+AS\s+(\w+))?", ",".join(c.get("AGGREGATE", [])), re.I):
        name = item[0].lower()
        if name == "percentile":  # the nearest index
            s = F.array_sort(F.collect_list(x))
            e = F.get(s, F.round((F.size(s) - 1) * (int(item[1]) / 100)).cast("int"))
        else:
            e = signal.AGGREGATES[name](x, t)
        aggs.append(e.alias(item[2] or name))
    out = df
    if aggs:
        out = df.groupBy(*keys).agg(*aggs)
        if "_w" in out.columns:
            out = out.select(channel, F.unix_micros("_w.start").alias("window_start"), *[c_ for c_ in out.columns if c_ not in (channel, "_w")])
    for rule in c.get("INTERPRET", []):
        m = re.match(r"(.*?)\s+AS\s+'([^']*)'(?:\s+SEVERITY\s+(\d+))?$", rule, re.I | re.S)
        text_ = F.when(F.expr(m[1]), F.lit(m[2]))
        rank = F.when(F.expr(m[1]), F.lit(int(m[3] or 1)))
        out = out.withColumn("interpretation", F.coalesce("interpretation", text_) if "interpretation" in out.columns else text_)
        out = out.withColumn("severity", F.coalesce("severity", rank) if "severity" in out.columns else rank)
    return out
