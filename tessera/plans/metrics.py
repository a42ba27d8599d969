"""InfluxQL and PromQL over event tables, and CQL and GraphQL reads."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import timeseries as ts

UNITS = {"us": 1, "u": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def duration_us(text: str) -> int:
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(us|ms|u|s|m|h|d|w)", text))


def run_influx(text: str, tables: dict[str, DataFrame], time: str = "ts") -> DataFrame:
    """``SELECT f(field) [AS x] FROM m [WHERE ...] [GROUP BY time(i), tags] [FILL(...)]``; time is in microseconds."""
    m = re.match(r"\s*SELECT\s+(?P<s>.*?)\s+FROM\s+(?P<t>\w+)(?:\s+WHERE\s+(?P<w>.*?))?(?:\s+GROUP\s+BY\s+(?P<g>.*?))?(?:\s+FILL\s*\(\s*(?P<f>\w+)\s*\))?(?:\s+LIMIT\s+(?P<l>\d+))?\s*;?\s*$", text, re.I | re.S)
    if not m:
        raise ValueError("not an InfluxQL select")
    df = tables[m["t"]]
    if m["w"]:
        where = re.sub(r"\btime\b", f"unix_micros(cast({time} as timestamp))", m["w"], flags=re.I)
        where = re.sub(r"\b(\d+(?:us|ms|s|m|h|d|w))\b", lambda x: str(duration_us(x[1])), where)
        where = re.sub(r"now\(\)", "unix_micros(current_timestamp())", where, flags=re.I)
        df = df.where(where)
    fns = {"MEAN": F.avg, "SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_samp}
    aggs = []
    for item in re.findall(r"(\w+)\(\s*(\w+)\s*(?:,\s*(\d+)\s*)?\)(?:\s+AS\s+(\w+))?", m["s"], re.I):
        name = item[3] or item[0].lower()
        if item[0].upper() == "PERCENTILE":
            aggs.append(ts.percentile_index(item[1], int(item[2])).alias(name))
        elif item[0].upper() in ("FIRST", "LAST"):
            aggs.append((F.min_by if item[0].upper() == "FIRST" else F.max_by)(item[1], time).alias(name))
        else:
            aggs.append(fns[item[0].upper()](item[1]).alias(name))
    names = [a._jc.toString().split(" AS ")[-1].strip("`") for a in aggs]
    step, tags = None, []
    for g in (x.strip() for x in re.split(r",(?![^()]*\))", m["g"] or "") if x.strip()):
        if t := re.match(r"time\(\s*(\w+)\s*\)", g, re.I):
            step = duration_us(t[1])
        else:
            tags.append(g)
    if step is None:
        return df.groupBy(*tags).agg(*aggs)
    out = df.groupBy(*tags, (F.floor(ts.micros(time) / step) * step).cast("long").alias("time")).agg(*aggs)
    fill = (m["f"] or "none").lower()
    if fill != "none":
        ends = out.groupBy(*tags).agg(F.min("time").alias("a"), F.max("time").alias("b"))
        grid = ends.select(*tags, F.explode(F.sequence("a", "b", F.lit(step))).alias("time"))
        out = grid.join(out, [*tags, "time"], "left")
        if fill == "previous":
            w = Window.partitionBy(*tags).orderBy("time")
            out = out.withColumns({n: F.last(n, True).over(w) for n in names})
        elif fill != "null":
            out = out.withColumns({n: F.coalesce(n, F.lit(float(fill))) for n in names})
    return out.orderBy("time", *tags).limit(int(m["l"])) if m["l"] else out


_OVER_TIME = {
    "avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop,
    "last": lambda c: F.max_by(c, "ts"), "present": lambda c: F.lit(1.0) + F.count(c) * 0,
}
_INSTANT = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "ln": F.log, "log2": F.log2, "log10": F.log10, "sgn": F.signum,
    "round": lambda c, to=1.0: F.floor(c / F.lit(float(to)) + 0.5) * F.lit(float(to)),
    "clamp_min": lambda c, low: F.greatest(c, F.lit(float(low))), "clamp_max": lambda c, high: F.least(c, F.lit(float(high))),
    "clamp": lambda c, low, high: F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))),
}
_STEPPED = ("rate", "increase", "delta", "irate", "idelta", "changes", "resets")
_RANGED = (*_STEPPED, "deriv", "predict_linear", "quantile_over_time", *(f"{k}_over_time" for k in _OVER_TIME))
_GROUPED = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop, "group": lambda c: F.lit(1.0) + F.count(c) * 0}


def _arguments(text: str) -> list[str]:
    """Arguments of a call, cut at commas outside brackets and strings."""
    out, depth, quote, at = [], 0, False, 0
    for i, c in enumerate(text):
        quote ^= c == '"'
        depth += 0 if quote else (c in "([{") - (c in ")]}")
        if c == "," and not depth and not quote:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def run_promql(text: str, samples: DataFrame, at_us: int, lookback_us: int = 300_000_000) -> DataFrame:
    """An instant query over samples (metric, labels as columns, ts, value).

    Selectors with label matchers; over ranges rate, increase, delta, irate,
    idelta, changes, resets, deriv, predict_linear and the ``_over_time``
    functions; over instant vectors arithmetic functions; aggregations ``by``
    labels, quantile, topk and bottomk. Range windows are (at - range, at];
    counter resets are added back; an instant vector has the last sample of
    ``lookback_us``. Any other function is an error.
    """
    text = text.strip()
    again = lambda t: run_promql(t, samples, at_us, lookback_us)
    if m := re.fullmatch(r"(topk|bottomk|quantile)\s*(?:by\s*\(([^)]*)\))?\s*\(\s*([\d.]+)\s*,\s*(.*)\)", text, re.S):
        rows = again(m[4])
        keys = [c for c in rows.columns if c != "value"]
        by = [x.strip() for x in (m[2] or "").split(",") if x.strip()]
        if m[1] == "quantile":
            return rows.groupBy(*by).agg(F.percentile("value", F.lit(float(m[3]))).alias("value"))
        order = [F.col("value").desc() if m[1] == "topk" else F.col("value"), *keys]
        if by:
            return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= int(m[3])).drop("_r")
        return rows.orderBy(*order).limit(int(m[3]))
    if m := re.fullmatch(rf"({'|'.join(_GROUPED)})\s*(?:by\s*\(([^)]*)\))?\s*\((.*)\)", text, re.S):
        rows = again(m[3])
        by = [x.strip() for x in (m[2] or "").split(",") if x.strip()]
        return rows.groupBy(*by).agg(_GROUPED[m[1]]("value").alias("value"))
    fn, args = None, []
    if m := re.fullmatch(r"(\w+)\s*\((.*)\)", text, re.S):
        fn, args = m[1], _arguments(m[2])
        if fn in _INSTANT:
            return again(args[0]).withColumn("value", _INSTANT[fn](F.col("value"), *args[1:]))
        if fn not in _RANGED:
            raise ValueError(f"unknown function {fn}")
        text = args[1] if fn == "quantile_over_time" else args[0]
    m = re.fullmatch(r"(\w+)\s*(?:\{([^}]*)\})?\s*(?:\[(\w+)\])?", text)
    if not m:
        raise ValueError(f"cannot parse {text}")
    if bool(fn) != bool(m[3]):
        raise ValueError(f"{fn} needs a range" if fn else "a range needs a function")
    df = samples.where(F.col("metric") == m[1])
    for k, op, v in re.findall(r"(\w+)\s*(=~|!~|!=|=)\s*\"([^\"]*)\"", m[2] or ""):
        c = F.col(k)
        df = df.where({"=": c == v, "!=": c != v, "=~": c.rlike(f"^(?:{v})$"), "!~": ~c.rlike(f"^(?:{v})$")}[op])
    labels = [c for c in df.columns if c not in ("metric", "ts", "value")]
    t = ts.micros("ts")
    width = duration_us(m[3]) if m[3] else lookback_us
    inside = df.where((t <= at_us) & (t > at_us - width))
    if not fn:
        return inside.groupBy(*labels).agg(F.max_by("value", "ts").alias("value"))
    if fn == "quantile_over_time":
        return inside.groupBy(*labels).agg(F.percentile("value", F.lit(float(args[0]))).alias("value"))
    if fn.endswith("_over_time"):
        return inside.groupBy(*labels).agg(_OVER_TIME[fn[: -len("_over_time")]](F.col("value")).alias("value"))
    if fn in ("deriv", "predict_linear"):
        x = (t - at_us) / 1e6
        slope, level = F.regr_slope(F.col("value"), x), F.regr_intercept(F.col("value"), x)
        ahead = slope if fn == "deriv" else level + slope * float(args[1])
        return inside.groupBy(*labels).agg(ahead.alias("value"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    w = Window.partitionBy(*labels).orderBy("ts")
    prev = F.lag("value").over(w)
    reset = F.col("value") < prev
    if fn in ("changes", "resets"):
        odd = F.coalesce((reset if fn == "resets" else F.col("value") != prev).cast("double"), F.lit(0.0))
        return inside.withColumn("_d", odd).groupBy(*labels).agg(F.sum("_d").alias("value"))
    step = F.when(prev.isNull(), 0.0).when(reset & F.lit(fn in ("rate", "increase", "irate")), F.col("value")).otherwise(F.col("value") - prev)
    stepped = inside.withColumns({"_d": step, "_s": (t - F.lag(t).over(w)) / 1e6})
    if fn in ("irate", "idelta"):
        last = stepped.groupBy(*labels).agg(F.max_by(F.struct("_d", "_s"), "ts").alias("_l"), F.count("*").alias("_n")).where("_n > 1")
        return last.select(*labels, (F.col("_l._d") / F.col("_l._s") if fn == "irate" else F.col("_l._d")).alias("value"))
    total = stepped.groupBy(*labels).agg(F.sum("_d").alias("value"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return total.withColumn("value", F.col("value") / (width / 1e6)) if fn == "rate" else total


def cql_to_sql(text: str, keys: dict[str, tuple[list[str], list[str]]] | None = None) -> str:
    """CQL reads as Spark SQL: no-op clauses go, quoted keyspaces are dropped.

    ``keys`` has each table's partition and clustering columns, by which ``PER PARTITION LIMIT`` counts.
    """
    out = re.sub(r"\bALLOW\s+FILTERING\b", "", text, flags=re.I)
    out = re.sub(r"\bUSING\s+(?:TTL|TIMESTAMP)\s+\d+(?:\s+AND\s+(?:TTL|TIMESTAMP)\s+\d+)*", "", out, flags=re.I)
    out = re.sub(r"\bFROM\s+\w+\.(\w+)", r"FROM \1", out, flags=re.I)
    if m := re.search(r"\bPER\s+PARTITION\s+LIMIT\s+(\d+)", out, re.I):
        out = out[: m.start()] + out[m.end() :]
        name = re.search(r"\bFROM\s+(\w+)", out, re.I)[1]
        if name not in (keys or {}):
            raise ValueError(f"PER PARTITION LIMIT needs the keys of {name}")
        parts, order = keys[name]
        tail = re.search(r"\bORDER\s+BY\s+(.*?)(?=\bLIMIT\b|;|$)", out, re.I | re.S)
        by = tail[1].strip() if tail else ", ".join(order or parts)
        at = re.search(r"\bORDER\s+BY\b|\bLIMIT\b|;|$", out, re.I).start()
        out = f"{out[:at]} QUALIFY row_number() OVER (PARTITION BY {', '.join(parts)} ORDER BY {by}) <= {m[1]} {out[at:]}"
    out = re.sub(r"(\w+)\s+CONTAINS\s+('(?:[^']|'')*'|\d+)", r"array_contains(\1, \2)", out, flags=re.I)
    return re.sub(r"\bsystem\.", "", out).strip().rstrip(";")


def run_cql(spark: SparkSession, text: str, keys: dict[str, tuple[list[str], list[str]]] | None = None) -> DataFrame:
    from tessera.plans.sql import rewrite_qualify

    return spark.sql(rewrite_qualify(cql_to_sql(text, keys)))


_GQL = re.compile(r"\s*(\"[^\"]*\"|\.\.\.|-?\d+(?:\.\d+)?|\$?\w+|[{}()\[\]:@,!])")


class GraphQL:
    """Queries over tables: arguments filter, orderBy, limit, offset; aliases, fragments, variables, @include/@skip.

    ``links`` maps (table, field) to (other table, own key, other key, many).
    """

    def __init__(self, tables: dict[str, DataFrame], links: dict[tuple[str, str], tuple[str, str, str, bool]], variables: dict | None = None):
        self.tables, self.links, self.vars = tables, links, variables or {}

    def parse(self, text: str) -> list[dict]:
        t = [m[1] for m in _GQL.finditer(re.sub(r"#[^\n]*", "", text))]
        i, fragments, main = 0, {}, None

        def value():
            nonlocal i
            x = t[i]
            i += 1
            if x == "{":
                out = {}
                while t[i] != "}":
                    k = t[i]
                    i += 2
                    out[k] = value()
                    if t[i] == ",":
                        i += 1
                i += 1
                return out
            if x[0] == "$":
                return self.vars[x[1:]]
            return json.loads(x) if x[0] in "\"-0123456789" else {"true": True, "false": False, "null": None}.get(x, x)

        def fields() -> list[dict]:
            nonlocal i
            i += 1
            out = []
            while t[i] != "}":
                if t[i] == "...":
                    i += 1
                    if t[i] == "on":
                        i += 2
                        out += fields()
                    else:
                        out.append({"spread": t[i]})
                        i += 1
                    continue
                f = {"name": t[i], "alias": t[i], "args": {}, "fields": None, "keep": True}
                i += 1
                if t[i] == ":":
                    f["name"] = t[i + 1]
                    i += 2
                if t[i] == "(":
                    i += 1
                    while t[i] != ")":
                        k = t[i]
                        i += 2
                        f["args"][k] = value()
                        if t[i] == ",":
                            i += 1
                    i += 1
                while t[i] == "@":
                    kind = t[i + 1]
                    i += 5  # @ name ( if :
                    flag = value()
                    i += 1
                    f["keep"] &= flag if kind == "include" else not flag
                if t[i] == "{":
                    f["fields"] = fields()
                if t[i] == ",":
                    i += 1
                if f["keep"]:
                    out.append(f)
            i += 1
            return out

        while i < len(t):
            if t[i] == "fragment":
                name = t[i + 1]
                i += 4
                fragments[name] = fields()
            else:
                while t[i] != "{":
                    i += 1
                main = fields()

        def expand(fs):
            out = []
            for f in fs:
                if "spread" in f:
                    out += expand(fragments[f["spread"]])
                else:
                    f["fields"] = expand(f["fields"]) if f["fields"] else None
                    out.append(f)
            return out

        return expand(main)

    def select(self, name: str, f: dict, extra: list[str]) -> DataFrame:
        df, args = self.tables[name], f["args"]
        for k, v in (args.get("filter") or {}).items():
            if isinstance(v, dict):
                for op, x in v.items():
                    c = F.col(k)
                    df = df.where({"eq": c == x, "ne": c != x, "gt": c > x, "lt": c < x, "gte": c >= x, "lte": c <= x, "contains": c.contains(str(x))}[op])
            else:
                df = df.where(F.col(k) == v)
        nested = [g for g in f["fields"] if g["fields"]]
        keys = list(dict.fromkeys([*extra, *[self.links[name, g["name"]][1] for g in nested]]))
        plain = [F.col(g["name"]).alias(g["alias"]) for g in f["fields"] if not g["fields"]]
        order = args.get("orderBy")
        if order:
            for k, d in (order.items() if isinstance(order, dict) else [(order, "ASC")]):
                df = df.orderBy(F.col(k).desc() if str(d).upper() == "DESC" else F.col(k))
        if "offset" in args:
            df = df.offset(args["offset"])
        if "limit" in args:
            df = df.limit(args["limit"])
        out = df.select(*plain, *[F.col(k).alias(f"_k_{k}") for k in keys])
        for g in nested:
            other, own, theirs, many = self.links[name, g["name"]]
            sub = self.select(other, g, [theirs])
            cols = [x["alias"] for x in g["fields"]]
            item = F.struct(*cols)
            rows = sub.groupBy(F.col(f"_k_{theirs}").alias("_j")).agg((F.array_sort(F.collect_list(item)) if many else F.any_value(item)).alias(g["alias"]))
            out = out.join(rows, out[f"_k_{own}"] == rows["_j"], "left").drop("_j")
        return out.select(*[f["alias"] for f in f["fields"]], *[f"_k_{k}" for k in extra])

    def run(self, text: str) -> DataFrame:
        """The rows of the first root field."""
        f = self.parse(text)[0]
        return self.select(f["name"], f, [])
