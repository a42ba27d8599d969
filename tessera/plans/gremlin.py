"""Gremlin step chains compiled to joins over node and edge tables.

``nodes`` has id, label and property columns; ``edges`` has src, dst, type and
property columns. A traversal carries one element per row and the labels bound
by ``as``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*('(?:[^'\\]|\\.)*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|\w+|[().,])")
PREDICATES = {"eq": "=", "neq": "<>", "lt": "<", "gt": ">", "lte": "<=", "gte": ">="}


def parse(text: str) -> list[tuple[str, list]]:
    """[(step, args)] of ``g.V().out('x')...``; a nested call is an argument (name, args)."""
    tokens = [m[1] for m in _TOKEN.finditer(text.strip().rstrip(";"))]
    pos = 0

    def value():
        nonlocal pos
        t = tokens[pos]
        pos += 1
        if t[0] in "'\"":
            return t[1:-1]
        if re.fullmatch(r"-?\d+", t):
            return int(t)
        if re.fullmatch(r"-?\d+\.\d+", t):
            return float(t)
        name = t
        while pos < len(tokens) and tokens[pos] == ".":  # __.out() or P.gt(3)
            name = tokens[pos + 1]
            pos += 2
        if pos < len(tokens) and tokens[pos] == "(":
            return (name, args())
        return {"true": True, "false": False}.get(name, name)

    def args() -> list:
        nonlocal pos
        pos += 1
        out = []
        while tokens[pos] != ")":
            out.append(value())
            if tokens[pos] == ",":
                pos += 1
        pos += 1
        return out

    if tokens[0] != "g":
        raise ValueError("a traversal starts with g")
    pos, steps = 1, []
    while pos < len(tokens):
        if tokens[pos] != ".":
            raise ValueError(f"unexpected {tokens[pos]}")
        name = tokens[pos + 1]
        pos += 2
        steps.append((name, args()))
    return steps


class Traversal:
    """Rows with ``_id`` (node or value), ``_kind`` and one column per ``as`` label."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges
        self.rows: DataFrame | None = None
        self.kind, self.labels, self.last_group = "node", [], None

    def run(self, steps: list[tuple[str, list]]) -> DataFrame:
        i = 0
        while i < len(steps):
            name, args = steps[i]
            by = []
            while name in ("order", "group", "groupCount", "project") and i + 1 < len(steps) and steps[i + 1][0] == "by":
                by.append(steps[i + 1][1])
                i += 1
            getattr(self, f"s_{name}")(*args, **({"by": by} if by else {}))
            i += 1
        return self.result()

    def result(self) -> DataFrame:
        if self.kind == "table":
            return self.rows
        return self.rows.select(F.col("_id").alias("value"))

    def _props(self) -> DataFrame:
        """Rows joined with the columns of their node or edge."""
        if self.kind == "node":
            n = self.nodes.select(F.col("id").alias("_nid"), *[F.col(c).alias(f"p_{c}") for c in self.nodes.columns])
            return self.rows.join(n, self.rows["_id"] == n["_nid"]).drop("_nid")
        return self.rows

    def _keep(self) -> list[str]:
        return [c for c in self.rows.columns if not c.startswith("p_")]

    def s_V(self, *ids):
        rows = self.nodes if not ids else self.nodes.where(F.col("id").isin(*ids))
        self.rows, self.kind = rows.select(F.col("id").alias("_id")), "node"

    def s_E(self):
        self.rows = self.edges.select(F.concat_ws("->", "src", "dst").alias("_id"), *[F.col(c).alias(f"p_{c}") for c in self.edges.columns])
        self.kind = "edge"

    def _where(self, condition):
        keep = self._keep() if self.kind == "node" else self.rows.columns
        self.rows = self._props().where(condition).select(*keep)

    def _compare(self, col, v):
        if isinstance(v, tuple):
            op, args = v
            if op == "within":
                return col.isin(*args)
            if op == "without":
                return ~col.isin(*args)
            x = F.lit(args[0])
            return {"eq": col == x, "neq": col != x, "lt": col < x, "gt": col > x, "lte": col <= x, "gte": col >= x}[op]
        return col == F.lit(v)

    def s_hasLabel(self, *names):
        self._where(F.col("p_label" if self.kind == "node" else "p_type").isin(*names))

    def s_has(self, key, v=None):
        self._where(F.col(f"p_{key}").isNotNull() if v is None else self._compare(F.col(f"p_{key}"), v))

    def s_hasId(self, *ids):
        self.rows = self.rows.where(F.col("_id").isin(*ids))

    def _hop(self, a: str, b: str, types: tuple):
        e = self.edges.where(F.col("type").isin(*types)) if types else self.edges
        e = e.select(F.col(a).alias("_from"), F.col(b).alias("_to"))
        self.rows = self.rows.join(e, self.rows["_id"] == e["_from"]).drop("_id", "_from").withColumnRenamed("_to", "_id")
        self.kind = "node"

    def s_out(self, *types):
        self._hop("src", "dst", types)

    def s_in(self, *types):
        self._hop("dst", "src", types)

    def s_both(self, *types):
        rows = self.rows
        self._hop("src", "dst", types)
        forward, self.rows = self.rows, rows
        self._hop("dst", "src", types)
        self.rows = forward.unionByName(self.rows)

    def _edges(self, sides: list[tuple[str, str]], types: tuple):
        e = self.edges.where(F.col("type").isin(*types)) if types else self.edges
        parts = []
        for a in sides:
            x = e.select(F.col(a[0]).alias("_at"), *[F.col(c).alias(f"p_{c}") for c in e.columns], F.concat_ws("->", "src", "dst").alias("_new"), F.col(a[1]).alias("p__other"))
            parts.append(self.rows.join(x, self.rows["_id"] == x["_at"]).drop("_id", "_at").withColumnRenamed("_new", "_id"))
        self.rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        self.kind = "edge"

    def s_outE(self, *types):
        self._edges([("src", "dst")], types)

    def s_inE(self, *types):
        self._edges([("dst", "src")], types)

    def s_bothE(self, *types):
        self._edges([("src", "dst"), ("dst", "src")], types)

    def _vertex(self, col: str):
        keep = [c for c in self.rows.columns if not c.startswith("p_") and c != "_id"]
        self.rows, self.kind = self.rows.select(F.col(col).alias("_id"), *keep), "node"

    def s_inV(self):
        self._vertex("p_dst")

    def s_outV(self):
        self._vertex("p_src")

    def s_otherV(self):
        self._vertex("p__other")

    def s_values(self, *keys):
        rows = self._props()
        keep = [c for c in self._keep() if c != "_id"]
        parts = [rows.select(F.col(f"p_{k}").alias("_id"), *keep).where("_id is not null") for k in keys]
        out = parts[0]
        for p in parts[1:]:
            out = out.withColumn("_id", F.col("_id").cast("string")).unionByName(p.withColumn("_id", F.col("_id").cast("string")))
        self.rows, self.kind = out, "value"

    def s_valueMap(self, *keys):
        rows = self._props()
        names = keys or [c[2:] for c in rows.columns if c.startswith("p_")]
        self.rows, self.kind = rows.select(*[F.col(f"p_{k}").alias(k) for k in names]), "table"

    def s_id(self):
        self.kind = "value"

    def s_label(self):
        rows = self._props()
        self.rows, self.kind = rows.select(F.col("p_label" if self.kind == "node" else "p_type").alias("_id")), "value"

    def s_as(self, name):
        self.rows = self.rows.withColumn(f"@{name}", F.col("_id"))

    def s_select(self, *names):
        self.rows, self.kind = self.rows.select(*[F.col(f"`@{n}`").alias(n) for n in names]), "table"

    def s_where(self, predicate):
        self.rows = self.rows.where(self._compare(F.col("_id"), (predicate[0], [F.col(f"`@{a}`") if isinstance(a, str) and f"@{a}" in self.rows.columns else a for a in predicate[1]])))

    def s_is(self, v):
        self.rows = self.rows.where(self._compare(F.col("_id"), v))

    def _single(self, agg):
        self.rows, self.kind = self.rows.agg(agg.alias("_id")), "value"

    def s_count(self):
        self._single(F.count("*"))

    def s_sum(self):
        self._single(F.sum("_id"))

    def s_min(self):
        self._single(F.min("_id"))

    def s_max(self):
        self._single(F.max("_id"))

    def s_mean(self):
        self._single(F.avg("_id"))

    def s_fold(self):
        self._single(F.array_sort(F.collect_list("_id")))

    def s_unfold(self):
        self.rows = self.rows.select(F.explode("_id").alias("_id"))

    def s_dedup(self):
        self.rows = self.rows.dropDuplicates(["_id"] if self.kind != "table" else self.rows.columns)

    def s_limit(self, n):
        self.rows = self.rows.limit(n)

    def s_range(self, a, b):
        self.rows = self.rows.offset(a).limit(b - a)

    def _by(self, by):
        rows = self._props()
        key = by[0][0] if by and by[0] else None
        return rows, (F.col("_id") if key is None else F.col(f"p_{key}"))

    def s_order(self, by=None):
        rows, key = self._by(by or [[]])
        down = bool(by and len(by[0]) > 1 and by[0][1] in ("desc", "decr"))
        self.rows = rows.orderBy(key.desc_nulls_last() if down else key.asc_nulls_last(), "_id").select(*self._keep())

    def s_groupCount(self, by=None):
        rows, key = self._by(by or [[]])
        self.rows, self.kind = rows.groupBy(key.alias("key")).agg(F.count("*").alias("value")), "table"

    def s_group(self, by=None):
        rows, key = self._by(by or [[]])
        self.rows, self.kind = rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list("_id")).alias("value")), "table"

    def s_project(self, *names, by=None):
        rows = self._props()
        self.rows, self.kind = rows.select(*[F.col(f"p_{b[0]}").alias(n) for n, b in zip(names, by or [[n] for n in names])]), "table"

    def s_property(self, key, v):
        rows = self._props() if self.kind == "node" else self.rows
        self.rows = rows.withColumn(f"p_{key}", F.lit(v))


def run_gremlin(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return Traversal(nodes, edges).run(parse(text))
