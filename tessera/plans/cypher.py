"""Cypher compiled to joins over node and edge tables; writes go to a ``GraphStore``.

MATCH and OPTIONAL MATCH with labels, property maps, typed, directed and
variable-length (``*a..b``, or open ``*a..``) relationships, WHERE, WITH, UNWIND, RETURN with
DISTINCT, aggregates (implicit grouping), ORDER BY, SKIP, LIMIT, and ``AS OF``.
Relationships of one MATCH are distinct, as in the language.
"""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import cut

_CLAUSE = re.compile(r"(?<!STARTS )(?<!ENDS )\b(OPTIONAL\s+MATCH|MATCH|WHERE|WITH|UNWIND|RETURN|ORDER\s+BY|SKIP|LIMIT)\b(?=(?:[^']*'[^']*')*[^']*$)", re.I)
_NODE = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)")
_EDGE = re.compile(r"(<?)-\s*(?:\[\s*(\w*)\s*(?::\s*([\w|]+))?\s*(\*\s*(\d*)\s*(\.\.)?\s*(\d*))?\s*\])?\s*-(>?)")
_AGG = re.compile(r"\b(count|sum|avg|min|max|collect)\s*\(", re.I)


def expression(text: str) -> str:
    """A Cypher expression as Spark SQL over columns named var_prop."""
    out = []
    for k, part in enumerate(re.split(r"('(?:[^']|'')*')", text)):
        if k % 2:
            out.append(part)
            continue
        part = re.sub(r"\b([A-Za-z_]\w*)\.(\w+)\b", r"`\1.\2`", part)
        part = re.sub(r"\bid\(\s*(\w+)\s*\)", r"`\1.id`", part, flags=re.I)
        part = re.sub(r"\bSTARTS\s+WITH\b", " STARTSWITH ", part, flags=re.I)
        part = re.sub(r"\bENDS\s+WITH\b", " ENDSWITH ", part, flags=re.I)
        part = re.sub(r"=~", " RLIKE ", part)
        part = re.sub(r"\bcollect\s*\(", "collect_list(", part, flags=re.I)
        out.append(part)
    text = "".join(out)
    for word, fn in (("STARTSWITH", "startswith"), ("ENDSWITH", "endswith"), ("CONTAINS", "contains")):
        text = re.sub(rf"(`[^`]+`|\w+)\s+{word}\s+('(?:[^']|'')*'|`[^`]+`)", rf"{fn}(\1, \2)", text, flags=re.I)
    text = re.sub(r"(`[^`]+`|\([^()]*\))\s+XOR\s+(`[^`]+`|\([^()]*\))", r"(\1 <> \2)", text, flags=re.I)
    return re.sub(r"\[([^\[\]]*)\]", r"array(\1)", text)


def split_top(text: str) -> list[str]:
    """Comma-separated parts outside brackets and strings."""
    parts, depth, quote, cur = [], 0, False, ""
    for c in text:
        if c == "'":
            quote = not quote
        if not quote:
            depth += c in "([{"
            depth -= c in ")]}"
        if c == "," and depth == 0 and not quote:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    return [p.strip() for p in [*parts, cur] if p.strip()]


class Cypher:
    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame):
        self.spark, self.nodes, self.edges = spark, nodes, edges.withColumn("_eid", self.identity(edges))
        self.rows: DataFrame | None = None
        self.n = 0

    @staticmethod
    def identity(edges: DataFrame):
        """Of each relationship: its id, or else its place among parallel ones."""
        if "id" in edges.columns:
            return F.xxhash64("id")
        same = Window.partitionBy("src", "dst", "type").orderBy(*[c for c in edges.columns if c not in ("src", "dst", "type")] or [F.lit(1)])
        return F.xxhash64("src", "dst", "type", F.row_number().over(same))

    def name(self, given: str) -> str:
        self.n += 1
        return given or f"_x{self.n}"

    def node(self, m: re.Match) -> tuple[str, DataFrame]:
        var = self.name(m[1])
        rows = self.nodes.where(F.col("label") == m[2]) if m[2] else self.nodes
        for item in split_top(m[3][1:-1]) if m[3] else []:
            k, v = item.split(":", 1)
            rows = rows.where(f"{k.strip()} = {v.strip()}")
        return var, rows.select(*[F.col(c).alias(f"{var}.{c}") for c in rows.columns])

    def attach(self, out: DataFrame | None, rows: DataFrame, var: str, at: str | None) -> DataFrame:
        """Join a node relation; ``at`` is the column that its id must equal."""
        key = f"{var}.id"
        if out is None:
            return rows
        if key in out.columns:
            kept = rows.select(F.col(f"`{key}`").alias("_k"))
            out = out.join(kept, F.col(f"`{key}`") == F.col("_k"), "left_semi")
            return out.where(F.col(f"`{at}`") == F.col(f"`{key}`")) if at else out
        if at:
            return out.join(rows, F.col(f"`{at}`") == F.col(f"`{key}`"))
        return out.crossJoin(rows)

    def pattern(self, text: str, out: DataFrame | None, used: list[str]) -> DataFrame:
        m = _NODE.match(text.strip())
        text = text.strip()
        var, rows = self.node(m)
        out = self.attach(out, rows, var, None)
        pos = m.end()
        while pos < len(text) and (e := _EDGE.match(text, pos)):
            m = _NODE.match(text, e.end())
            rel = self.name(e[2])
            pool = self.edges.where(F.col("type").isin(*e[3].split("|"))) if e[3] else self.edges
            ways = [("src", "dst")] if e[8] and not e[1] else [("dst", "src")] if e[1] and not e[8] else [("src", "dst"), ("dst", "src")]
            steps = None
            for a, b in ways:
                props = [F.col(c).alias(f"{rel}.{c}") for c in pool.columns if c != "_eid"] if not e[4] else []
                part = pool.select(F.col(a).alias(f"_{rel}_a"), F.col(b).alias(f"_{rel}_b"), F.array("_eid").alias(f"_{rel}_e"), *props)
                steps = part if steps is None else steps.union(part)
            if e[4]:
                low = int(e[5]) if e[5] else 1
                high = int(e[7]) if e[7] else (low if e[5] and not e[6] else None)
                steps = self.walks(steps, rel, low, high)
            out = out.join(steps, F.col(f"`{var}.id`") == F.col(f"_{rel}_a")).drop(f"_{rel}_a")
            for other in used:
                out = out.where(~F.arrays_overlap(F.col(f"_{rel}_e"), F.col(other)))
            used.append(f"_{rel}_e")
            var, rows = self.node(m)
            out = self.attach(out, rows, var, f"_{rel}_b").drop(f"_{rel}_b")
            pos = m.end()
        return out

    @staticmethod
    def walks(step: DataFrame, rel: str, low: int, high: int | None) -> DataFrame:
        """Paths of low to high steps that use no relationship twice; without ``high``, until a round adds none."""
        a, b, e = f"_{rel}_a", f"_{rel}_b", f"_{rel}_e"
        cur, out = step.select(a, b, e), None
        if low == 0:
            out = step.select(F.explode(F.array(a, b)).alias(a)).distinct().select(a, F.col(a).alias(b), F.array().cast("array<bigint>").alias(e))
        nxt = step.select(F.col(a).alias("_m"), F.col(b).alias("_nb"), F.col(e).alias("_ne"))
        for k in count(1):
            if k >= low:
                out = cur if out is None else out.union(cur)
            if high is not None and k >= high or high is None and cur.isEmpty():
                return out if out is not None else cur
            if high is None or k < high:
                cur = cur.join(nxt, (F.col(b) == F.col("_m")) & ~F.arrays_overlap(F.col(e), F.col("_ne"))).select(a, F.col("_nb").alias(b), F.concat(e, "_ne").alias(e))
                cur = cut(cur) if high is None else cur

    def project(self, body: str) -> None:
        distinct = bool(re.match(r"DISTINCT\b", body, re.I))
        body = re.sub(r"^DISTINCT\s+", "", body, flags=re.I)
        keys, aggs, order = [], [], []
        for item in split_top(body):
            m = re.match(r"(.*?)\s+AS\s+(\w+)$", item, re.I | re.S)
            e, alias = (m[1], m[2]) if m else (item, item.strip())
            if re.fullmatch(r"\w+", e.strip()) and f"{e.strip()}.id" in self.rows.columns:  # a whole node goes on with its properties
                cols = [c for c in self.rows.columns if c.startswith(f"{e.strip()}.")]
                names = [c if not m else alias + c[len(e.strip()) :] for c in cols]
                keys += [F.col(f"`{c}`").alias(n) for c, n in zip(cols, names)]
                order += names
                continue
            # a counted node or relationship is counted by its id
            e = re.sub(r"\bcount\(\s*(DISTINCT\s+)?(\w+)\s*\)", lambda m: f"count({m[1] or ''}{m[2]}.id)" if f"{m[2]}.id" in self.rows.columns and m[2] not in self.rows.columns else m[0], e, flags=re.I)
            (aggs if _AGG.search(e) else keys).append(F.expr(expression(e)).alias(alias))
            order.append(alias)
        if aggs:
            self.rows = (self.rows.groupBy(*keys).agg(*aggs)).select(*[f"`{c}`" for c in order])
        else:
            self.rows = self.rows.select(*keys)
        if distinct:
            self.rows = self.rows.distinct()

    def run(self, text: str) -> DataFrame:
        if m := re.search(r"\bAS\s+OF\s+('[^']*'|\d+)", text, re.I):
            test = f"valid_from <= {m[1]} AND valid_to > {m[1]}"
            self.nodes, self.edges = (d.where(test) if "valid_from" in d.columns else d for d in (self.nodes, self.edges))
            text = text[: m.start()] + text[m.end() :]
        parts = _CLAUSE.split(text.strip().rstrip(";"))[1:]
        for word, body in zip(parts[::2], parts[1::2]):
            word, body = re.sub(r"\s+", " ", word.upper()), body.strip()
            if word == "MATCH":
                used: list[str] = []
                for p in split_top(body):
                    self.rows = self.pattern(p, self.rows, used)
                self.rows = self.rows.drop(*used)
            elif word == "OPTIONAL MATCH":
                left, used = self.rows, []
                found = None
                self.rows = None
                for p in split_top(body):
                    found = self.pattern(p, found, used)
                found = found.drop(*used)
                on = [c for c in found.columns if c in left.columns and c.endswith(".id")]
                found = found.drop(*[c for c in found.columns if c in left.columns and c not in on])
                renamed = found.withColumnsRenamed({c: f"_o_{c}" for c in on})
                cond = None
                for c in on:
                    t = F.col(f"`{c}`") == F.col(f"`_o_{c}`")
                    cond = t if cond is None else cond & t
                self.rows = left.join(renamed, cond, "left").drop(*[f"_o_{c}" for c in on])
            elif word == "WHERE":
                self.rows = self.rows.where(expression(body))
            elif word in ("WITH", "RETURN"):
                self.project(body)
            elif word == "UNWIND":
                e, alias = re.match(r"(.*?)\s+AS\s+(\w+)$", body, re.I | re.S).groups()
                base = self.rows if self.rows is not None else self.spark.range(1).drop("id")
                self.rows = base.withColumn(alias, F.explode(F.expr(expression(e))))
            elif word == "ORDER BY":
                keys = []
                for item in split_top(body):
                    m = re.match(r"(.*?)(\s+DESC(?:ENDING)?|\s+ASC(?:ENDING)?)?$", item, re.I | re.S)
                    c = F.expr(f"`{m[1].strip()}`" if m[1].strip() in self.rows.columns else expression(m[1]))
                    keys.append(c.desc_nulls_first() if m[2] and "DESC" in m[2].upper() else c.asc_nulls_last())
                self.rows = self.rows.orderBy(*keys)
            elif word == "SKIP":
                self.rows = self.rows.offset(int(body))
            else:
                self.rows = self.rows.limit(int(body))
        return self.rows


def run_cypher(spark: SparkSession, text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of a query; it may start with ``LOAD CSV WITH HEADERS FROM 'path' AS row [FIELDTERMINATOR 'c']``, whose cells are texts."""
    cypher = Cypher(spark, nodes, edges)
    if m := re.match(r"\s*LOAD\s+CSV\s+WITH\s+HEADERS\s+FROM\s+'([^']*)'\s+AS\s+(\w+)(?:\s+FIELDTERMINATOR\s+'([^']+)')?", text, re.I):
        cells = spark.read.options(header=True, sep=m[3] or ",", quote='"', escape='"', multiLine=True).csv(m[1])
        cypher.rows, text = cells.toDF(*[f"{m[2]}.{c}" for c in cells.columns]), text[m.end() :]
    return cypher.run(text)


class GraphStore:
    """Nodes and relationships of a property graph kept as two tables, for reads and writes.

    ``CREATE``, ``MERGE`` of one node, ``MATCH ... SET``, ``REMOVE`` and
    ``[DETACH] DELETE`` make new snapshots; reads are ``run_cypher``. New
    properties are new columns, null where a node lacks them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        from tessera.plans.dml import Database

        self.spark, self.db = spark, Database(spark, folder)

    def load(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Start from nodes (id, label, properties) and edges (src, dst, type, properties), numbered by ``id``."""
        if "id" not in edges.columns:
            edges = edges.withColumn("id", F.row_number().over(Window.orderBy("src", "dst", "type")).cast("long"))
        for name, df in (("nodes", nodes), ("edges", edges)):
            self.db._commit(name, df, self.db._last(name))

    def _add(self, name: str, rows: list[dict]) -> None:
        """Append rows, whose values are SQL literals."""
        old, at = self.db.table(name), self.db._last(name)
        parts = [self.spark.range(1).select(*[F.expr(v).alias(k) for k, v in r.items()]) for r in rows]
        new = parts[0]
        for p in parts[1:]:
            new = new.unionByName(p, allowMissingColumns=True)
        known = {c: old.schema[c].dataType for c in old.columns}
        new = new.select(*[F.col(c).cast(known[c]).alias(c) if c in known else F.col(c) for c in new.columns])
        self.db._commit(name, old.unionByName(new, allowMissingColumns=True), at)

    def _next(self, name: str) -> int:
        return (self.db.table(name).agg(F.max("id")).first()[0] or 0) + 1

    @staticmethod
    def _node(m: re.Match) -> dict:
        props = (item.split(":", 1) for item in (split_top(m[3][1:-1]) if m[3] else []))
        return {"label": f"'{m[2]}'" if m[2] else "NULL", **{k.strip(): v.strip() for k, v in props}}

    def _create(self, body: str) -> int:
        first, nodes, edges, ids = self._next("nodes"), [], [], {}
        for pattern in split_top(body):
            text, pos, before, edge = pattern.strip(), 0, None, None
            while m := _NODE.match(text, pos):
                here = ids.get(m[1]) if m[1] else None
                if here is None:
                    here = first + len(nodes)
                    nodes.append({"id": str(here), **self._node(m)})
                    ids |= {m[1]: here} if m[1] else {}
                if edge is not None:
                    a, b = (here, before) if edge[1] else (before, here)
                    edges.append({"src": str(a), "dst": str(b), "type": f"'{edge[3]}'"})
                before, pos = here, m.end()
                edge = _EDGE.match(text, pos)
                if edge is None:
                    break
                pos = edge.end()
        self._add("nodes", nodes)
        if edges:
            at = self._next("edges")
            self._add("edges", [{"id": str(at + i), **e} for i, e in enumerate(edges)])
        return len(nodes) + len(edges)

    def run(self, text: str):
        """The rows of a read, or the number of nodes and relationships that a statement wrote."""
        text = text.strip().rstrip(";")
        if m := re.match(r"CREATE\s+(.*)$", text, re.I | re.S):
            return self._create(m[1])
        nodes = self.db.table("nodes")
        if m := re.match(r"MERGE\s+(.*)$", text, re.I | re.S):
            want = self._node(_NODE.match(m[1].strip()))
            missing = [k for k in want if k not in nodes.columns]
            found = [] if missing else nodes.where(" AND ".join(f"`{k}` <=> {v}" for k, v in want.items())).take(1)
            return 0 if found else self._create(m[1])
        m = re.match(r"(MATCH\b.*?)\b(SET|REMOVE|DETACH\s+DELETE|DELETE)\b(?=(?:[^']*'[^']*')*[^']*$)(.*)$", text, re.I | re.S)
        if not m:
            return run_cypher(self.spark, text, nodes, self.db.table("edges"))
        word, at = m[2].upper(), self.db._last("nodes")
        items = split_top(m[3])
        var = items[0].split(".")[0].split("=")[0].strip()
        hit = cut(run_cypher(self.spark, f"{m[1]} RETURN DISTINCT id({var}) AS hit", nodes, self.db.table("edges")))
        joined = nodes.join(hit, nodes["id"] == hit["hit"], "left")
        if word.endswith("DELETE"):
            edges, edges_at = self.db.table("edges"), self.db._last("edges")
            tied = edges.join(hit, (F.col("src") == F.col("hit")) | (F.col("dst") == F.col("hit")), "left_semi")
            if word == "DELETE" and not tied.isEmpty():
                raise ValueError("a node to delete has relationships")
            for end in ("src", "dst"):
                edges = edges.join(hit, F.col(end) == F.col("hit"), "left_anti")
            self.db._commit("edges", edges, edges_at)
            joined = joined.where("hit IS NULL")
        else:
            for item in items:
                name, _, value = item.partition("=")
                prop = name.split(".")[1].strip()
                value = F.expr(re.sub(rf"\b{var}\.(\w+)", r"`\1`", value)) if word == "SET" else F.lit(None)
                old = F.col(prop) if prop in joined.columns else F.lit(None)
                joined = joined.withColumn(prop, F.when(F.col("hit").isNotNull(), value).otherwise(old))
        self.db._commit("nodes", joined.drop("hit"), at)
        return hit.count()
