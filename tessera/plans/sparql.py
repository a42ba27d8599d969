"""SPARQL over a (subject, predicate, object) table, compiled to self-joins.

SELECT (DISTINCT, expressions, aggregates), ASK, CONSTRUCT, basic graph
patterns, OPTIONAL, UNION, MINUS, FILTER, BIND, GROUP BY, HAVING, ORDER BY,
LIMIT, OFFSET, PREFIX, and the property paths ``/ | ^ + * ?``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import cut

_TOKEN = re.compile(r"\s*(?:#[^\n]*)?\s*(\"[^\"]*\"|'[^']*'|<[^<>\s]*>|\?\w+|\^|[A-Za-z_][\w-]*:[\w./-]*|:[\w./-]+|-?\d+(?:\.\d+)?|&&|\|\||!=|<=|>=|\w+|[^\s\w])")


class Sparql:
    def __init__(self, spark: SparkSession, triples: DataFrame, text: str):
        self.spark, self.triples = spark, triples.select("subject", "predicate", "object")
        #: Variables that some rows leave unbound.
        self.unbound: set[str] = set()
        self.t, self.i, self.prefixes = [m[1] for m in _TOKEN.finditer(text)], 0, {}

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def word(self) -> str:
        return self.peek().upper()

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if want is not None and t.upper() != want:
            raise ValueError(f"expected {want}, found {t!r}")
        self.i += 1
        return t

    def term(self) -> str | tuple:
        t = self.take()
        if t[0] == "?":
            return t[1:]
        if t[0] == "<" or t[0] in "\"'":
            return ("const", t[1:-1])
        if ":" in t:
            p, _, rest = t.partition(":")
            return ("const", self.prefixes.get(p, "" if p == "" else p + ":") + rest)
        return ("const", t)

    # -- property paths give (s, o) relations
    def path(self) -> DataFrame:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = out.union(self.sequence())
        return out

    def sequence(self) -> DataFrame:
        out = self.step()
        while self.peek() == "/":
            self.take()
            nxt = self.step()
            out = out.withColumnRenamed("o", "_m").join(nxt.withColumnRenamed("s", "_m"), "_m").select("s", "o")
        return out

    def step(self) -> DataFrame:
        if self.peek() == "^":
            self.take()
            return self.step().select(F.col("o").alias("s"), F.col("s").alias("o"))
        if self.peek() == "(":
            self.take()
            out = self.path()
            self.take(")")
        else:
            name = "rdf:type" if self.peek() == "a" and self.take() else self.term()[1]
            out = self.triples.where(F.col("predicate") == name).select(F.col("subject").alias("s"), F.col("object").alias("o"))
        if self.peek() in ("+", "*", "?") and len(self.peek()) == 1:
            kind = self.take()
            own = self.triples.select(F.explode(F.array("subject", "object")).alias("s")).distinct().select("s", F.col("s").alias("o"))
            out = out.distinct() if kind == "?" else self.closure(out)
            out = out if kind == "+" else out.union(own).distinct()
        return out

    @staticmethod
    def closure(pairs: DataFrame) -> DataFrame:
        base = cut(pairs.distinct())
        seen = delta = base
        while not delta.isEmpty():
            step = delta.withColumnRenamed("o", "_m").join(base.withColumnRenamed("s", "_m"), "_m").select("s", "o").distinct()
            delta = cut(step.join(seen, ["s", "o"], "left_anti"))
            seen = seen.union(delta)
        return seen

    def pattern(self) -> DataFrame:
        """One subject with its ``;`` and ``,`` lists."""
        out, subject = None, self.term()
        while True:
            if self.peek()[:1] == "?" and len(self.peek()) > 1:
                p = self.take()[1:]
                rel = self.triples.select(F.col("subject").alias("s"), F.col("predicate").alias("_p"), F.col("object").alias("o"))
            else:
                p, rel = None, self.path()
            while True:
                out = self.join(out, self.bind(rel, subject, p, self.term()))
                if self.peek() != ",":
                    break
                self.take()
            if self.peek() != ";":
                return out
            self.take()

    @staticmethod
    def bind(rel: DataFrame, s, p, o) -> DataFrame:
        cols, rows = {}, rel
        for t, c in ((s, "s"), (p, "_p"), (o, "o")):
            if t is None:
                continue
            if isinstance(t, tuple):
                rows = rows.where(F.col(c) == F.lit(t[1]))
            elif t in cols:
                rows = rows.where(F.col(c) == F.col(cols[t]))
            else:
                cols[t] = c
        return rows.select(*[F.col(c).alias(v) for v, c in cols.items()]) if cols else rows.select(F.lit(1).alias("_one")).distinct()

    def join(self, a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
        """Compatible rows: shared variables are equal, or unbound (after OPTIONAL or UNION) on a side, which then takes the other's value."""
        if a is None:
            return b
        on = [c for c in b.columns if c in a.columns and c != "_one"]
        if how == "left_anti" and not on:
            return a  # MINUS without a shared variable removes nothing
        b = b.drop("_one") if "_one" in b.columns and "_one" in a.columns else b
        if not on:
            return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
        if not self.unbound & set(on):
            return a.join(b, on, how)
        right = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
        fits, both = F.lit(True), F.lit(False)
        for c in on:
            equal = F.col(c) == F.col(f"_r_{c}")
            fits &= equal | F.col(c).isNull() | F.col(f"_r_{c}").isNull() if c in self.unbound else equal
            both |= F.coalesce(equal, F.lit(False))
        if how == "left_anti":
            return a.join(right, fits & both, how)
        out = a.join(right, fits, how)
        return out.withColumns({c: F.coalesce(c, f"_r_{c}") for c in on}).drop(*[f"_r_{c}" for c in on])

    def group(self) -> DataFrame:
        self.take("{")
        out, filters = None, []
        while self.peek() != "}":
            w = self.word()
            if w == "OPTIONAL":
                self.take()
                before = set(out.columns) if out is not None else set()
                part = self.group()
                out = self.join(out, part, "left")
                self.unbound |= set(part.columns) - before
            elif w == "MINUS":
                self.take()
                out = self.join(out, self.group(), "left_anti")
            elif w == "FILTER":
                self.take()
                filters.append(self.expression(")" if self.peek() == "(" else None))
            elif w == "BIND":
                self.take()
                self.take("(")
                e = self.until("AS")
                self.take("AS")
                out = out.withColumn(self.take()[1:], F.expr(e))
                self.take(")")
            elif self.peek() == "{":
                part = self.select() if self.peek(1).upper() == "SELECT" else self.group()
                while self.word() == "UNION":
                    self.take()
                    other = self.group()
                    self.unbound |= set(part.columns) ^ set(other.columns)
                    part = part.unionByName(other, allowMissingColumns=True)
                out = self.join(out, part)
            else:
                out = self.join(out, self.pattern())
            if self.peek() == ".":
                self.take()
        self.take("}")
        for f in filters:
            out = out.where(f)
        return out

    def sql_token(self) -> str:
        t = self.take()
        if t[0] == "?":
            return t[1:]
        if t[0] == "<" and len(t) > 1 and t[-1] == ">" or (":" in t and t[0] not in "\"'"):
            self.i -= 1
            return "'" + self.term()[1].replace("'", "''") + "'"
        if t[0] == '"':
            return "'" + t[1:-1].replace("'", "''") + "'"
        low = {"&&": "AND", "||": "OR", "!": "NOT ", "REGEX": "regexp_like", "STR": "string", "BOUND": "isnotnull", "STRSTARTS": "startswith", "STRENDS": "endswith", "CONTAINS": "contains", "STRLEN": "length", "UCASE": "upper", "LCASE": "lower", "SAMPLE": "any_value", "GROUP_CONCAT": "listagg", "IRI": "string"}
        return low.get(t.upper(), t)

    def until(self, *stops: str) -> str:
        out, depth = [], 0
        while depth or (self.word() not in stops):
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            out.append(self.sql_token())
        return " ".join(out)

    def expression(self, _close=None) -> str:
        """A parenthesised expression, or a function call."""
        out, depth = [], 0
        while True:
            depth += {"(": 1, ")": -1}.get(self.peek(), 0)
            out.append(self.sql_token())
            if depth == 0 and out[-1] == ")":
                return " ".join(out)

    def select(self) -> DataFrame:
        braced = self.peek() == "{"
        if braced:
            self.take()
        self.take("SELECT")
        distinct = self.word() == "DISTINCT" and bool(self.take())
        items = []
        while self.word() not in ("WHERE", "{"):
            if self.peek() == "(":
                self.take()
                e = self.until("AS")
                self.take("AS")
                items.append((e, self.take()[1:]))
                self.take(")")
            else:
                t = self.take()
                items.append((None, t[1:]) if t != "*" else (None, "*"))
        if self.word() == "WHERE":
            self.take()
        rows = self.group()
        keys, having, order, limit, offset = [], None, [], None, 0
        while self.word() in ("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET"):
            w = self.take().upper()
            if w in ("GROUP", "ORDER"):
                self.take("BY")
                while self.peek()[:1] == "?" or self.word() in ("ASC", "DESC"):
                    if w == "GROUP":
                        keys.append(self.take()[1:])
                    elif self.word() in ("ASC", "DESC"):
                        down = self.take().upper() == "DESC"
                        e = self.expression()
                        order.append(F.expr(e).desc_nulls_last() if down else F.expr(e).asc_nulls_first())
                    else:
                        order.append(F.col(self.take()[1:]).asc_nulls_first())
            elif w == "HAVING":
                having = self.expression()
            elif w == "LIMIT":
                limit = int(self.take())
            else:
                offset = int(self.take())
        if keys or any(e and re.match(r"(count|sum|avg|min|max|any_value|listagg)\s*\(", e, re.I) for e, _ in items):
            aggs = [F.expr(e).alias(n) for e, n in items if e]
            grouped = rows.groupBy(*keys)
            rows = grouped.agg(*aggs, *([F.expr(having).alias("_having")] if having else []))
            rows = rows.where("_having").drop("_having") if having else rows
        elif items and items[0][1] != "*":
            rows = rows.withColumns({n: F.expr(e) for e, n in items if e})
        if order and not distinct:
            rows = rows.orderBy(*order)
        if items and items[0][1] != "*":
            rows = rows.select(*[n for _, n in items])
        rows = rows.distinct() if distinct else rows
        rows = rows.orderBy(*order) if order and distinct else rows
        rows = rows.offset(offset) if offset else rows
        rows = rows.limit(limit) if limit is not None else rows
        if braced:
            self.take("}")
        return rows.drop("_one") if "_one" in rows.columns else rows

    def run(self) -> DataFrame:
        while self.word() == "PREFIX":
            self.take()
            name = self.take()
            if not name.endswith(":") and self.peek() == ":":
                self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]
        if self.word() == "ASK":
            self.take()
            if self.word() == "WHERE":
                self.take()
            return self.group().limit(1).agg((F.count("*") > 0).alias("result"))
        if self.word() == "CONSTRUCT":
            self.take()
            self.take("{")
            made = []
            while self.peek() != "}":
                s, p, o = self.term(), (("const", "rdf:type") if self.peek() == "a" and self.take() else self.term()), self.term()
                made.append((s, p, o))
                if self.peek() == ".":
                    self.take()
            self.take("}")
            if self.word() == "WHERE":
                self.take()
            rows, out = self.group(), None
            for triple in made:
                part = rows.select(*[(F.lit(t[1]) if isinstance(t, tuple) else F.col(t)).cast("string").alias(n) for t, n in zip(triple, ("subject", "predicate", "object"))])
                out = part if out is None else out.union(part)
            return out.distinct()
        return self.select()


def run_sparql(spark: SparkSession, text: str, triples: DataFrame) -> DataFrame:
    return Sparql(spark, triples, text).run()
