"""Datalog: parser, stratification and semi-naive evaluation over DataFrames.

Facts, conjunctive rules, recursion, stratified negation, comparisons, ``_``,
arithmetic in comparisons, and head aggregates count/sum/min/max/avg. A base
predicate is a table whose columns bind by position.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import cut

_TOKEN = re.compile(r"\s*(?:%[^\n]*|(\"[^\"]*\"|'[^']*'|:-|\?-|<=|>=|!=|<>|==|[-+]?\d+\.\d+|\d+|\w+|[^\s\w]))")


@dataclass
class Atom:
    name: str
    args: list
    negated: bool = False


@dataclass
class Rule:
    head: Atom
    body: list[Atom] = field(default_factory=list)
    tests: list[tuple] = field(default_factory=list)  # (left, op, right) as SQL text over variables


def is_variable(t) -> bool:
    return isinstance(t, str) and (t[0].isupper() or t[0] == "_")


class Parser:
    def __init__(self, text: str):
        self.tokens = [m[1] for m in _TOKEN.finditer(text) if m[1]]
        self.i = 0

    def peek(self, k: int = 0):
        return self.tokens[self.i + k] if self.i + k < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if t is None or (want is not None and t != want):
            raise ValueError(f"expected {want}, found {t}")
        self.i += 1
        return t

    def program(self) -> tuple[list[Rule], Atom | None]:
        rules, goal = [], None
        while self.peek():
            if self.peek() == "?-":
                self.take()
                goal = self.atom()
            else:
                rule = Rule(self.atom())
                if self.peek() == ":-":
                    self.take()
                    self.literal(rule)
                    while self.peek() == ",":
                        self.take()
                        self.literal(rule)
                rules.append(rule)
            self.take(".")
        return rules, goal

    def literal(self, rule: Rule) -> None:
        if self.peek() in ("not", "!") and self.peek(1) != "(":
            self.take()
            atom = self.atom()
            atom.negated = True
            rule.body.append(atom)
        elif self.peek(1) == "(":
            rule.body.append(self.atom())
        else:
            left, op = self.expression(), self.take()
            rule.tests.append((left, {"==": "=", "!=": "<>"}.get(op, op), self.expression()))

    def expression(self) -> str:
        parts = []
        while self.peek() not in ("<", ">", "<=", ">=", "=", "==", "!=", "<>", ",", "."):
            t = self.take()
            parts.append("'" + t[1:-1] + "'" if t[0] in "\"'" else t)
        return " ".join(parts)

    def atom(self) -> Atom:
        name, args = self.take(), []
        self.take("(")
        while self.peek() != ")":
            t = self.take()
            if self.peek() == "(":  # head aggregate
                self.take("(")
                t = ("agg", t.lower(), self.take())
                self.take(")")
            elif t[0] in "\"'":
                t = ("const", t[1:-1])
            elif re.fullmatch(r"[-+]?\d+(\.\d+)?", t):
                t = ("const", float(t) if "." in t else int(t))
            elif not is_variable(t):
                t = ("const", t)
            args.append(t)
            if self.peek() == ",":
                self.take()
        self.take(")")
        return Atom(name, args)


def strata(rules: list[Rule]) -> list[set[str]]:
    """Predicates by stratum; negation and aggregation must come from a lower one."""
    level = {r.head.name: 0 for r in rules}
    for _ in range(len(level) ** 2 + 1):
        changed = False
        for r in rules:
            strict = any(isinstance(a, tuple) and a[0] == "agg" for a in r.head.args)
            for b in r.body:
                if b.name in level:
                    need = level[b.name] + (b.negated or strict)
                    if level[r.head.name] < need:
                        level[r.head.name], changed = need, True
        if not changed:
            return [{n for n, v in level.items() if v == k} for k in range(max(level.values(), default=-1) + 1)]
    raise ValueError("negation or aggregation inside a recursion")


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.known = {n: d.toDF(*[f"c{i}" for i in range(len(d.columns))]) for n, d in tables.items()}

    def bound(self, atom: Atom, source: DataFrame) -> DataFrame:
        """Rows of an atom as variable columns; constants and repeated variables filter."""
        cols, tests = {}, []
        for i, a in enumerate(atom.args):
            c = F.col(f"c{i}")
            if isinstance(a, tuple):
                tests.append(c == F.lit(a[1]))
            elif a != "_":
                if a in cols:
                    tests.append(c == cols[a])
                else:
                    cols[a] = c
        for t in tests:
            source = source.where(t)
        return source.select(*[c.alias(v) for v, c in cols.items()]) if cols else source.select(F.lit(1).alias("_one")).limit(1)

    def evaluate(self, rule: Rule, use: dict[int, DataFrame] | None = None) -> DataFrame | None:
        """Head rows of a rule; ``use`` replaces the relation of a body atom (the delta of semi-naive steps)."""
        use = use or {}
        out = None
        for i, b in enumerate(rule.body):
            if b.negated:
                continue
            src = use.get(i, self.known.get(b.name))
            if src is None:
                return None
            rows = self.bound(b, src)
            if out is None:
                out = rows
            else:
                on = [c for c in rows.columns if c in out.columns]
                out = out.join(rows, on) if on else out.crossJoin(rows)
        if out is None:
            out = self.spark.range(1).select(F.lit(1).alias("_one"))
        pending = list(rule.tests)
        for left, op, right in pending:
            if op == "=" and is_variable(left) and left not in out.columns:
                out = out.withColumn(left, F.expr(right))
            else:
                out = out.where(f"({left}) {op} ({right})")
        for b in rule.body:
            if b.negated and b.name in self.known:
                rows = self.bound(b, self.known[b.name])
                on = [c for c in rows.columns if c in out.columns and c != "_one"]
                out = out.join(rows.distinct(), on, "left_anti") if on else out.join(rows.limit(1), F.lit(True), "left_anti")
        keys, aggs, order = [], [], []
        for i, a in enumerate(rule.head.args):
            name = f"c{i}"
            order.append(name)
            if isinstance(a, tuple) and a[0] == "agg":
                fn = {"count": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[a[1]]
                aggs.append(fn(F.col(a[2])).alias(name))
            else:
                keys.append((F.lit(a[1]) if isinstance(a, tuple) else F.col(a)).alias(name))
        if aggs:
            return out.groupBy(*keys).agg(*aggs).select(*order)
        return out.select(*keys).distinct()

    def run(self, rules: list[Rule], max_rounds: int | None = None) -> None:
        """Evaluate all rules to their fixpoint; an error after ``max_rounds`` without one, if given."""
        for names in strata(rules):
            own = [r for r in rules if r.head.name in names]
            delta = {}
            for n in names:
                parts = [p for p in (self.evaluate(r) for r in own if r.head.name == n) if p is not None]
                if n in self.known:
                    parts.append(self.known[n])
                if parts:
                    whole = parts[0]
                    for p in parts[1:]:
                        whole = whole.unionAll(p)
                    delta[n] = cut(whole.distinct())
            self.known |= delta
            recursive = [(r, i) for r in own for i, b in enumerate(r.body) if b.name in names and not b.negated]
            for r in own:  # a predicate that had no rows when its rule first ran gets its base rules again
                if r.head.name not in self.known:
                    first = self.evaluate(r)
                    if first is not None:
                        self.known[r.head.name] = delta[r.head.name] = cut(first)
            for done in count() if recursive else ():
                if max_rounds is not None and done >= max_rounds:
                    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
                fresh: dict[str, DataFrame] = {}
                for r, i in recursive:
                    if r.body[i].name not in delta:
                        continue
                    rows = self.evaluate(r, {i: delta[r.body[i].name]})
                    if rows is not None:
                        fresh[r.head.name] = fresh[r.head.name].unionAll(rows) if r.head.name in fresh else rows
                delta = {}
                for n, rows in fresh.items():
                    new = rows.distinct()
                    if n in self.known:
                        new = new.join(self.known[n], rows.columns, "left_anti")
                    new = cut(new)
                    if not new.isEmpty():
                        delta[n] = new
                        self.known[n] = self.known[n].unionAll(new) if n in self.known else new
                if not delta:
                    break


def run_datalog(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Answer the ``?-`` goal of a program: its variables are the columns."""
    rules, goal = Parser(text).program()
    if goal is None:
        raise ValueError("the program has no ?- goal")
    engine = Engine(spark, tables)
    engine.run(rules)
    return engine.bound(goal, engine.known[goal.name]).distinct()
