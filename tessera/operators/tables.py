"""Constraints, materialised aggregates, pivots, pagination, sampling, triggers."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import cut


def violations(df: DataFrame, unique: list[str] | None = None, not_null: list[str] | None = None, check: str | None = None, references: tuple[str, DataFrame, str] | None = None) -> DataFrame:
    """(constraint, n) of the constraints that rows break."""
    parts = []
    if unique:
        parts.append(df.groupBy(*unique).agg(F.count("*").alias("_rows")).where("_rows > 1").agg(F.lit("unique").alias("constraint"), F.count("*").alias("n")))
    for c in not_null or []:
        parts.append(df.where(F.col(c).isNull()).agg(F.lit(f"not null {c}").alias("constraint"), F.count("*").alias("n")))
    if check:
        parts.append(df.where(~F.expr(check)).agg(F.lit(f"check {check}").alias("constraint"), F.count("*").alias("n")))
    if references:
        own, other, theirs = references
        keys = other.select(F.col(theirs).alias("_r"))
        parts.append(df.where(F.col(own).isNotNull()).join(keys, df[own] == keys["_r"], "left_anti").agg(F.lit(f"foreign key {own}").alias("constraint"), F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.where("n > 0")


class MaterialisedAggregate:
    """SUM, COUNT, AVG, MIN and MAX per key, refreshed by policy: manual, on_write, or a number of seconds."""

    def __init__(self, source: Callable[[], DataFrame], key: str, value: str, policy: str | float = "manual"):
        self.source, self.key, self.value, self.policy = source, key, value, policy
        self.refresh()

    def refresh(self) -> None:
        v = self.value
        self.rows = cut(self.source().groupBy(self.key).agg(F.sum(v).alias("sum"), F.count(v).alias("count"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max")))
        self.at = time.time()

    def on_write(self) -> None:
        if self.policy == "on_write":
            self.refresh()

    def read(self) -> DataFrame:
        if isinstance(self.policy, (int, float)) and time.time() - self.at > self.policy:
            self.refresh()
        return self.rows

    def can_answer(self, key: str, value: str, kind: str) -> bool:
        return (key, value) == (self.key, self.value) and kind.lower() in ("sum", "count", "avg", "min", "max")


def pivot_with_totals(df: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """Sums per row and column value with row totals, and a last row (row is null) of column totals; empty cells are null."""
    cells = [F.sum(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values]
    rolled = df.where(F.col(column).isin(*values)).rollup(row).agg(*cells, F.sum(value).alias("total"), F.grouping(row).alias("is_total"))
    return rolled


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The ``size`` rows after a key; an unknown key is a position like any other."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def decaying_sample(df: DataFrame, time_s: str, k: int = 1028, alpha: float = 0.015, seed: int = 1) -> DataFrame:
    """The k rows with the largest priority exp(alpha * age) / u, newer rows weighing more."""
    t0 = df.agg(F.min(time_s)).first()[0] or 0
    log_priority = alpha * (F.col(time_s) - F.lit(t0)) - F.log(F.rand(seed))
    return df.withColumn("_p", log_priority).orderBy(F.col("_p").desc()).limit(k).drop("_p")


class Triggers:
    """BEFORE and AFTER functions on a DataFrame of rows about to be written, by priority.

    A BEFORE function returns the rows to write (or None to abort the write);
    an AFTER function sees the rows written.
    """

    def __init__(self):
        self.items: list[tuple[str, str, int, Callable]] = []

    def add(self, when: str, event: str, fn: Callable[[DataFrame], DataFrame | None], priority: int = 0) -> None:
        self.items.append((when.upper(), event.upper(), priority, fn))

    def write(self, event: str, rows: DataFrame, sink: Callable[[DataFrame], None]) -> bool:
        own = sorted((i for i in self.items if i[1] == event.upper()), key=lambda i: -i[2])
        for when, _, _, fn in own:
            if when == "BEFORE":
                rows = fn(rows)
                if rows is None:
                    return False
        sink(rows)
        for when, _, _, fn in own:
            if when == "AFTER":
                fn(rows)
        return True


def reverse_reference(parent: DataFrame, key: str, child: DataFrame, foreign: str, name: str) -> DataFrame:
    """``parent`` with the array of child rows that refer to it (empty when none)."""
    rows = child.groupBy(F.col(foreign).alias("_f")).agg(F.collect_list(F.struct(*child.columns)).alias(name))
    out = parent.join(rows, parent[key] == rows["_f"], "left").drop("_f")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
