"""Filters of a grid: predicates on cells as text, groups of them, quick search and presets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(name: str) -> Column:
    """A cell as text; null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _compare(name: str, value: str, number, text) -> Column:
    """Both sides as numbers where both are, else as lower-case texts."""
    cell = _cell(name)
    a, b = cell.try_cast("double"), F.lit(value).try_cast("double")
    return F.when(a.isNotNull() & b.isNotNull(), number(a, b)).otherwise(text(F.lower(cell), F.lit(value.lower())))


def grid_filter(name: str, op: str, value: str = "", high: str = "") -> Column:
    """One filter of a column; texts are compared without regard to case, and ``regex`` means contains, as in ``contains``."""
    cell, v = F.lower(_cell(name)), value.lower()
    at_least = _compare(name, value, lambda a, b: a >= b, lambda a, b: a >= b)
    kinds = {
        "equals": lambda: cell == v,
        "not_equals": lambda: cell != v,
        "contains": lambda: F.contains(cell, F.lit(v)),
        "regex": lambda: F.contains(cell, F.lit(v)),
        "starts_with": lambda: F.startswith(cell, F.lit(v)),
        "ends_with": lambda: F.endswith(cell, F.lit(v)),
        "greater_than": lambda: _compare(name, value, lambda a, b: a > b, lambda a, b: a > b),
        "less_than": lambda: _compare(name, value, lambda a, b: a < b, lambda a, b: a < b),
        "between": lambda: at_least & _compare(name, high, lambda a, b: a <= b, lambda a, b: a <= b),
        "in": lambda: cell.isin(*[x.strip().lower() for x in value.split(",")]),
        "is_empty": lambda: _cell(name) == "",
        "is_not_empty": lambda: _cell(name) != "",
    }
    return kinds[op]()


@dataclass
class GridFilters:
    """A group of filters joined by AND or OR, filters of columns, a quick search and named presets of groups."""

    group: list[tuple] = field(default_factory=list)
    any_of: bool = False
    columns: dict[str, tuple] = field(default_factory=dict)
    quick: str = ""
    presets: dict[str, tuple[list[tuple], bool]] = field(default_factory=dict)

    def save(self, name: str) -> None:
        self.presets[name] = (list(self.group), self.any_of)

    def load(self, name: str) -> bool:
        if name not in self.presets:
            return False
        group, self.any_of = self.presets[name]
        self.group = list(group)
        return True

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows that pass the group, every column filter and the quick search in any column."""
        if self.group:
            df = df.where(reduce(lambda a, b: a | b if self.any_of else a & b, [grid_filter(*f) for f in self.group]))
        for name, rest in self.columns.items():
            df = df.where(grid_filter(name, *rest))
        if self.quick:
            df = df.where(reduce(lambda a, b: a | b, [grid_filter(c, "contains", self.quick) for c in df.columns]))
        return df
