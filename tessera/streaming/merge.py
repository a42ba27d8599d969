"""Merges of replicated values (CRDTs) as commutative aggregates over states from any number of replicas.

Each takes all states that were sent, repeated or out of order, and gives the
merged one; they combine before the shuffle and serve ``foreachBatch`` too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pn_counters(states: DataFrame) -> DataFrame:
    """(counter, value) of states (counter, replica, up, down): the greatest up and down of each replica, then the difference of sums."""
    own = states.groupBy("counter", "replica").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    return own.groupBy("counter").agg((F.coalesce(F.sum("up"), F.lit(0)) - F.coalesce(F.sum("down"), F.lit(0))).alias("value"))


def last_writer(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, at, replica) of states with these columns: the latest write, of equal times the greatest replica's."""
    last = F.max(F.struct("at", "replica", "value")).alias("_last")
    return states.groupBy(*keys).agg(last).select(*keys, "_last.value", "_last.at", "_last.replica")


def observed_set(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """(set, element) of adds (set, element, tag) that no remove (set, element, tag) has seen: an add at the same time as a remove stays."""
    on = ["set", "element", "tag"]
    return adds.select(*on).join(removes.select(*on), on, "left_anti").select("set", "element").distinct()


def concurrent_values(writes: DataFrame) -> DataFrame:
    """(register, id, value) of writes (register, id, value, seen: ids of the writes it replaces) that no write replaces; several where replicas wrote at once."""
    replaced = writes.select("register", F.explode("seen").alias("id")).distinct()
    return writes.select("register", "id", "value").distinct().join(replaced, ["register", "id"], "left_anti")
