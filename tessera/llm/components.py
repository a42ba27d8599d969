"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


#: Up to so many pairs the steps run in one partition, without shuffles.
SMALL = 50_000


def _minima(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all its v; the minimum is pre-aggregated, so a hub is no hot group."""
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def components(links: DataFrame, a: str, b: str, known: DataFrame | None = None) -> DataFrame:
    """(v, c): each linked node and the least node of its component.

    ``known`` may hold (v, c) of earlier links, whose stars are taken as links.
    Ends when a round changes nothing; every round is written to the shared
    folder, so lost executors cost one round at most.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if known is not None:
        pairs = pairs.union(known.where("v <> c").select("v", "c"))
    pairs = cut(pairs.distinct())
    before = _digest(pairs)
    while before[0]:
        pairs = pairs.coalesce(1) if before[0] <= SMALL else pairs
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*")
        large = _minima(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        ranked = _minima(large)
        two = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")
        small = ranked.select(two).select("p.*").where("u <> v").distinct()
        pairs = cut(small)
        now = _digest(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("v"), F.col("v").alias("c")).union(pairs.select("v", F.col("v").alias("c")).distinct())
