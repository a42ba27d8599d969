"""Points in two or three dimensions: boxes, radius joins and nearest neighbours, by cells of a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import cut


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Euclidean distance; null where a coordinate is."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def in_box(df: DataFrame, axes: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Rows inside a closed box; plain comparisons, so they reach the scan."""
    for axis, a, b in zip(axes, low, high):
        df = df.where((F.col(axis) >= a) & (F.col(axis) <= b))
    return df


def radius_join(left: DataFrame, right: DataFrame, axes: Sequence[str], radius: float) -> DataFrame:
    """(l_id, r_id, distance) of all pairs at most ``radius`` apart; both sides have ``id`` and the axes.

    Cells are as wide as the radius. A left point goes to its own cell and the
    right ones to all cells around theirs, so a pair meets in one cell.
    """
    cells = [F.floor(F.col(a) / radius).cast("long") for a in axes]
    one = left.select(F.col("id").alias("l_id"), *[F.col(a).alias(f"_l{a}") for a in axes], *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    two = right.select(F.col("id").alias("r_id"), *[F.col(a).alias(f"_r{a}") for a in axes], *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    for i in range(len(axes)):
        two = two.withColumn(f"_c{i}", F.explode(F.sequence(F.col(f"_c{i}") - 1, F.col(f"_c{i}") + 1)))
    both = one.join(two, [f"_c{i}" for i in range(len(axes))])
    d = distance([F.col(f"_l{a}") for a in axes], [F.col(f"_r{a}") for a in axes])
    return both.select("l_id", "r_id", d.alias("distance")).where(F.col("distance") <= radius)


def knn_join(left: DataFrame, right: DataFrame, axes: Sequence[str], k: int, radius: float) -> DataFrame:
    """(l_id, r_id, distance, rank) of the k nearest of ``right``, ties by id.

    ``radius`` is the first guess; points with fewer than k partners in it are
    tried again with twice the radius, until all have k or have met every point.
    """
    total = min(k, right.where(F.coalesce(*[F.col(a) for a in axes]).isNotNull()).count())
    todo, out = left.dropna(subset=list(axes)), None
    while total:
        near = cut(radius_join(todo, right, axes, radius))
        ranked = _first(near, k)
        enough = ranked.groupBy("l_id").agg(F.count("*").alias("n")).where(F.col("n") >= total).select("l_id")
        done = cut(ranked.join(enough, "l_id", "left_semi"))
        out = done if out is None else out.unionAll(done)
        todo = cut(todo.join(done.select(F.col("l_id").alias("id")).distinct(), "id", "left_anti"))
        if todo.isEmpty():
            break
        radius *= 2
    return out if out is not None else radius_join(left.limit(0), right, axes, radius).withColumn("rank", F.lit(0))


def _first(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("l_id").orderBy("distance", "r_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
