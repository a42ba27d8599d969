"""Graph functions over directed edges (src, dst), as frontier and rank loops of joins."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that executors share; where none is named, one under /tmp with a local master, else an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (conf or "file:///tmp/checkpoints").rstrip("/")


#: Rounds of a loop after which what it has found is written as one table, so that a round reads few.
COMPACT_EVERY = 4


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: ends lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def bfs(edges: DataFrame, start, max_depth: int = 1_000_000) -> DataFrame:
    """(node, depth) reachable from ``start`` within ``max_depth`` hops, the start at 0."""
    e = cut(distinct_edges(edges))
    spark = edges.sparkSession
    kind = e.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(start, 0)], f"node {kind}, depth int")
    front = seen
    for depth in range(1, max_depth + 1):
        step = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
        seen = cut(seen) if depth % COMPACT_EVERY == 0 else seen
    return seen


def neighbors(edges: DataFrame, start, depth: int) -> DataFrame:
    """Nodes reachable within ``depth``, without the start."""
    return bfs(edges, start, depth).where("depth > 0").select("node")


def shortest_path(edges: DataFrame, source, target) -> list | None:
    """Nodes of a shortest path (least predecessors win ties), or None; 1 node when source is target."""
    levels = bfs(edges, source)
    hit = levels.where(F.col("node") == F.lit(target)).first()
    if hit is None:
        return None
    e, path = distinct_edges(edges), [target]
    for depth in range(hit.depth - 1, -1, -1):
        back = e.where(F.col("dst") == F.lit(path[0])).join(levels.where(F.col("depth") == depth), e["src"] == levels["node"])
        path.insert(0, back.agg(F.min("src")).first()[0])
    return path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that undirected paths reach, by label propagation with jumps."""
    e = distinct_edges(edges)
    both = cut(e.union(e.select("dst", "src")).distinct())
    labels = cut(nodes(edges).withColumn("component", F.col("node")))
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["node"] == near["src"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.select(F.col("node").alias("j"), F.col("component").alias("up"))
        new = cut(step.join(jump, step["component"] == jump["j"]).select("node", F.least("component", "up").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = new
        if changed:
            return labels


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, spread_dangling: bool = True, tolerance: float | None = None) -> DataFrame:
    """(node, rank); dangling mass is spread evenly, or lost when not ``spread_dangling``; ends early below ``tolerance``."""
    e = cut(distinct_edges(edges))
    all_nodes = cut(nodes(edges))
    n = all_nodes.count()
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    weighted = cut(e.join(out, "src"))
    ranks = all_nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    dangling = cut(all_nodes.join(out, all_nodes["node"] == out["src"], "left_anti"))
    for _ in range(iterations):
        lost = ranks.join(dangling, "node", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if spread_dangling else 0.0
        got = weighted.join(ranks, weighted["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("in"))
        base = (1 - damping) / max(n, 1) + damping * lost / max(n, 1)
        new = cut(all_nodes.join(got, all_nodes["node"] == got["dst"], "left").select("node", (F.lit(base) + damping * F.coalesce("in", F.lit(0.0))).alias("rank")))
        if tolerance is not None:
            delta = new.join(ranks.withColumnRenamed("rank", "old"), "node").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if delta is None or delta < tolerance:
                return new
        ranks = new
    return ranks


def all_pairs(edges: DataFrame, max_depth: int = 1_000_000) -> DataFrame:
    """(source, node, depth) of every reachable pair; a semi-naive closure by level."""
    e = cut(distinct_edges(edges))
    front = cut(e.select(F.col("src").alias("source"), F.col("dst").alias("node")).where("source <> node").distinct().withColumn("depth", F.lit(1)))
    seen = front
    for depth in range(2, max_depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node")).where("source <> node").distinct()
        front = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
        seen = cut(seen) if depth % COMPACT_EVERY == 0 else seen
    return seen


#: Edges are broadcast to tasks that search from many nodes at once up to so many; beyond, levels are joined.
MAX_CLOSENESS_EDGES = 5_000_000
#: Bytes of the bitmaps of a search, which has a bit for each node and target, and the words of a node's bitmap at most.
SEARCH_BYTES, SEARCH_WORDS = 32 << 20, 16


#: Nodes whose edges are followed at once.
CHUNK = 50_000


def _steps(starts: np.ndarray, nexts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``rows``, one after the other, and where each begins."""
    size = starts[rows + 1] - starts[rows]
    first = np.cumsum(size) - size
    return nexts[np.repeat(starts[rows] - first, size) + np.arange(size.sum())], first


def _distances_to(targets: np.ndarray, out: tuple, into: tuple, words: int) -> np.ndarray:
    """Of each node, the sum of its distances to those of ``targets`` (64 a word at most) that it reaches.

    Bit t of a node's bitmap says that the node reaches target t; a level goes
    one edge back from the nodes whose bitmaps have grown.
    """
    n = len(out[0]) - 1
    seen, fresh = np.zeros((n, words), np.uint64), np.zeros((n, words), np.uint64)
    at = np.arange(len(targets))
    seen[targets, at >> 6] = fresh[targets, at >> 6] = np.uint64(1) << (at & 63).astype(np.uint64)
    total, active, depth = np.zeros(n, np.int64), targets, 0
    while len(active):
        depth += 1
        mark = np.zeros(n, bool)
        mark[_steps(*into, active)[0]] = True
        rows, grown, bits = np.flatnonzero(mark), [], []
        for k in range(0, len(rows), CHUNK):
            some = rows[k : k + CHUNK]
            to, first = _steps(*out, some)
            new = np.bitwise_or.reduceat(fresh[to], first, axis=0) & ~seen[some]
            kept = new.any(axis=1)
            grown.append(some[kept])
            bits.append(new[kept])
        fresh[active] = 0
        active = np.concatenate([np.zeros(0, np.int64), *grown])
        if len(active):
            new = np.concatenate(bits)
            fresh[active] = new
            seen[active] |= new
            total[active] += depth * np.bitwise_count(new).sum(axis=1, dtype=np.int64)
    return total


def distance_sums(edges: DataFrame) -> DataFrame:
    """(node, d): the sum of the distances to all nodes that a node reaches; nodes that reach none may be missing."""
    e = cut(distinct_edges(edges))
    spark = e.sparkSession
    if e.count() > MAX_CLOSENESS_EDGES:
        return all_pairs(e).groupBy(F.col("source").alias("node")).agg(F.sum("depth").alias("d"))
    # numbered by Spark in the order of the nodes: the driver holds two numbers an edge, whatever the nodes are
    ends = cut(nodes(e).sort("node").withColumn("id", F.monotonically_increasing_id()))
    ids = np.sort(ends.select("id").toPandas()["id"].to_numpy())
    a, b = ends.toDF("src", "a"), ends.toDF("dst", "b")
    held = e.join(a, "src").join(b, "dst").select("a", "b").toPandas()
    src, dst = np.searchsorted(ids, held["a"].to_numpy()), np.searchsorted(ids, held["b"].to_numpy())
    del held
    n = len(ids)

    def lists(x: np.ndarray, y: np.ndarray) -> tuple[bytes, bytes]:
        return np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]).astype(np.int64).tobytes(), y[np.argsort(x, kind="stable")].astype(np.int32).tobytes()

    shared = spark.sparkContext.broadcast((ids.tobytes(), *lists(src, dst), *lists(dst, src)))
    tasks = max(1, min(-(-n // 64), 4 * spark.sparkContext.defaultParallelism))
    words = max(1, min(SEARCH_WORDS, SEARCH_BYTES // (8 * max(n, 1)), -(-n // (64 * tasks))))

    def search(batches):
        names, *parts = (np.frombuffer(x, np.int32 if i in (2, 4) else np.int64) for i, x in enumerate(shared.value))
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                mine = np.arange(part, len(names), tasks)
                for k in range(0, len(mine), 64 * words):
                    total += _distances_to(mine[k : k + 64 * words], (parts[0], parts[1]), (parts[2], parts[3]), words)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[some[k : k + 100_000]]), pa.array(total[some[k : k + 100_000]])], ["id", "d"])

    sums = spark.range(0, tasks, 1, tasks).mapInArrow(search, "id long, d long").groupBy("id").agg(F.sum("d").alias("d"))
    return ends.join(sums, "id").select("node", "d")


def closeness(edges: DataFrame) -> DataFrame:
    """(node, closeness): (n - 1) / sum of distances to what it reaches; 0 where it reaches nothing.

    Exact over all pairs, by searches from many nodes at once (``distance_sums``).
    """
    all_nodes = nodes(edges)
    n = all_nodes.count()
    return all_nodes.join(distance_sums(edges), "node", "left").select("node", F.coalesce(F.lit(n - 1) / F.col("d"), F.lit(0.0)).alias("closeness"))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Sum over edges inside a community of (1 - d d' / 2m) / 2m, degrees counted on both ends."""
    e = edges.select("src", "dst")
    m2 = 2.0 * e.count()
    deg = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).join(labels, "node")
    a = deg.select(F.col("node").alias("src"), F.col("d").alias("ds"), F.col("component").alias("cs"))
    b = deg.select(F.col("node").alias("dst"), F.col("d").alias("dd"), F.col("component").alias("cd"))
    return e.join(a, "src").join(b, "dst").where("cs = cd").agg(F.coalesce(F.sum((1 - F.col("ds") * F.col("dd") / m2) / m2), F.lit(0.0))).first()[0]


def triangles(edges: DataFrame) -> DataFrame:
    """Undirected triangles (a < b < c); edges go from the lesser degree to the greater, so no node has a long list."""
    e = distinct_edges(edges).where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = e.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    with_deg = e.join(deg.withColumnsRenamed({"n": "u", "d": "du"}), "u").join(deg.withColumnsRenamed({"n": "v", "d": "dv"}), "v")
    first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = cut(with_deg.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y")))
    wedge = o.alias("p").join(o.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.y") < F.col("q.y"))).select(F.col("p.x").alias("a"), F.col("p.y").alias("b"), F.col("q.y").alias("c"))
    closed = e.select(F.col("u").alias("b"), F.col("v").alias("c"))
    rows = wedge.join(closed, ["b", "c"]).select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    return rows.select(F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b"), F.get("t", F.lit(2)).alias("c"))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, component) by synchronous label propagation: the most frequent label around a node, least at ties."""
    e = distinct_edges(edges).where("src <> dst")
    both = cut(e.union(e.select("dst", "src")).distinct())
    labels = cut(nodes(edges).withColumn("component", F.col("node")))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "component").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("b")).select("src", (-F.col("b.c")).alias("new"))
        step = cut(labels.join(best, labels["node"] == best["src"], "left").select("node", "component", F.coalesce("new", "component").alias("new")))
        changed = not step.where("component <> new").isEmpty()
        labels = step.select("node", F.col("new").alias("component"))
        if not changed:
            break
    return labels


def eigenvector(edges: DataFrame, iterations: int = 50) -> DataFrame:
    """(node, score) of the power iteration over incoming edges, scaled to unit length each round."""
    e = cut(distinct_edges(edges))
    score = nodes(edges).withColumn("score", F.lit(1.0))
    all_nodes = cut(nodes(edges))
    for _ in range(iterations):
        got = e.join(score, e["src"] == score["node"]).groupBy("dst").agg(F.sum("score").alias("s"))
        raw = cut(all_nodes.join(got, all_nodes["node"] == got["dst"], "left").select("node", F.coalesce("s", F.lit(0.0)).alias("score")))
        size = raw.agg(F.sqrt(F.sum(F.col("score") * F.col("score")))).first()[0] or 1.0
        score = raw.withColumn("score", F.col("score") / size)
    return score


def dijkstra(edges: DataFrame, start, weight: str = "w") -> DataFrame:
    """(node, cost) of the cheapest paths from ``start`` over non-negative weights, by relaxing improved nodes only."""
    e = cut(edges.select("src", "dst", F.col(weight).cast("double").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    kind = e.schema["src"].dataType.simpleString()
    best = front = edges.sparkSession.createDataFrame([(start, 0.0)], f"node {kind}, cost double")
    while True:
        step = front.join(e, front["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        front = cut(step.join(best, "node", "left").where("cost is null or new < cost").select("node", F.col("new").alias("cost")))
        if front.isEmpty():
            return best
        best = cut(best.unionAll(front).groupBy("node").agg(F.min("cost").alias("cost")))


def spanning_forest(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Edges (a, b, w) of a minimum spanning forest, by Borůvka rounds; ties go to the least (a, b)."""
    e = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col(weight).cast("double").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w")))
    labels = nodes(edges).select("node", F.col("node").alias("component"))
    tree = None
    while True:
        la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        cross = cut(e.join(la, "a").join(lb, "b").where("ca <> cb"))
        if cross.isEmpty():
            return tree if tree is not None else e.where("false")
        ends = cross.select(F.explode(F.array("ca", "cb")).alias("c"), F.struct("w", "a", "b").alias("e"))
        chosen = ends.groupBy("c").agg(F.min("e").alias("e")).select(F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.col("e.w").alias("w")).distinct()
        tree = cut(chosen if tree is None else tree.union(chosen).distinct())
        linked = tree.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(nodes(edges).select(F.col("node").alias("src"), F.col("node").alias("dst")))
        labels = connected_components(linked)


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness) / ((n - 1)(n - 2)): path counts per source, one task per source.

    The edge list is sent whole to every source's task, so it is bounded at
    ``MAX_BETWEENNESS_EDGES``.
    """
    import pandas as pd

    e = distinct_edges(edges)
    n_edges = e.count()
    if n_edges > MAX_BETWEENNESS_EDGES:
        raise ValueError(f"betweenness takes at most {MAX_BETWEENNESS_EDGES} edges")
    out: dict = {}
    for r in e.toLocalIterator():
        out.setdefault(r.src, []).append(r.dst)
    shared = edges.sparkSession.sparkContext.broadcast(out)
    n = nodes(edges).count()
    kind = e.schema["src"].dataType.simpleString()

    def run(batches):
        near = shared.value
        for pdf in batches:
            total: dict = {}
            for s in pdf["node"]:
                dist, paths, order, back, i = {s: 0}, {s: 1.0}, [s], {}, 0
                while i < len(order):
                    v = order[i]
                    i += 1
                    for w in near.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            paths[w] = 0.0
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            back.setdefault(w, []).append(v)
                part = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in back.get(w, ()):
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + part[w]
            yield pd.DataFrame({"node": list(total), "x": list(total.values())})

    sums = nodes(edges).repartition(edges.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"node {kind}, x double").groupBy("node").agg(F.sum("x").alias("x"))
    scale = max(1, (n - 1) * (n - 2))
    return nodes(edges).join(sums, "node", "left").select("node", (F.coalesce("x", F.lit(0.0)) / scale).alias("betweenness"))


MAX_BETWEENNESS_EDGES = 1_000_000
