"""Similarity join on word 5-grams by adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their shingle sets is at
least ``PERCENT`` per cent. In a global order of shingles (by exact frequency,
then by hash) two linked sets share at least l of their first
``n - ceil(0.8 n) + l`` shingles, for every l. Each document takes the l that
minimises its estimated candidate cost. A pair is a candidate if at the places
of its first shared shingle what lies behind could still hold the rest of the
needed overlap (which puts that shingle into the prefixes of l = 1, the only
ones posted), and is verified only if its lengthened prefixes share the lesser
l of the two.

Equal sets are one node. Prefix postings are dealt by shingle; each list is
first linked as a star around its most typical member (the one with the fewest
rare shingles before the shared one), so a list of any size gives at most as
many pairs as members. Of lists whose members then lie in several components
further stars are made, and finally every pair between components that passes
the places' bound and has not been verified, so no link between different
texts is lost while pairs inside a component are never made.

Hashes of shingles and of sets have 64 bits. What the join writes on its way
is deleted when its result is written.

Defined cases: a text of fewer than five words is one shingle; one without
words (or null) is a component of its own with 0 shingles; repeated rows are
equal sets; null document ids join components but do not name them; very long
texts are one set like others; between equally typical hubs the hash decides;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, scratch
from tessera.llm.components import components
from tessera.llm.shingles import Levels, forget, set_id, share_levels, shingle_set, texts_of
from tessera.llm.urls import _bits, build_filter

PERCENT = 80
MAX_MATCH, VERIFY_COST = 4, 8
#: All pairs between components are compared by their places once they are at most so many per posting, or stars no longer halve them.
CROSS_PER_POSTING, MAX_STARS = 128, 4
#: Sets that a task remembers in order to give each once.
REMEMBERED = 500_000
#: Shingles that a task looks up together.
LOOKED_UP = 500_000
#: Nodes with links or copies are broadcast to the documents up to so many; beyond, both are shuffled.
MAX_BROADCAST_NODES = 300_000


def needed(n: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-PERCENT * n // 100)


def ordered(shingles: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set in the global order (rare first, then by hash) and the levels beside it."""
    if not level.any():
        return shingles, level
    at = np.argsort(level, kind="stable")
    return shingles[at], level[at]


def choose_match(level: np.ndarray) -> int:
    """The l of least cost: postings of the prefix, and candidates, of which each takes l of them, times the cost of verifying one."""
    n = len(level)
    if not level.any():
        return 1
    cum = np.cumsum(np.where(level > 0, np.exp2(level.astype(np.float64)), 0.0))
    best, cost = 1, None
    for m in range(1, min(MAX_MATCH, needed(n)) + 1):
        postings = cum[n - needed(n) + m - 1]
        c = postings * (1 + VERIFY_COST / m)
        if cost is None or c < cost:
            best, cost = m, c
    return best


def prefixes(docs: DataFrame, levels) -> DataFrame:
    """doc_id, node, n, l and prefix of each row; a task gives the prefix of equal sets once, else null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table, given = levels(), set()

        def shapes(sets):
            """(l, prefix) of each set, their shingles looked up together."""
            level, at = table.of(np.concatenate(sets)), 0
            for s in sets:
                own, lev = ordered(s, level[at : at + len(s)])
                at += len(s)
                m = choose_match(lev)
                yield m, own[: len(s) - needed(len(s)) + m].view(np.int64)

        for batch in batches:
            node, size, fresh, waiting, shaped = [], [], [], [], []
            for text in texts_of(batch):
                s = shingle_set(text)
                size.append(len(s))
                node.append(set_id(s) if len(s) else None)
                if len(s) and node[-1] not in given:
                    if len(given) >= REMEMBERED:
                        given.clear()
                    given.add(node[-1])
                    waiting.append(s)
                    fresh.append(len(node) - 1)
                    if sum(map(len, waiting[-64:])) > LOOKED_UP or len(waiting) >= 1024:
                        shaped += shapes(waiting)
                        waiting = []
            if waiting:
                shaped += shapes(waiting)
            match, prefix = [None] * len(node), [None] * len(node)
            for i, (m, p) in zip(fresh, shaped):
                match[i], prefix[i] = m, p
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(match, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "node", "n", "l", "prefix"],
            )
        forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, n long, l int, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n and the whole set s of the wanted nodes (node and the key, one document id of it).

    Only texts whose document id passes a bounded Bloom filter of the wanted
    ids are cut into shingles again; no text is shuffled or stored.
    """
    blocks = build_filter(wanted, wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(None if blocks is None else blocks.tobytes())

    def run(batches):
        bloom = None if shared.value is None else np.frombuffer(shared.value, np.uint64).reshape(-1, 4)
        done = set()
        for batch in batches:
            if bloom is not None:
                block, mask = _bits(batch.column("h").to_numpy(), len(bloom))
                batch = batch.filter(pa.array(((bloom[block] & mask) == mask).all(axis=1)))
            rows, size = [], 0
            for text in texts_of(batch):
                s = shingle_set(text)
                if not len(s) or (key := set_id(s)) in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(key)
                rows.append((key, len(s), s.view(np.int64)))
                size += len(s)
                if size > LOOKED_UP:
                    yield _set_rows(rows)
                    rows, size = [], 0
            if rows:
                yield _set_rows(rows)
        forget()

    found = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "node long, n long, s array<long>")
    return cut(found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def _set_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["node", "n", "s"])


def may_link(x: np.ndarray, y: np.ndarray, nx: int, ny: int, least: int, levels: Levels) -> bool:
    """Whether two prefixes share ``least`` shingles and leave room for the overlap that a link needs.

    Up to the earlier of the two last prefix shingles both sets are known, so
    no more can be common than what is there and the smaller of the two rests.
    """
    shared = len(np.intersect1d(x, y, assume_unique=True))
    if shared < least:
        return False
    kx, ky = levels.of(x), levels.of(y)
    if (kx[-1], x[-1]) <= (ky[-1], y[-1]):
        cx, cy = len(x), int(((ky < kx[-1]) | ((ky == kx[-1]) & (y <= x[-1]))).sum())
    else:
        cx, cy = int(((kx < ky[-1]) | ((kx == ky[-1]) & (x <= y[-1]))).sum()), len(y)
    most = shared + min(nx - cx, ny - cy)
    return most * 100 >= (nx + ny - most) * PERCENT


def screened(pairs: DataFrame, heads: DataFrame, levels) -> DataFrame:
    """Pairs (x, y) whose prefixes, from ``heads`` (node, n, l, prefix), allow a link."""
    ends = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    some = cut(heads.join(ends, "node", "left_semi").dropDuplicates(["node"]))
    left = some.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("l").alias("lx"), F.col("prefix").alias("px"))
    right = some.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("l").alias("ly"), F.col("prefix").alias("py"))

    def run(batches):
        table = levels()
        for batch in batches:
            def arrays(name):
                col = batch.column(name)
                values, offsets = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
                return [values[a:b] for a, b in zip(offsets, offsets[1:])]

            numbers = [batch.column(c).to_pylist() for c in ("nx", "ny", "least")]
            fits = [may_link(*row, table) for row in zip(arrays("px"), arrays("py"), *numbers)]
            yield batch.select(["x", "y"]).filter(pa.array(fits, pa.bool_()))

    both = pairs.join(right, "y").join(left, "x").select("x", "y", "nx", "ny", F.least("lx", "ly").alias("least"), "px", "py")
    return both.mapInArrow(run, "x long, y long")


def _nodes(rows: DataFrame) -> DataFrame:
    """node, key (its least document id) and number of copies; added up before the shuffle, so a text with many copies is no hot key."""
    return cut(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("key"), F.count("*").alias("copies")))


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, nodes: DataFrame, levels) -> DataFrame:
    """Of the pairs (x, y) those that link: their prefixes are compared first, then the whole sets of those left."""
    heads = rows.where("prefix is not null").select("node", "n", "l", "prefix")
    left = cut(screened(pairs, heads, levels))
    ends = left.select(F.col("x").alias("node")).union(left.select("y")).distinct()
    sets = sets_of(docs, nodes.select("node", "key").join(ends, "node", "left_semi"))
    a = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx"))
    b = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("s").alias("sy"))
    inter = F.size(F.array_intersect("sx", "sy")).cast("long")
    return left.join(b, "y").join(a, "x").where(inter * 100 >= (F.col("nx") + F.col("ny") - inter) * PERCENT).select("x", "y")


def _place(pos: Column, n: Column) -> Column:
    """Place in the order and size of a posting in one number, for the shuffle."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(n)


def _unplaced(place: str, tag: str) -> list[Column]:
    p = F.col(place)
    return [F.shiftright(p, 32).alias(f"pos{tag}"), p.bitwiseAND((1 << 32) - 1).alias(f"n{tag}")]


def _fits(a: str, b: str) -> Column:
    """Whether two postings of one shingle can be the first that a linked pair shares, by the places of both."""
    pos_a, n_a, pos_b, n_b = (F.col(f"{c}{t}") for t in (a, b) for c in ("pos", "n"))
    most = F.least(n_a - pos_a, n_b - pos_b) + 1
    return most * (100 + PERCENT) >= (n_a + n_b) * PERCENT


def _lists(rows: DataFrame) -> DataFrame:
    """Postings of shingles that several nodes share: token, node, its place, the hub of the list and its place, lo and hi of its nodes.

    The first shingle that a linked pair shares lies in the prefixes of l = 1, so only these are posted.

    Both the aggregate and the join use one shuffle of the postings.
    """
    head = F.slice("prefix", F.lit(1), (F.floor(F.col("n") * (100 - PERCENT) / 100) + 1).cast("int"))
    each = rows.where("prefix is not null").select(F.posexplode(head).alias("at", "token"), "node", "n")
    slim = each.select("token", "node", _place(F.col("at") + 1, F.col("n")).alias("place")).repartition("token")
    pos, n = _unplaced("place", "")
    typical = F.shiftleft(F.floor(pos * (1 << 20) / n).cast("long"), 40).bitwiseOR(F.col("node").bitwiseAND((1 << 40) - 1))
    keyed = slim.withColumn("key", typical)
    hubs = keyed.groupBy("token").agg(F.min_by("node", "key").alias("hub"), F.min_by("place", "key").alias("hub_place"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    return slim.join(hubs.hint("shuffle_hash"), "token")


def _ends(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _members(lists: DataFrame) -> DataFrame:
    """Postings of lists with three nodes or more; of a list with two, the hub's pair is the only one."""
    longer = lists.where("node <> lo and node <> hi").select("token").distinct()
    return cut(lists.join(longer, "token", "left_semi").select("token", "node", *_unplaced("place", "")).distinct())


def _node_links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, levels) -> DataFrame:
    """(v, c): each linked node and the least node of its component."""
    spark = docs.sparkSession
    lists = cut(_lists(rows))
    first = lists.where("node <> hub").select("hub", "node", *_unplaced("place", ""), *_unplaced("hub_place", "_h")).where(_fits("", "_h"))
    tried = cut(first.select(*_ends("hub", "node")).distinct())
    if tried.isEmpty():
        return spark.createDataFrame([], "v long, c long")
    found = cut(components(verified(tried, docs, rows, nodes, levels), "x", "y"))
    members = _members(lists)
    n_postings, cost = members.count(), None
    for step in range(MAX_STARS + 1 if n_postings else 0):
        labelled = members.join(found.withColumnRenamed("v", "node"), "node", "left").withColumn("c", F.coalesce("c", "node"))
        shares = labelled.groupBy("token", "c").agg(F.count("*").alias("k"))
        mixed = shares.groupBy("token").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.max_by("c", "k").alias("main"), F.count("*").alias("parts")).where("parts > 1")
        live = cut(labelled.join(mixed.select("token", "main", ((F.col("total") - F.col("most")) * F.col("total")).alias("cost")), "token"))
        costs = live.groupBy("token").agg(F.max("cost").alias("cost")).agg(F.count("*"), F.sum("cost")).first()
        if not costs[0]:
            break
        stuck = cost is not None and costs[1] * 2 > cost
        cost = costs[1]
        last = cost <= max(100_000, CROSS_PER_POSTING * n_postings) or stuck or step == MAX_STARS
        others = live.where("c <> main")
        if not last:
            others = others.groupBy("token").agg(F.min(F.struct(F.col("pos") / F.col("n"), "node", "pos", "n", "c")).alias("o")).select("token", "o.*")
        one = others.select("token", F.col("node").alias("a"), F.col("pos").alias("pos_a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
        once = (F.col("c") == F.col("main")) | F.lit(not last) | (F.col("a") < F.col("node"))  # of two others, each pair from one side
        made = one.join(live.drop("cost"), "token").where((F.col("c_a") != F.col("c")) & once & _fits("_a", ""))
        fresh = cut(made.select(*_ends("a", "node")).distinct().join(tried, ["x", "y"], "left_anti"))
        found = cut(components(verified(fresh, docs, rows, nodes, levels), "x", "y", known=found))
        if last:
            break
        tried = cut(tried.union(fresh))
    return found


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node and component_id (least document id) of each row of ``docs``."""
    spark = docs.sparkSession
    with scratch(spark):
        levels = share_levels(docs)
        rows = cut(prefixes(docs, levels))
        nodes = _nodes(rows)
        found = _node_links(docs, rows, nodes, levels)
        # only nodes with links or copies need a table; a document's own id names all others
        named = nodes.join(found.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("c", "node"))
        several = cut(named.where("copies > 1 or c is not null").select("node", "root", "key"))
        least = several.groupBy("root").agg(F.min("key").alias("component_id"))
        table = cut(several.join(least, "root").select("node", "component_id"))
        table = F.broadcast(table) if table.count() <= MAX_BROADCAST_NODES else table
        out = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(table, "node", "left")
        own = F.when(F.col("node").isNull() | F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return cut(out.select("doc_id", "n_shingles", "node", own.alias("component_id")), keep=True)


def similar_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links between different sets as (x, y), and the membership (doc_id, node) of every document.

    For callers who need the links themselves: unlike the components, they
    grow with the square of a group of near copies.
    """
    spark = docs.sparkSession
    with scratch(spark):
        levels = share_levels(docs)
        rows = cut(prefixes(docs, levels))
        lists = cut(_lists(rows))
        one = lists.select("token", "node", *_unplaced("place", "")).distinct()
        two = one.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "pos", "n")])
        made = one.join(two, "token").where((F.col("node") < F.col("node_b")) & _fits("", "_b"))
        links = cut(verified(cut(made.select(F.col("node").alias("x"), F.col("node_b").alias("y")).distinct()), docs, rows, _nodes(rows), levels), keep=True)
        return links, cut(rows.select("doc_id", "node"), keep=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document is not the least id of its component.

    Rows that repeat the kept document's id stay with it, as do rows without an id.
    """
    with scratch(docs.sparkSession):
        linked = link_components(docs.select("doc_id", "text"))
        gone = cut(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), keep=True)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
