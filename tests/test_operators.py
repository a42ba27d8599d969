import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import graph, search, signal, timeseries as ts, vector
from tessera.plans.sql import explain_tier, rewrite, run_sql
from tessera.sources import files
from tessera.streaming import windows as st

EDGES = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long")


def test_graph_functions(spark, edges):
    assert {(r.node, r.depth) for r in graph.bfs(edges, 1).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert graph.shortest_path(edges, 1, 5) == [1, 2, 4, 5]
    assert graph.shortest_path(edges, 5, 1) is None
    assert {r.node for r in graph.neighbors(edges, 1, 1).collect()} == {2, 3}
    two = edges.union(spark.createDataFrame([(9, 8)], "src long, dst long"))
    assert {(r.node, r.component) for r in graph.connected_components(two).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}
    assert sum(r["rank"] for r in graph.pagerank(edges, 10).collect()) == pytest.approx(1.0)


def test_cycle_terminates(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert graph.all_pairs(e).count() == 6
    assert graph.triangles(e).collect()[0].asDict() == {"a": "a", "b": "b", "c": "c"}


def test_fill_and_interpolate(spark):
    df = spark.createDataFrame([(0, 1.0), (3, 4.0)], "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value")
    out = ts.filled(df.withColumn("k", F.lit(1)), ["k"], "ts", "value", 1_000_000, "mean", "linear").orderBy("bucket").collect()
    assert [r.value for r in out] == [1.0, 2.0, 3.0, 4.0]
    prev = ts.filled(df.withColumn("k", F.lit(1)), ["k"], "ts", "value", 1_000_000, "mean", "previous").orderBy("bucket").collect()
    assert [r.value for r in prev] == [1.0, 1.0, 1.0, 4.0]


def test_vector_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    rows = df.select(*[vector.distance(k, F.col("a"), F.col("b")).alias(k) for k in ("l2", "l1", "inner", "cosine")]).collect()
    assert rows[0].l2 == 1.0 and rows[0].cosine is None
    assert rows[1].l2 is None


def test_ivf_recall(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((8, 16)) * 3
    rows = [(i, (centres[i % 8] + r.standard_normal(16)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id % 20 = 0")
    exact = {(x.query_id, x.neighbour_id) for x in vector.knn_join(q, df, "id", "v", 5).collect()}
    found = {(x.query_id, x.neighbour_id) for x in vector.ivf_search(df, q, "id", "v", 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_hypervector_algebra(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "k string").withColumn("hv", vector.random_hv(F.col("k")))
    whole = vector.bundle(df.withColumn("g", F.lit(1)), ["g"], "hv").withColumnRenamed("hv", "w")
    sims = df.crossJoin(whole).select(vector.similarity(F.col("hv"), F.col("w")).alias("s")).collect()
    assert all(x.s > 0.65 for x in sims)
    same = df.select(vector.similarity(F.col("hv"), vector.bind(vector.bind(F.col("hv"), F.col("hv")), F.col("hv"))).alias("s")).first()
    assert same.s == 1.0


def test_minhash_finds_copies(spark):
    docs = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "the quick brown fox jumps over the lazy dog again and again!"), (3, "completely different words about other things"), (4, None), (5, "")]
    got = search.minhash_near_duplicates(spark.createDataFrame(docs, "id long, t string"), "id", "t", 0.8).collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_minhash_verifies_whole_buckets(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    # the least id is below the threshold to all others, which are near each other
    base = "".join(chr(0x4E00 + i) for i in range(70))
    docs |= {-1000: base[:50]} | {-900 + i: base + chr(0x3000 + i) for i in range(30)} | {-800: base + chr(0x3000)}
    grams = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t in ((k, (t or "").encode()) for k, t in docs.items())}
    least = {}
    for k in sorted(docs):
        least.setdefault(frozenset(grams[k]), k)
    heads = sorted(k for g, k in least.items() if g)
    true = {(a, b) for a in heads for b in heads if a < b and round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 6) >= 0.8}
    copies = {(least[frozenset(grams[k])], k) for k in docs if grams[k]} - {(k, k) for k in docs}
    rows = search.minhash_near_duplicates(spark.createDataFrame(list(docs.items()), "id long, t string"), "id", "t", 0.8).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(got) == len(rows) and copies <= got <= true | copies
    assert {(a, b) for a, b in true if -900 <= a < b < -800} <= got
    assert len(got & true) >= 0.9 * len(true)  # the bands themselves miss some at the threshold


def test_bundles_cover_all_users(spark):
    from tessera.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {(r.user_id, r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    rows = QUERIES["hv_bundle_similarity"](spark, sf).collect()
    assert len(rows) == len(want) and {(r.user_id, r.event_type) for r in rows} == want
    assert all(0.5 < r.similarity <= 1 for r in rows)


def test_bundle_votes_like_a_count_of_bits(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(int(g), "ab"[g % 2] if g else None, r.integers(-(2**63), 2**63 - 1, n).tolist()) for g, n in zip(r.integers(0, 9, 300), r.choice([3, 3, 3, 2, 0], 300))]
    rows += [(100, "hot", r.integers(-(2**63), 2**63 - 1, 3).tolist()) for _ in range(2500)] + [(0, None, None), (101, "x", None), (102, "y", [5, None])]
    df = spark.createDataFrame(rows, "g int, k string, hv array<long>").repartition(3)
    ones, n = {}, {}
    for g, k, hv in rows:
        for w, x in enumerate(hv or []):
            n[g, k, w] = n.get((g, k, w), 0) + 1
            for b in range(64):
                ones[g, k, w, b] = ones.get((g, k, w, b), 0) + ((x or 0) >> b & 1)
    want = {}
    for g, k, w in sorted(n, key=str):
        bits = sum(1 << b for b in range(64) if 2 * ones[g, k, w, b] > n[g, k, w])
        want.setdefault((g, k), []).append(bits - (1 << 64) * (bits >> 63))
    assert {(x.g, x.k): list(x.hv) for x in vector.bundle(df, ["g", "k"], "hv").collect()} == want
    assert vector.bundle(df.where("false"), ["g"], "hv").count() == 0


def test_bundles_make_no_row_for_each_bit(spark):
    from tessera.plans.registry import QUERIES

    df = QUERIES["hv_bundle_similarity"](spark, "/root/testdata/sf0.001")
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_closeness_makes_no_row_for_each_pair(spark, monkeypatch):
    r = np.random.default_rng(4)
    pairs = {(f"n{a}", f"n{b}") for a, b in r.integers(0, 150, (220, 2))} | {(f"c{i}", f"c{i + 1}") for i in range(100)} | {("hub", f"n{i}") for i in range(150)}
    pairs |= {(f"c{i}", "hub") for i in range(0, 100, 9)}
    edges = spark.createDataFrame([*sorted(pairs), ("n1", None), (None, "c7"), ("n3", "n3"), *list(pairs)[:40]], "src string, dst string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    names = {x for p in pairs for x in p}
    want = {None: 0.0}  # a null end of an edge counts as a node that reaches nothing
    for s in names:
        seen, front, depth, total = {s}, {s}, 0, 0
        while front:
            depth += 1
            front = {b for a in front for b in near.get(a, ())} - seen
            seen |= front
            total += depth * len(front)
        want[s] = round(len(names) / total, 9) if total else 0.0
    joined = graph.all_pairs
    monkeypatch.setattr(graph, "all_pairs", None)
    monkeypatch.setattr(graph, "CHUNK", 7)
    assert {x.node: round(x.closeness, 9) for x in graph.closeness(edges).collect()} == want
    assert graph.closeness(edges.where("false")).count() == 0
    monkeypatch.setattr(graph, "all_pairs", joined)
    monkeypatch.setattr(graph, "MAX_CLOSENESS_EDGES", 0)
    few = edges.where("src < 'c2'")
    sums = {x.node: x.d for x in graph.distance_sums(few).collect()}
    monkeypatch.setattr(graph, "MAX_CLOSENESS_EDGES", 10_000)
    assert {x.node: x.d for x in graph.distance_sums(few).collect()} == sums and sums


def test_minhash_ships_no_trigrams_with_pairs(spark, monkeypatch):
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**24, n).astype(np.uint64)) for i, n in enumerate((1, 200, 300, 5000))]
    for g in sets:
        assert search._unpacked(search._packed(g)).tolist() == g.tolist()
    wide, narrow = (np.frombuffer(search._parity(sets[i]), np.uint64) for i in (2, 1))
    assert len(wide) == 2 * len(narrow)
    x, y = set(sets[2].tolist()), set(sets[1].tolist())
    assert np.bitwise_count((wide[:4] ^ wide[4:]) ^ narrow).sum() <= len(x ^ y)
    docs = [(i, f"a sentence about the harbour and its {i % 7} boats, told once more and at length " * 3 + str(i)) for i in range(40)]
    df = search.minhash_near_duplicates(spark.createDataFrame(docs, "id long, t string"), "id", "t", 0.8)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "jaccard(" not in plan
    gram = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    true = {(a, b) for a, s in docs for b, t in docs if a < b and gram(s) != gram(t) and len(gram(s) & gram(t)) >= 0.8 * len(gram(s) | gram(t))}
    rows = [(r.a, r.b) for r in df.where("similarity < 1").collect()]
    assert len(set(rows)) == len(rows) and set(rows) <= true and len(rows) >= 0.9 * len(true)


def test_rewrites(spark):
    assert "valid_from <= 5" in rewrite("SELECT * FROM t AS OF 5")
    spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k int, v int").createOrReplaceTempView("q_t")
    assert {tuple(r) for r in run_sql(spark, "SELECT k, v FROM q_t QUALIFY row_number() OVER (PARTITION BY k ORDER BY v DESC) = 1").collect()} == {(1, 20), (2, 5)}
    assert run_sql(spark, "SELECT k FROM q_t WHERE v > ALL (SELECT v FROM q_t WHERE k = 9)").count() == 3
    assert run_sql(spark, "SELECT k FROM q_t WHERE v = ANY (SELECT 5)").collect()[0].k == 2
    assert run_sql(spark, "SELECT count(*) AS n FROM q_t WHERE v > $1", [5]).first().n == 2
    assert explain_tier(spark.table("q_t").groupBy("k").count())["cascade_tier"] == "aggregate"


def test_signal_filters():
    t = np.arange(1000) / 1000
    v = np.sin(2 * np.pi * 10 * t) + 0.5 * np.sin(2 * np.pi * 50 * t)
    low = signal.spectral_filter(v, "lowpass", 1000.0, 25.0)
    assert np.abs(low - np.sin(2 * np.pi * 10 * t)).max() < 0.1
    assert signal.spectral_filter(np.sin(2 * np.pi * 10 * t), "envelope").mean() == pytest.approx(1.0, abs=0.01)


def test_scalar_functions(spark):
    df = spark.createDataFrame([("MARTHA", "MARHTA", "item10", 57.64911, 10.40744)], "a string, b string, n string, lat double, lon double")
    r = df.select(tx.jaro_winkler(F.col("a"), F.col("b")).alias("jw"), tx.natural_key(F.col("n"), 4).alias("nk"), tx.geohash(F.col("lat"), F.col("lon"), 8).alias("g"), tx.trigram_similarity(F.col("a"), F.col("a")).alias("t")).first()
    assert r.jw == pytest.approx(0.9611, abs=1e-4) and r.nk == "item0010" and r.g == "u4pruydq" and r.t == 1.0


def test_versioned_table(spark, tmp_path):
    t = files.VersionedTable(spark, f"file://{tmp_path}/vt", "k")
    t.create(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), 0)
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), 10)
    t.delete(spark.createDataFrame([(1,)], "k long"), 20)
    assert {tuple(r) for r in t.as_of(5).collect()} == {(1, "a"), (2, "b")}
    assert {tuple(r) for r in t.as_of(15).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in t.current().collect()} == {(2, "c"), (3, "d")}


def test_csv_and_triples(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|2,5\n3|4,0\n")
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/a.csv").collect()] == [(1, "2,5"), (3, "4,0")]
    (tmp_path / "t.tsv").write_text("a\tis\tb\t0.9\nc\tis\td\t0.1\nbroken\n")
    assert files.read_triples(spark, f"file://{tmp_path}/t.tsv", 0.5).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    aggs = [F.count("*").alias("n")]
    out = st.run_once(st.tumbling(stream, "1 hour", ["event_type"], aggs), "stream_test", "complete", str(tmp_path / "cp"))
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in st.tumbling(e, "1 hour", ["event_type"], aggs).collect()}


def test_change_feed_and_counters(spark):
    rows = spark.createDataFrame([(1, "insert", "user:1", "t"), (2, "delete", "user:2", "t"), (3, "insert", "item:1", "u")], "id long, operation string, key string, table string")
    assert [r.id for r in st.change_feed(rows, ["insert"], "user:*").collect()] == [1]
    parts = spark.createDataFrame([("c", "a", 3), ("c", "a", 5), ("c", "b", 2)], "counter string, replica string, n long")
    assert st.merge_counters(parts).first().value == 7
    assert math.isclose(st.decay_at(0), 1.0)


def test_weighted_graphs(spark, edges):
    w = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 2.0)], "src long, dst long, w double")
    assert {(r.node, r.cost) for r in graph.dijkstra(w, 1).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0), (4, 4.0)}
    assert {(r.a, r.b) for r in graph.spanning_forest(w).collect()} == {(1, 2), (2, 3), (3, 4)}
    b = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    assert b[4] == pytest.approx(3 / 12) and b[2] == pytest.approx(1 / 12) and b[1] == 0


def test_tables(spark):
    from tessera.operators import tables

    df = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (2, "a", None)], "k long, c string, v long")
    assert {(r.constraint, r.n) for r in tables.violations(df, unique=["k"], not_null=["v"], check="k < 2").collect()} == {("unique", 1), ("not null v", 1), ("check k < 2", 1)}
    m = tables.MaterialisedAggregate(lambda: df, "k", "v")
    assert m.can_answer("k", "v", "SUM") and {(r.k, r["sum"]) for r in m.read().collect()} == {(1, 30), (2, None)}
    total = tables.pivot_with_totals(df, "k", "c", "v", ["a", "b"]).where("is_total = 1").first()
    assert (total.a, total.b, total.total) == (10, 20, 30)
    seen = []
    t = tables.Triggers()
    t.add("BEFORE", "INSERT", lambda d: d.where("v > 10"))
    assert t.write("INSERT", df, lambda d: seen.append(d.count())) and seen == [1]
    assert [len(r.rows) for r in tables.reverse_reference(spark.createDataFrame([(1,), (3,)], "id long"), "id", df, "k", "rows").orderBy("id").collect()] == [2, 0]


def test_closeness_and_bfs_match_brute_force(spark):
    import random

    from tessera.operators import graph

    r = random.Random(3)
    pairs = sorted({(r.randrange(40), r.randrange(40)) for _ in range(70)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    names = sorted({x for p in pairs for x in p})

    def depths(start):
        out, front, depth = {start: 0}, [start], 0
        while front:
            depth += 1
            front = sorted({b for a in front for x, b in pairs if x == a} - set(out))
            out.update((b, depth) for b in front)
        return out

    want = {n: (lambda d: round((len(names) - 1) / sum(d.values()), 9) if sum(d.values()) else 0.0)(depths(n)) for n in names}
    assert {x.node: round(x.closeness, 9) for x in graph.closeness(edges).collect()} == want
    assert {x.node: x.depth for x in graph.bfs(edges, names[0]).collect()} == depths(names[0])


def test_promql_unknown_function_is_an_error(spark):
    import datetime

    import pytest

    from tessera.plans.metrics import run_promql

    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    s = spark.createDataFrame([("m", "a", at, 1.0), ("m", "a", at + datetime.timedelta(seconds=10), 5.0)], "metric string, k string, ts timestamp, value double")
    us = int((at.timestamp() + 10) * 1e6)
    for text in ("nonsense(m[1m])", "nonsense(m)", "rate(m)", "m[1m]"):
        with pytest.raises(ValueError):
            run_promql(text, s, us)
    value = lambda t: run_promql(t, s, us).first().value
    assert value("irate(m[1m])") == 0.4 and value("deriv(m[1m])") == pytest.approx(0.4) and value("idelta(m[1m])") == 4.0
    assert value("predict_linear(m[1m], 10)") == pytest.approx(9.0) and value("quantile_over_time(0.5, m[1m])") == 3.0
    assert value("clamp_max(abs(m), 2)") == 2.0 and value("topk(1, m)") == 5.0


def test_database_statements(spark, tmp_path):
    import pytest

    from tessera.plans.dml import Database

    db = Database(spark, f"file://{tmp_path}/db")
    assert db.run("CREATE TABLE t (id INT, name STRING)") == 0
    assert db.run("INSERT INTO t VALUES (1, 'a, WHERE'), (2, NULL), (NULL, 'c')") == 3
    assert db.run("UPDATE t SET name = 'x' WHERE id > 1") == 1
    assert db.run("DELETE FROM t WHERE id = 1") == 1
    assert db.run("ALTER TABLE t ADD COLUMN n BIGINT") == 0
    assert sorted(map(tuple, db.run("SELECT * FROM t").collect()), key=str) == [(2, "x", None), (None, "c", None)]
    assert db.run("CREATE MATERIALIZED VIEW m AS SELECT count(*) AS k FROM t") == 1
    db.run("DELETE FROM t")
    assert db.run("SELECT k FROM m").first().k == 2 and db.run("SELECT count(*) AS k FROM t").first().k == 0
    db.run("REFRESH MATERIALIZED VIEW m")
    assert db.run("SELECT k FROM m").first().k == 0
    with pytest.raises(ValueError):
        db.run("CREATE TABLE t (id INT)")
    db.run("DROP TABLE t")
    assert not db.exists("t") and db.run("DROP TABLE IF EXISTS t") == 0


def test_cql_limit_needs_keys():
    import pytest

    from tessera.plans.metrics import cql_to_sql

    with pytest.raises(ValueError):
        cql_to_sql("SELECT a FROM t PER PARTITION LIMIT 1")


def test_upsert_of_a_key_given_twice(spark, tmp_path):
    from tessera.sources.files import VersionedTable

    t = VersionedTable(spark, f"file://{tmp_path}/v", "k")
    t.create(spark.createDataFrame([(1, "a")], "k int, v string"), 10)
    t.upsert(spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), 20)
    assert [tuple(r) for r in t.current().collect()] == [(1, "c")]


def test_similar_pattern():
    import re

    from tessera.plans.sql import similar_pattern

    for pattern, text, fits in [("a%", "abc", True), ("a_", "abc", False), ("(a|b)+", "abba", True), ("a.c", "abc", False), ("[%_]x", "%x", True), ("50\\%", "50%", True), ("50\\%", "500", False), ("x$", "x$", True)]:
        assert bool(re.search(similar_pattern(pattern), text)) == fits, (pattern, text)
