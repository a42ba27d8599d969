"""Operators of sorted scans, filters, markets, stores and transactions on small inputs and odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import json_pointer
from tessera.operators import filters, fusion, market, scan, search, signal, timeseries as ts, vector
from tessera.plans.dml import Database
from tessera.plans.multiway import multiway_join, run
from tessera.plans.sql import run_sql
from tessera.streaming import merge


@pytest.fixture(scope="module")
def walk(spark):
    r = np.random.default_rng(4)
    rows = [(k, i, float(v)) for k in ("a", "b", None) for i, v in enumerate(100 + r.standard_normal(300).cumsum())]
    return spark.createDataFrame(rows, "k string, i long, v double")


def by_key(df, *cols):
    out = {}
    for r in df.orderBy("k", "i").collect():
        out.setdefault(r.k, []).append(tuple(r[c] for c in cols))
    return out


def test_averages_do_not_depend_on_batches(spark, walk):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        small = by_key(scan.rsi(scan.macd(walk, ["k"], ["i"], "v"), ["k"], ["i"], "v"), "v", "macd", "signal", "rsi")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(small) == {"a", "b", None}
    for rows in small.values():
        fast = slow = smooth = None
        for v, line, signal_line, _ in rows:
            fast = v if fast is None else fast + (v - fast) * 2 / 13
            slow = v if slow is None else slow + (v - slow) * 2 / 27
            smooth = fast - slow if smooth is None else smooth + (fast - slow - smooth) * 0.2
            assert (line, signal_line) == pytest.approx((fast - slow, smooth), abs=1e-9)
        v = np.array([r[0] for r in rows])
        up, down = np.maximum(np.diff(v), 0), np.maximum(-np.diff(v), 0)
        assert [r[3] for r in rows[:14]] == [None] * 14
        assert rows[14][3] == pytest.approx(100 - 100 / (1 + up[:14].mean() / down[:14].mean()))


def test_scan_of_nothing_and_clashing_names(spark, walk):
    empty = walk.where("false")
    assert scan.ema(empty, ["k"], ["i"], "v", 3).collect() == []
    extra = walk.withColumnsRenamed({}).withColumn("_scan_key", F.lit(1))
    assert scan.ema(extra, ["k"], ["i"], "v", 3).columns == ["k", "i", "v", "_scan_key", "ema"]
    with pytest.raises(ValueError):
        scan.ema(walk, ["k"], ["i"], "v", 3, "v")
    flat = spark.createDataFrame([("a", i, 5.0) for i in range(20)], "k string, i long, v double")
    assert scan.rsi(flat, ["k"], ["i"], "v").where("i = 19").first().rsi == pytest.approx(100 - 100 / 101)


def test_sessions_and_landmarks(spark):
    df = spark.createDataFrame([(t, i, e) for i, (t, e) in enumerate([(0, "s"), (4, "x"), (9, "s"), (12, "e"), (13, "x"), (30, "s"), (31, "x")])], "t long, id long, e string").withColumn("k", F.lit(1))
    s = {(r.t, r.session_start) for r in scan.bounded_sessions(df, ["k"], "t", "id", 5, 10).collect()}
    assert s == {(0, 0), (4, 0), (9, 0), (12, 12), (13, 12), (30, 30), (31, 30)}
    w = {(r.t, r.window_start) for r in scan.landmark_windows(df, ["k"], "t", "id", "e = 's'", "e = 'e'").collect()}
    assert w == {(0, 0), (4, 0), (9, 0), (12, 0), (30, 30), (31, 30)}


def test_trend_kinds(spark):
    series = {"up": [10, 10.2, 10.4, 11], "down": [10, 9.8, 9.5, 9], "flat": [10, 10.1, 10.2], "volatile": [10, 20, 10, 20, 10], "one": [3]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "k string, i long, v double")
    got = {r.k: r.trend for r in market.trend(df, ["k"], ["i"], "v").collect()}
    assert got == {"up": "up", "down": "down", "flat": "flat", "volatile": "volatile", "one": "flat"}


def test_grid_filters(spark):
    df = spark.createDataFrame([("Ann", "5"), ("bob", "12"), (None, "x"), ("", None)], "a string, b string")

    def found(*f):
        return [r.a for r in df.where(filters.grid_filter(*f)).collect()]

    assert found("a", "equals", "ANN") == ["Ann"] and found("a", "not_equals", "ann") == ["bob", None, ""]
    assert found("b", "greater_than", "9") == ["bob", None]  # 12 as a number, x as a text
    assert found("a", "is_empty") == [None, ""] and found("a", "in", " BOB , q") == ["bob"]
    assert found("a", "regex", "n") == ["Ann"] and found("b", "between", "4", "6") == ["Ann"]
    grid = filters.GridFilters(group=[("a", "starts_with", "a"), ("a", "ends_with", "b")], any_of=True)
    grid.save("x")
    grid.group = []
    assert grid.apply(df).count() == 4 and grid.load("x") and not grid.load("y")
    assert grid.apply(df).count() == 2
    grid.quick = "12"
    assert [r.a for r in grid.apply(df).collect()] == ["bob"]


def test_json_pointer(spark):
    doc = r'{"a/b": [1, {"m~n": "x"}], "0": "zero", "t": "{\"u\": 1}"}'
    df = spark.createDataFrame([(doc,), (None,), ("",)], "j string")

    def at(p):
        return [r[0] for r in df.select(json_pointer(F.col("j"), p)).collect()]

    assert at("/a~1b/0") == ["1", None, None] and at("/a~1b/1/m~0n") == ["x", None, None]
    assert at("/0") == ["zero", None, None] and at("/t/u") == [None] * 3 and at("") == [doc, None, ""]
    with pytest.raises(ValueError):
        at("a")


def test_transactions(spark, tmp_path):
    folder = f"file://{tmp_path}/db"
    db, other = Database(spark, folder), Database(spark, folder)
    db.run("CREATE TABLE t (k INT)")
    db.run("BEGIN")
    db.run("INSERT INTO t VALUES (1), (2)")
    assert db.run("SELECT * FROM t").count() == 2 and other.run("SELECT * FROM t").count() == 0
    db.run("SAVEPOINT a")
    db.run("DELETE FROM t")
    db.run("ROLLBACK TO SAVEPOINT a")
    assert db.run("COMMIT") == 1 and other.run("SELECT * FROM t").count() == 2
    db.run("BEGIN TRANSACTION")
    db.run("DELETE FROM t")
    other.run("INSERT INTO t VALUES (3)")
    with pytest.raises(RuntimeError):
        db.run("COMMIT")
    assert db.run("SELECT * FROM t").count() == 3
    with pytest.raises(ValueError):
        db.run("ROLLBACK")


def test_copy_keeps_nulls_and_empty_texts(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.run("CREATE TABLE t (k INT, s STRING)")
    for i, s in enumerate(["'a,\"b'", "''", "NULL", "'x\\ny'"]):
        db.run(f"INSERT INTO t VALUES ({i}, {s})")
    want = sorted(db.run("SELECT * FROM t").collect())
    for kind in ("csv", "binary"):
        assert db.run(f"COPY t TO 'file://{tmp_path}/{kind}' WITH (FORMAT {kind})") == 4
        db.run("DELETE FROM t")
        assert db.run(f"COPY t FROM 'file://{tmp_path}/{kind}' WITH (FORMAT {kind})") == 4
        assert sorted(db.run("SELECT * FROM t").collect()) == want


def test_store_downsamples_what_it_drops(spark, tmp_path):
    hour = ts.PointStore.HOUR
    rows = spark.range(10).select(F.timestamp_micros(F.col("id") * hour).alias("ts"), F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    fine, coarse = ts.PointStore(spark, f"file://{tmp_path}/a"), ts.PointStore(spark, f"file://{tmp_path}/b")
    fine.write(rows)
    fine.downsample(coarse, ["k"], "v", 4 * hour, "sum", 10 * hour, 2 * hour, 100 * hour)
    assert sorted(r.v for r in fine.range(0, 10 * hour).collect()) == [8.0, 9.0]
    assert sorted(r.v for r in coarse.range(0, 10 * hour).collect()) == [6.0, 22.0]
    assert fine.retain(10 * hour, hour) == 1


def test_bucket_counts(spark):
    df = spark.createDataFrame([("a", 0, 25), ("a", 12, 13), ("b", 20, 30), (None, 5, 6), ("c", 7, 7), ("d", None, 3)], "k string, s long, e long")
    got = {r.bucket: (r["count"], r["keys"]) for r in ts.bucket_counts(df, "k", "s", "e", 0, 40, 10).collect()}
    assert got == {0: (2, 1), 10: (2, 1), 20: (2, 2), 30: (0, 0)}


def test_artefacts_and_bins(spark):
    v = [0.0, 1.0, 900.0, 3.0, 4.0] + [float(i) for i in range(5, 40)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, i long, v double")
    got = {r.i: r for r in signal.repair_artefacts(df, "k", ["i"], "v", 3.0).collect()}
    assert [i for i, r in got.items() if r.artefact] == [2] and got[2].clean == pytest.approx(2.0) and got[3].clean == 3.0
    spec = spark.createDataFrame([("a", f, 1.0) for f in (1.0, 2.0, 4.0, 8.0, 15.9, 16.0)], "k string, frequency double, power double")
    assert {(r.window, r.power) for r in signal.frequency_bins(spec, "k", 1, 16, 4, True).collect()} == {(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0)}
    assert {(r.window, r.power) for r in signal.frequency_bins(spec, "k", 0, 16, 2).collect()} == {(0, 3.0), (1, 2.0)}


def test_search_and_vectors(spark):
    df = spark.createDataFrame([(1, "In the house"), (2, "in, THE  house!"), (3, "then house"), (4, None)], "id long, t string")
    assert [r.id for r in search.phrase(df, "t", "the house").collect()] == [1, 2]
    assert search.phrase(df, "t", "?").count() == 0
    scores = spark.createDataFrame([(1, 0.9, False), (1, 0.5, True), (2, 0.4, True), (2, 0.4, False), (3, 0.1, False)], "q long, s double, t boolean")
    r = search.link_ranks(scores, "q", "s", "t").first()
    assert (r.queries, r.hits_1, r.hits_3, r.mrr) == (2, 0.5, 1.0, 0.75)
    vecs = spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 3.0]), (3, None)], "id long, v array<double>")
    assert {(x.dimension, x["mean"]) for x in vector.centroid(vecs, [], "v").collect()} == {(0, 1.0), (1, 2.0)}
    assert [x.id for x in vector.within(vecs, "v", [0.0, 0.0], 1.0).collect()] == [1]


def test_sql_forms(spark):
    spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "s int, d int").createOrReplaceTempView("ring")
    text = "WITH RECURSIVE e AS (SELECT s, d FROM ring), r(a, b) AS (SELECT s, d FROM e UNION SELECT r.a, e.d FROM r JOIN e ON r.b = e.s) SELECT * FROM r"
    assert run_sql(spark, text).count() == 9
    assert run_sql(spark, "EXPLAIN SELECT s FROM ring WHERE s > 1").first().cascade_tier in ("lookup", "formula")
    assert run_sql(spark, "SELECT 'the red house' LIKE MEANING 'red house' AS a, 'blue' LIKE MEANING 'red' AS b, 'blue' NOT LIKE MEANING 'red' AS c").first()[:] == (True, False, True)


def test_merges_ignore_order_and_repeats(spark):
    s = spark.createDataFrame([("c", "a", 3, 0), ("c", "a", 5, 1), ("c", "b", 2, 2), ("c", "a", 3, 0)], "counter string, replica string, up long, down long")
    assert merge.pn_counters(s.union(s)).first().value == 4
    w = spark.createDataFrame([("k", "old", 1, "z"), ("k", "new", 2, "a"), ("k", "tie", 2, "b")], "k string, value string, at long, replica string")
    assert merge.last_writer(w, ["k"]).first().value == "tie"
    a = spark.createDataFrame([("s", "x", 1), ("s", "x", 2), ("s", "y", 3)], "set string, element string, tag long")
    assert [r.element for r in merge.observed_set(a, a.where("tag <> 2")).collect()] == ["x"]
    v = spark.createDataFrame([("r", 1, "a", []), ("r", 2, "b", [1]), ("r", 3, "c", [1])], "register string, id long, value string, seen array<long>")
    assert {r.value for r in merge.concurrent_values(v).collect()} == {"b", "c"}


def test_kalman_and_epochs(spark):
    rows = [("a", 0, None, None), ("a", 1, 10.0, None), ("a", 2, 12.0, 11.0), ("b", 0, 1.0, 3.0)]
    got = {(r.k, r.i): r for r in fusion.kalman(spark.createDataFrame(rows, "k string, i long, x double, y double"), ["k"], ["i"], ["x", "y"], [1.0, 2.0], 0.5).collect()}
    assert got["a", 0].fused is None and (got["a", 1].fused, got["a", 1].variance) == (10.0, 1.0)
    x, p = 10 + 2 * 1.5 / 2.5, 1.5 * 1.0 / 2.5
    g = p / (p + 2)
    assert got["a", 2].fused == pytest.approx(x + g * (11 - x)) and got["a", 2].variance == pytest.approx((1 - g) * p)
    s = spark.createDataFrame([("k", t, float(t)) for t in range(0, 100, 10)], "k string, t long, value double")
    e = spark.createDataFrame([("k", 1, 30), ("k", 2, 50)], "k string, event long, at long")
    near = {(r.event, r.offset, r.value) for r in fusion.epochs(s, e, ["k"], 10, 20).collect()}
    assert near == {(1, -10, 20.0), (1, 0, 30.0), (1, 10, 40.0), (2, -10, 40.0), (2, 0, 50.0), (2, 10, 60.0)}
    aligned = fusion.epochs(s, e, ["k"], 10, 20)
    for kind in ("mean", "median", "grand_mean"):
        assert {(r.offset, r.value) for r in fusion.epoch_mean(aligned, ["k"], 10, kind).collect()} == {(-10, 30.0), (0, 40.0), (10, 50.0)}


def test_multiway_join(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (None, 1), (1, 2)], "s int, d int")
    got = {tuple(r) for r in multiway_join({"e": e}, [("e", ["a", "b"]), ("e", ["b", "c"]), ("e", ["c", "a"])], ["a", "b", "c"]).collect()}
    assert got == {(1, 2, 3), (2, 3, 1), (3, 1, 2), (3, 3, 3)}
    assert [r.a for r in multiway_join({"e": e}, [("e", ["a", "a"])], ["a"]).collect()] == [3]
    for atoms, output in (([("e", ["a", "b"]), ("e", ["c", "d"])], ["a"]), ([("e", ["a", "b"])], ["z"])):
        with pytest.raises(ValueError):
            multiway_join({"e": e}, atoms, output)
    with pytest.raises(ValueError):
        run(spark, "klingon", "")


def test_procedures_and_triggers(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.run("CREATE TABLE t (s STRING)")
    db.run("CREATE TRIGGER a AFTER INSERT ON t EXECUTE $$ INSERT INTO t VALUES ('a;b'); $$")
    db.run("PREPARE p AS INSERT INTO t VALUES ('$1'), ($1)")
    db.run("EXECUTE p('x, y')")
    assert sorted(r.s for r in db.run("SELECT * FROM t").collect()) == ["$1", "a;b", "x, y"]
    db.run("DROP TRIGGER a")
    with pytest.raises(ValueError):
        db.run("EXECUTE p")
