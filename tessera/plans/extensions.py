"""Queries of market and grid operators, sessions with bounds, stores, transactions and further SQL forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.text import json_pointer
from tessera.operators import filters, fusion, market, scan, search, signal, timeseries as ts, vector
from tessera.operators.graph import shared_dir
from tessera.plans.cypher import run_cypher
from tessera.plans.dml import Database
from tessera.plans.multiway import multiway_join, run
from tessera.plans.registry import query, sql, table, use_tables
from tessera.plans.sql import run_sql
from tessera.streaming import merge

HOUR = 3_600_000_000
_CLOSES = f"SELECT event_type, (epoch_us(ts) // {HOUR}) * {HOUR} AS bucket, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL"
_NUMBERED = f"c AS ({_CLOSES}), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS i FROM c)"


def _closes(spark, sf_dir):
    """Last value of each hour per event type."""
    return ts.bucketed(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", HOUR, ["last"], "event_id").withColumnRenamed("last", "close")


@query("market_bollinger", f"""
WITH c AS ({_CLOSES}) SELECT event_type, bucket, round(CASE WHEN k = 20 THEN m END, 6) AS middle, round(CASE WHEN k = 20 THEN m + 2 * s END, 6) AS upper, round(CASE WHEN k = 20 THEN m - 2 * s END, 6) AS lower
FROM (SELECT event_type, bucket, count(*) OVER w AS k, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM c WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def market_bollinger(spark, sf_dir):
    out = market.bollinger(_closes(spark, sf_dir), ["event_type"], ["bucket"], "close")
    return out.select("event_type", "bucket", *[F.round(c, 6).alias(c) for c in ("middle", "upper", "lower")])


@query("market_ema_macd", f"""
WITH RECURSIVE {_NUMBERED}, r AS (
  SELECT event_type, bucket, i, close AS f, close AS s, 0.0::DOUBLE AS g FROM n WHERE i = 1 UNION ALL
  SELECT n.event_type, n.bucket, n.i, n.close * (2.0 / 13) + r.f * (1 - 2.0 / 13), n.close * (2.0 / 27) + r.s * (1 - 2.0 / 27),
    ((n.close * (2.0 / 13) + r.f * (1 - 2.0 / 13)) - (n.close * (2.0 / 27) + r.s * (1 - 2.0 / 27))) * 0.2::DOUBLE + r.g * 0.8::DOUBLE
  FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1)
SELECT event_type, bucket, round(f, 5) AS ema, round(f - s, 5) AS macd, round(g, 5) AS signal FROM r""")
def market_ema_macd(spark, sf_dir):
    lines = scan.macd(_closes(spark, sf_dir), ["event_type"], ["bucket"], "close")
    out = scan.ema(lines, ["event_type"], ["bucket"], "close", 12)
    return out.select("event_type", "bucket", *[F.round(c, 5).alias(c) for c in ("ema", "macd", "signal")])


@query("market_rsi", f"""
WITH RECURSIVE {_NUMBERED}, d AS (SELECT event_type, bucket, i - 1 AS i, close - lag(close) OVER (PARTITION BY event_type ORDER BY i) AS x FROM n),
g AS (SELECT event_type, bucket, i, greatest(x, 0) AS u, greatest(-x, 0) AS v FROM d WHERE i > 0),
r AS (SELECT event_type, 14::BIGINT AS i, sum(u) / 14 AS a, sum(v) / 14 AS b FROM g WHERE i <= 14 GROUP BY event_type HAVING count(*) = 14 UNION ALL
  SELECT g.event_type, g.i, (r.a * 13 + g.u) / 14, (r.b * 13 + g.v) / 14 FROM r JOIN g ON g.event_type = r.event_type AND g.i = r.i + 1)
SELECT n.event_type, n.bucket, round(100 - 100 / (1 + CASE WHEN b < 1e-15 THEN 100.0 ELSE a / b END), 5) AS rsi FROM n LEFT JOIN r ON r.event_type = n.event_type AND r.i = n.i - 1""")
def market_rsi(spark, sf_dir):
    return scan.rsi(_closes(spark, sf_dir), ["event_type"], ["bucket"], "close").select("event_type", "bucket", F.round("rsi", 5).alias("rsi"))


@query("market_trend", """
WITH w AS (SELECT user_id, value, lag(value) OVER p AS b, first_value(value) OVER p AS f, row_number() OVER p AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, any_value(n) AS points, any_value(greatest(abs(f) * 0.05, 0.01)) AS t, max(CASE WHEN i = n THEN value END) - any_value(f) AS d, count(CASE WHEN abs(value - b) > greatest(abs(f) * 0.05, 0.01) THEN 1 END) AS j FROM w GROUP BY user_id)
SELECT user_id, points, CASE WHEN points < 2 THEN 'flat' WHEN j > points * 0.5 THEN 'volatile' WHEN d > t THEN 'up' WHEN d < -t THEN 'down' ELSE 'flat' END AS trend FROM g""")
def market_trend(spark, sf_dir):
    return market.trend(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


#: Line items as positions: discounts and taxes stand for the Greeks.
_POSITIONS = "SELECT l_returnflag AS symbol, year(l_shipdate) AS expiry, l_discount AS delta, l_tax AS gamma, -l_discount / 10 AS theta, l_tax * 2 AS vega, l_extendedprice AS notional FROM lineitem"


@query("market_greeks", f"SELECT symbol, expiry, count(*) AS positions, round(sum(delta), 4) AS delta, round(sum(gamma), 4) AS gamma, round(sum(theta), 4) AS theta, round(sum(vega), 4) AS vega FROM ({_POSITIONS}) GROUP BY symbol, expiry",)
def market_greeks(spark, sf_dir):
    use_tables(spark, sf_dir, "lineitem")
    out = market.sensitivities(run_sql(spark, _POSITIONS).withColumn("expiry", F.col("expiry").cast("long")), ["symbol", "expiry"])
    return out.select("symbol", "expiry", "positions", *[F.round(g, 4).alias(g) for g in market.GREEKS])


@query("market_risk", f"""
SELECT symbol, round(abs(d) * n * 0.02 * sqrt(10) * 2.326 / 1e6, 2) AS var_99, round((abs(d) * n * 0.02 * 1.645 + abs(g) * n * 0.01 + abs(v) * 0.02 * n) / 1e6, 2) AS margin
FROM (SELECT symbol, sum(delta) AS d, sum(gamma) AS g, sum(vega) AS v, sum(notional) AS n FROM ({_POSITIONS}) GROUP BY symbol)""")
def market_risk(spark, sf_dir):
    use_tables(spark, sf_dir, "lineitem")
    sums = run_sql(spark, _POSITIONS).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in (*market.GREEKS, "notional")])
    delta, gamma, vega, notional = (F.col(c) for c in ("delta", "gamma", "vega", "notional"))
    return sums.select("symbol", F.round(market.value_at_risk(delta, notional, 0.99, 10) / 1e6, 2).alias("var_99"), F.round(market.margin(delta, gamma, vega, notional) / 1e6, 2).alias("margin"))


@query("market_pnl", """
SELECT l_returnflag AS symbol, round(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity * (l_extendedprice * (1 + l_tax) - l_extendedprice) END), 0), 2) AS realised,
  round(coalesce(sum(CASE WHEN l_linestatus <> 'F' THEN l_quantity * (l_extendedprice * (1 - l_discount) - l_extendedprice) END), 0), 2) AS unrealised FROM lineitem GROUP BY l_returnflag""")
def market_pnl(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    closed = F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    trades = l.select(F.col("l_returnflag").alias("symbol"), F.col("l_quantity").alias("size"), F.col("l_extendedprice").alias("entry"), closed.alias("exit"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("mark"))
    return market.profit_and_loss(trades, ["symbol"]).select("symbol", *[F.round(c, 2).alias(c) for c in ("realised", "unrealised")])


# --------------------------------------------------------------- grid filters
@query("grid_filters", """
SELECT c_custkey FROM customer WHERE (contains(lower(c_name), '7') OR c_acctbal > 5000) AND lower(c_mktsegment) IN ('building', 'household') AND (c_nationkey BETWEEN 3 AND 20)
  AND (contains(lower(c_mktsegment), 'ui') OR contains(lower(c_name), 'ui'))""")
def grid_filters(spark, sf_dir):
    grid = filters.GridFilters(group=[("c_name", "regex", "7"), ("c_acctbal", "greater_than", "5000")], any_of=True, quick="UI")
    grid.columns = {"c_mktsegment": ("in", "Building, HOUSEHOLD"), "c_nationkey": ("between", "3", "20")}
    return grid.apply(table(spark, sf_dir, "customer")).select("c_custkey")


# ------------------------------------------------------- sessions and windows
@query("session_bounded", f"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, t, t AS s FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.t, CASE WHEN e.t - r.t > {12 * HOUR} OR e.t - r.s >= {24 * HOUR} THEN e.t ELSE r.s END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, s AS session_start, count(*) AS n, max(t) - s AS length FROM r GROUP BY user_id, s""")
def session_bounded(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", ts.micros("ts").alias("t"))
    s = scan.bounded_sessions(e, ["user_id"], "t", "event_id", 12 * HOUR, 24 * HOUR)
    return s.groupBy("user_id", "session_start").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("length"))


@query("landmark_windows", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'click' AS a, event_type = 'error' AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, b, CASE WHEN a THEN t ELSE -1 END AS s FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.b, CASE WHEN r.s >= 0 AND NOT r.b THEN r.s WHEN e.a THEN e.t ELSE -1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, s AS window_start, count(*) AS n FROM r WHERE s >= 0 GROUP BY user_id, s""")
def landmark_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", ts.micros("ts").alias("t"))
    w = scan.landmark_windows(e, ["user_id"], "t", "event_id", "event_type = 'click'", "event_type = 'error'")
    return w.groupBy("user_id", "window_start").agg(F.count(F.lit(1)).alias("n"))


_DAY0, _DAY9 = 1704067200000000, 1704844800000000


@query("temporal_bucket_counts", f"""
WITH b AS (SELECT unnest(range({_DAY0}, {_DAY9}, {HOUR})) AS bucket), e AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + {3 * HOUR // 2} AS e FROM events)
SELECT bucket, count(s) AS count, count(DISTINCT user_id) AS keys FROM b LEFT JOIN e ON s < bucket + {HOUR} AND e > bucket GROUP BY bucket""")
def temporal_bucket_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", ts.micros("ts").alias("s")).withColumn("e", F.col("s") + 3 * HOUR // 2)
    return ts.bucket_counts(e.withColumn("e", F.col("e").cast("long")), "user_id", "s", "e", _DAY0, _DAY9, HOUR)


@query("ts_store_retention", f"""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE epoch_us(ts) BETWEEN {_DAY0 + 3 * HOUR} AND {_DAY9} AND (epoch_us(ts) // {HOUR} + 1) * {HOUR} > {_DAY9 - 48 * HOUR} GROUP BY event_type""")
def ts_store_retention(spark, sf_dir):
    store = ts.PointStore(spark, f"{shared_dir(spark)}/points-{uuid.uuid4().hex}")
    store.write(table(spark, sf_dir, "events"))
    store.retain(_DAY9, 48 * HOUR)
    return store.range(_DAY0 + 3 * HOUR, _DAY9).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("ts_downsample_policy", f"""
SELECT event_type, epoch_us(ts) // {24 * HOUR} * {24 * HOUR} AS bucket, round(avg(value), 6) AS value FROM events
WHERE (epoch_us(ts) // {HOUR} + 1) * {HOUR} <= {_DAY9 - 24 * HOUR} GROUP BY ALL""")
def ts_downsample_policy(spark, sf_dir):
    root = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    fine, coarse = ts.PointStore(spark, f"{root}-fine"), ts.PointStore(spark, f"{root}-coarse")
    fine.write(table(spark, sf_dir, "events").select("ts", "event_type", "value"))
    fine.downsample(coarse, ["event_type"], "value", 24 * HOUR, "mean", _DAY9, 24 * HOUR, 100 * 24 * HOUR)
    return coarse.range(_DAY0 - HOUR, _DAY9).select("event_type", ts.micros("ts").alias("bucket"), F.round("value", 6).alias("value"))


# ----------------------------------------------------------- search, vectors
_T = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query("search_phrase", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_T}, ' ') || ' ', ' of the ')")
def search_phrase(spark, sf_dir):
    return search.phrase(table(spark, sf_dir, "documents"), "text", "Of the").select("doc_id")


@query("link_prediction", """
WITH q AS (SELECT vec_id AS id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.id, e.vec_id = q.id + 1 AS truth, round(-list_distance(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.id),
t AS (SELECT id, max(score) AS best FROM s WHERE truth GROUP BY id), r AS (SELECT id, 1 + count(CASE WHEN score > best THEN 1 END) AS rank FROM s JOIN t USING (id) GROUP BY id)
SELECT count(*) AS queries, round(avg((rank <= 1)::INT), 9) AS hits_1, round(avg((rank <= 3)::INT), 9) AS hits_3, round(avg((rank <= 10)::INT), 9) AS hits_10, round(avg(1 / rank), 9) AS mrr FROM r""")
def link_prediction(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("q"))
    pairs = q.join(e, F.col("vec_id") != F.col("id"))  # the stated queries against all rows
    scores = pairs.select("id", (F.col("vec_id") == F.col("id") + 1).alias("truth"), F.round(-vector.distance("l2", F.col("q"), F.col("embedding")), 6).alias("score"))
    return search.link_ranks(scores, "id", "score", "truth").select("queries", *[F.round(c, 9).alias(c) for c in ("hits_1", "hits_3", "hits_10", "mrr")])


@query("vec_range", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 5)
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), q), 6) AS distance FROM embeddings, q WHERE list_distance(CAST(embedding AS DOUBLE[]), q) <= 1.3""")
def vec_range(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.within(e, "embedding", e.where("vec_id = 5").first().embedding, 1.3).select("vec_id", F.round("distance", 6).alias("distance"))


@query("vec_centroid", "SELECT dimension, round(avg(x), 9) AS mean FROM (SELECT unnest(range(len(embedding)))::INT AS dimension, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY dimension")
def vec_centroid(spark, sf_dir):
    return vector.centroid(table(spark, sf_dir, "embeddings"), [], "embedding").select("dimension", F.round("mean", 9).alias("mean"))


# -------------------------------------------------------------------- signal
@query("sig_artefacts", """
WITH m AS (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type),
r AS (SELECT event_type, event_id, value, abs(value - m) > 1.5 * s AS bad, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events JOIN m USING (event_type)),
n AS (SELECT *, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER p AS v0, last_value(CASE WHEN NOT bad THEN i END IGNORE NULLS) OVER p AS i0, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER f AS v1, last_value(CASE WHEN NOT bad THEN i END IGNORE NULLS) OVER f AS i1
  FROM r WINDOW p AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY event_type ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, bad AS artefact, round(CASE WHEN bad THEN v0 + (v1 - v0) * (i - i0) / (i1 - i0) ELSE value END, 5) AS clean FROM n""")
def sig_artefacts(spark, sf_dir):
    out = signal.repair_artefacts(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value", 1.5)
    return out.select("event_id", "artefact", F.round("clean", 5).alias("clean"))


# ---------------------------------------------------------------- statistics
sql("stats_one_sample_t", "SELECT o_orderpriority, count(*) - 1 AS df, round((avg(o_totalprice) - 200000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 6) AS t FROM orders GROUP BY o_orderpriority")
sql("stats_chi_square", """
WITH o AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), e AS (SELECT sum(n) / count(*) AS e, count(*) AS k FROM o)
SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, max(k) - 1 AS df FROM o CROSS JOIN e""")
sql("stats_mode", "SELECT p_brand, mode() WITHIN GROUP (ORDER BY p_size) AS mode FROM part GROUP BY p_brand",
    "SELECT p_brand, arg_max(p_size, (n, -p_size)) AS mode FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
sql("approx_distinct", "SELECT abs(approx_count_distinct(l_partkey, 0.01) - count(DISTINCT l_partkey)) <= 0.05 * count(DISTINCT l_partkey) AS close FROM lineitem", "SELECT true AS close")
sql("approx_quantile", """
SELECT count_if(l_extendedprice <= q) BETWEEN 0.88 * count(*) AND 0.92 * count(*) AS close FROM lineitem CROSS JOIN (SELECT approx_percentile(l_extendedprice, 0.9, 1000) AS q FROM lineitem)""", "SELECT true AS close")


# ---------------------------------------------------------------- SQL forms
sql("where_without_from", "SELECT 1 AS one WHERE 2 > 1")
sql("map_access", "SELECT n_nationkey, map('name', n_name, 'key', CAST(n_regionkey AS STRING))['name'] AS name, try_element_at(map('a', n_regionkey), 'b') AS missing FROM nation",
    "SELECT n_nationkey, map {'name': n_name, 'key': CAST(n_regionkey AS VARCHAR)}['name'] AS name, map {'a': n_regionkey}['b'] AS missing FROM nation")
sql("recursive_union", """
WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, n_regionkey FROM nation UNION SELECT r.a, n_regionkey FROM r JOIN nation ON n_nationkey = r.b) SELECT a, count(*) AS n FROM r GROUP BY a""")
sql("recursive_cycle", """
WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS d FROM nation), r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s) SELECT s, count(*) AS n FROM r GROUP BY s""")
sql("like_meaning", "SELECT p_partkey FROM part WHERE p_name LIKE MEANING 'Small box, ring'", r"""
WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM part), h AS (SELECT *, len(list_intersect(w, ['small', 'box', 'ring'])) AS h FROM w)
SELECT p_partkey FROM h WHERE h > 0 AND h >= 0.5 * sqrt(len(w) * 3.0)""")


@query("json_pointer", """
SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '/k') AS BIGINT) AS k, event_type || '~' AS tilde FROM events""")
def json_pointer_query(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"a": [1, {"b/c": "'), F.col("event_type"), F.lit('"}], "0": {"m~n": "'), F.col("event_type"), F.lit('~"}, "p": '), F.col("props"), F.lit("}"))
    return e.select("event_id", json_pointer(doc, "/a/1/b~1c").alias("kind"), json_pointer(doc, "/p/k").cast("long").alias("k"), json_pointer(doc, "/0/m~0n").alias("tilde"))


@query("explain_statement", "SELECT 'aggregate' AS cascade_tier")
def explain_statement(spark, sf_dir):
    use_tables(spark, sf_dir, "orders")
    return run_sql(spark, "EXPLAIN SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus").select("cascade_tier")


@query("pg_catalog_columns", "SELECT 'nation' AS relname, * FROM (VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) v(attname, attnum)")
def pg_catalog_columns(spark, sf_dir):
    use_tables(spark, sf_dir, "nation")
    return run_sql(spark, "SELECT relname, attname, attnum FROM pg_catalog.pg_class JOIN pg_catalog.pg_attribute ON attrelid = oid WHERE relname = 'nation'")


@query("transactions", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0")
def transactions(spark, sf_dir):
    use_tables(spark, sf_dir, "nation")
    db = Database(spark, f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")
    db.run("CREATE TABLE t AS SELECT n_nationkey AS k, n_name AS name FROM nation")
    for text in ("BEGIN", "DELETE FROM t", "ROLLBACK", "BEGIN", "DELETE FROM t WHERE k % 5 = 0", "SAVEPOINT a", "UPDATE t SET name = 'x'", "ROLLBACK TO a", "COMMIT"):
        db.run(text)
    return Database(spark, db.folder).run("SELECT * FROM t")


@query("copy_out_in", "SELECT c_custkey AS k, c_name || ', \"' || c_mktsegment || '\"' AS name, nullif(c_nationkey, 3) AS nation FROM customer")
def copy_out_in(spark, sf_dir):
    use_tables(spark, sf_dir, "customer")
    root = f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}"
    db = Database(spark, f"{root}/db")
    db.run("""CREATE TABLE a AS SELECT c_custkey AS k, c_name || ', "' || c_mktsegment || '"' AS name, nullif(c_nationkey, 3) AS nation FROM customer""")
    for kind in ("csv", "text", "binary"):
        db.run(f"COPY a TO '{root}/{kind}' WITH (FORMAT {kind}, HEADER)")
        db.run("DELETE FROM a")
        db.run(f"COPY a FROM '{root}/{kind}' WITH (FORMAT {kind}, HEADER)")
    return db.run("SELECT * FROM a")


@query("procedures_triggers", """
SELECT 'nations' AS name, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'inserted', 1 UNION ALL SELECT 'deleted', 1""")
def procedures_triggers(spark, sf_dir):
    use_tables(spark, sf_dir, "nation")
    db = Database(spark, f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")
    for text in (
        "CREATE TABLE t (k BIGINT)", "CREATE TABLE log (name STRING, n BIGINT)",
        "CREATE TRIGGER a AFTER INSERT ON t EXECUTE $$ INSERT INTO log VALUES ('inserted', 1); $$",
        "CREATE TRIGGER b BEFORE DELETE ON t PRIORITY 2 EXECUTE $$ INSERT INTO log VALUES ('deleted', 1) $$",
        "CREATE PROCEDURE fill AS $$ INSERT INTO t SELECT n_nationkey FROM nation WHERE n_regionkey IN ($1, $2); DELETE FROM t WHERE k IN (SELECT n_nationkey FROM nation WHERE n_regionkey = $2) $$",
        "CALL fill(2, 3)", "ALTER TRIGGER a DISABLE", "INSERT INTO t SELECT k FROM t WHERE k < 0",
        "PREPARE note AS INSERT INTO log SELECT $1, count(*) FROM t", "EXECUTE note('nations')",
    ):
        db.run(text)
    return db.run("SELECT * FROM log")


# ------------------------------------------------- joins, languages, merges
_EDGES = "SELECT DISTINCT n_nationkey AS s, (n_nationkey * m + n_regionkey) % 25 AS d FROM nation, (VALUES (2), (3), (7)) v(m)"


@query("multiway_cycle", f"""
WITH e AS ({_EDGES}) SELECT DISTINCT w.s AS a, x.s AS b, y.s AS c FROM e w JOIN e x ON w.d = x.s JOIN e y ON x.d = y.s JOIN e z ON y.d = z.s AND z.d = w.s""")
def multiway_cycle(spark, sf_dir):
    use_tables(spark, sf_dir, "nation")
    e = run_sql(spark, _EDGES)
    return multiway_join({"e": e}, [("e", ["a", "b"]), ("e", ["b", "c"]), ("e", ["c", "d"]), ("e", ["d", "a"])], ["a", "b", "c"])


@query("multiway_star", """
SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey""")
def multiway_star(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier", "customer")}
    relations = {"o": t["orders"].select("o_orderkey", "o_custkey"), "l": t["lineitem"].select("l_orderkey", "l_suppkey"), "s": t["supplier"].select("s_suppkey", "s_nationkey"), "c": t["customer"].select("c_custkey", "c_nationkey")}
    return multiway_join(relations, [("o", ["k", "c"]), ("l", ["k", "s"]), ("s", ["s", "n"]), ("c", ["c", "n"])], ["c", "s"])


@query("language_dispatch", "SELECT 'sql' AS language, count(*) AS n FROM region UNION ALL SELECT 'cypher', count(*) FROM region UNION ALL SELECT 'cql', count(*) FROM region")
def language_dispatch(spark, sf_dir):
    use_tables(spark, sf_dir, "region")
    nodes = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.lit("Region").alias("label"), F.col("r_name").alias("name"))
    edges = spark.createDataFrame([], "src long, dst long, type string")
    parts = [
        run(spark, "sql", "SELECT count(*) AS n FROM region").withColumn("language", F.lit("sql")),
        run(spark, "cypher", "MATCH (r:Region) RETURN count(r) AS n", nodes=nodes, edges=edges).withColumn("language", F.lit("cypher")),
        run(spark, "cql", "SELECT count(*) AS n FROM region").withColumn("language", F.lit("cql")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("crdt_counters", "SELECT event_type AS counter, sum(u) - sum(d) AS value FROM (SELECT event_type, user_id, max(event_id) AS u, max(event_id // 2) AS d FROM events GROUP BY ALL) GROUP BY event_type".replace("sum(u) - sum(d)", "CAST(sum(u) - sum(d) AS BIGINT)"))
def crdt_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return merge.pn_counters(e.select(F.col("event_type").alias("counter"), F.col("user_id").alias("replica"), F.col("event_id").alias("up"), F.expr("event_id div 2").alias("down")))


@query("crdt_last_writer", "SELECT user_id, max_by(event_type, (ts, event_id)) AS value FROM events GROUP BY user_id")
def crdt_last_writer(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return merge.last_writer(e.select("user_id", F.col("event_type").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("replica")), ["user_id"]).select("user_id", "value")


@query("crdt_observed_set", """
SELECT DISTINCT user_id AS "set", event_type AS element FROM events a WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 3 = 0 AND b.user_id = a.user_id AND b.event_type = a.event_type AND (b.event_id // 10) = (a.event_id // 10))""")
def crdt_observed_set(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("set"), F.col("event_type").alias("element"), F.expr("event_id div 10").alias("tag"), "event_id")
    return merge.observed_set(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"))


@query("cypher_load_csv", "SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer WHERE c_custkey > 20 GROUP BY c_mktsegment")
def cypher_load_csv(spark, sf_dir):
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").write.csv(path, header=True, sep=";")
    none = spark.createDataFrame([], "id long, label string"), spark.createDataFrame([], "src long, dst long, type string")
    text = f"LOAD CSV WITH HEADERS FROM '{path}' AS row FIELDTERMINATOR ';' WITH row.c_mktsegment AS segment, CAST(row.c_nationkey AS BIGINT) AS k, CAST(row.c_custkey AS BIGINT) AS c WHERE c > 20 RETURN segment, count(*) AS n, sum(k) AS total"
    return run_cypher(spark, text, *none)


# -------------------------------------------------------------------- fusion
@query("sig_epochs", f"""
WITH e AS (SELECT user_id, event_id AS event, epoch_us(ts) AS a0 FROM events WHERE event_type = 'error'), s AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE event_type <> 'error')
SELECT CAST(floor((t - a0) / {HOUR}) AS BIGINT) * {HOUR} AS "offset", round(avg(value), 6) AS value FROM e JOIN s ON s.user_id = e.user_id AND t >= a0 - {6 * HOUR} AND t < a0 + {12 * HOUR} GROUP BY ALL""")
def sig_epochs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", ts.micros("ts"))
    marks = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("event"), F.col("t").alias("at"))
    aligned = fusion.epochs(e.where("event_type <> 'error'"), marks, ["user_id"], 6 * HOUR, 12 * HOUR)
    return fusion.epoch_mean(aligned, [], HOUR).select("offset", F.round("value", 6).alias("value"))


@query("sig_complementary", """
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, value AS x FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, 0.87654321::DOUBLE * (r.x + (e.event_id % 5) * 0.1::DOUBLE) + (1 - 0.87654321::DOUBLE) * e.value FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT event_id, round(x, 6) AS fused FROM r""")
def sig_complementary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("event_id") % 5 * F.lit(0.1)).alias("rate"))
    return fusion.complementary(e, ["user_id"], ["ts", "event_id"], "rate", "value", 0.87654321).select("event_id", F.round("fused", 6).alias("fused"))


@query("sig_weighted", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 1 THEN l_tax ELSE (0.75 * l_discount + 0.25 * l_tax) / 1.0 END, 9) AS fused FROM lineitem")
def sig_weighted(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("d", F.when(F.col("l_linenumber") != 1, F.col("l_discount")))
    return fusion.weighted(l, ["d", "l_tax"], [0.75, 0.25]).select("l_orderkey", "l_linenumber", F.round("fused", 9).alias("fused"))
