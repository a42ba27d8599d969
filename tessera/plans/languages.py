"""Queries of the front ends, streaming, statistics, signals and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import signal
from tessera.plans.cypher import run_cypher
from tessera.plans.datalog import run_datalog
from tessera.plans.gremlin import run_gremlin
from tessera.plans.metrics import GraphQL, run_cql, run_influx, run_promql
from tessera.plans.registry import query, sql, table, use_tables
from tessera.plans.signal_language import run_signal
from tessera.plans.sparql import run_sparql
from tessera.streaming import windows as st

NODES = "SELECT CAST(n_nationkey AS BIGINT) AS id, 'Nation' AS label, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"
EDGES = """SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * 3 + 1) % 25 AS BIGINT) AS dst, 'A' AS type, CAST(n_nationkey AS BIGINT) AS w FROM nation
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 5) % 25 AS BIGINT), 'B', CAST(n_nationkey * 2 AS BIGINT) FROM nation WHERE n_nationkey % 4 <> 0"""
TRIPLES = """SELECT 'n' || CAST(n_nationkey AS VARCHAR(9)) AS subject, 'name' AS predicate, n_name AS object FROM nation
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(9)), 'inRegion', 'r' || CAST(n_regionkey AS VARCHAR(9)) FROM nation
UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR(9)), 'name', r_name FROM region
UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR(9)), 'next', 'n' || CAST(n_nationkey + 1 AS VARCHAR(9)) FROM nation WHERE n_nationkey % 6 <> 5"""
_G = f"WITH RECURSIVE n AS ({NODES}), e AS ({EDGES})"
_S = f"WITH RECURSIVE t AS ({TRIPLES.replace('VARCHAR(9)', 'VARCHAR')})"


def graph_of(spark, sf_dir):
    use_tables(spark, sf_dir, "nation region")
    return spark.sql(NODES), spark.sql(EDGES)


def gremlin(name: str, text: str, oracle: str) -> None:
    query(f"gremlin_{name}", f"{_G} {oracle}")(lambda spark, sf_dir: run_gremlin(text, *graph_of(spark, sf_dir)))


gremlin("out_count", "g.V().hasLabel('Nation').out('A').count()", "SELECT count(*) AS value FROM n JOIN e ON src = id AND type = 'A'")
gremlin("has_values", "g.V().has('region', gt(2)).values('name')", "SELECT name AS value FROM n WHERE region > 2")
gremlin("in_dedup", "g.V(1, 2, 3).in().dedup()", "SELECT DISTINCT src AS value FROM e WHERE dst IN (1, 2, 3)")
gremlin("both", "g.V(6).both('B').values('name')", "SELECT name AS value FROM (SELECT dst AS x FROM e WHERE src = 6 AND type = 'B' UNION ALL SELECT src FROM e WHERE dst = 6 AND type = 'B') JOIN n ON id = x")
gremlin("edge_filter", "g.V().outE('B').has('w', gte(20)).inV().values('name')", "SELECT name AS value FROM e JOIN n ON id = dst WHERE type = 'B' AND w >= 20")
gremlin("group_count", "g.V().groupCount().by('region')", "SELECT region AS key, count(*) AS value FROM n GROUP BY region")
gremlin("as_select", "g.V().as('a').out('A').as('b').select('a', 'b')", "SELECT src AS a, dst AS b FROM e WHERE type = 'A'")
gremlin("order_limit", "g.V().order().by('name', desc).limit(5).values('name')", "SELECT name AS value FROM n ORDER BY name DESC LIMIT 5")
gremlin("mean", "g.E().values('w').mean()", "SELECT avg(w) AS value FROM e")


def datalog(name: str, text: str, oracle: str) -> None:
    def fn(spark, sf_dir):
        nodes, edges = graph_of(spark, sf_dir)
        return run_datalog(spark, text, {"node": nodes.select("id", "name", "region"), "edge": edges.select("src", "dst"), "weight": edges.select("src", "dst", "w")})

    query(f"datalog_{name}", f"{_G} {oracle}")(fn)


_REACH = ", r(x, y) AS (SELECT src, dst FROM e UNION SELECT r.x, e.dst FROM r JOIN e ON e.src = r.y)"
datalog("reach", "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), edge(Y, Z). ?- path(1, Y).", f"{_REACH} SELECT DISTINCT y AS Y FROM r WHERE x = 1")
datalog("negation", "linked(X) :- edge(X, Y), X != Y, node(Y, _, 1). lone(X, N) :- node(X, N, _), not linked(X). ?- lone(X, N).",
        "SELECT id AS X, name AS N FROM n WHERE id NOT IN (SELECT src FROM e JOIN n m ON m.id = dst WHERE src <> dst AND m.region = 1)")
datalog("aggregate", "total(X, sum(W)) :- weight(X, Y, W). big(X, T) :- total(X, T), T > 30. ?- big(X, T).", "SELECT src AS X, CAST(sum(w) AS BIGINT) AS T FROM e GROUP BY src HAVING sum(w) > 30")
datalog("same_generation", "sg(X, Y) :- edge(P, X), edge(P, Y), X < Y. sg(X, Y) :- edge(P, X), sg(P, Q), edge(Q, Y), X < Y. ?- sg(X, Y).",
        ", s(x, y) AS (SELECT a.dst, b.dst FROM e a JOIN e b ON a.src = b.src AND a.dst < b.dst UNION SELECT a.dst, b.dst FROM s JOIN e a ON a.src = s.x JOIN e b ON b.src = s.y WHERE a.dst < b.dst) SELECT DISTINCT x AS X, y AS Y FROM s")


def sparql(name: str, text: str, oracle: str) -> None:
    def fn(spark, sf_dir):
        use_tables(spark, sf_dir, "nation region")
        return run_sparql(spark, text, spark.sql(TRIPLES))

    query(f"sparql_{name}", f"{_S} {oracle}")(fn)


sparql("join", "SELECT ?name ?rn WHERE { ?n <inRegion> ?r . ?n <name> ?name . ?r <name> ?rn }",
       "SELECT b.object AS name, c.object AS rn FROM t a JOIN t b ON a.subject = b.subject AND b.predicate = 'name' JOIN t c ON c.subject = a.object AND c.predicate = 'name' WHERE a.predicate = 'inRegion'")
sparql("optional", "SELECT ?n ?m WHERE { ?n <inRegion> <r1> OPTIONAL { ?n <next> ?m } }", "SELECT a.subject AS n, b.object AS m FROM t a LEFT JOIN t b ON a.subject = b.subject AND b.predicate = 'next' WHERE a.predicate = 'inRegion' AND a.object = 'r1'")
sparql("filter_union", "SELECT ?n WHERE { { ?n <inRegion> <r0> } UNION { ?n <inRegion> <r2> } FILTER(?n != 'n0') }", "SELECT subject AS n FROM t WHERE predicate = 'inRegion' AND object IN ('r0', 'r2') AND subject <> 'n0'")
sparql("aggregate", "SELECT ?r (COUNT(?n) AS ?k) WHERE { ?n <inRegion> ?r } GROUP BY ?r HAVING(COUNT(?n) > 1) ORDER BY ?r", "SELECT object AS r, count(*) AS k FROM t WHERE predicate = 'inRegion' GROUP BY object HAVING count(*) > 1")
sparql("path_plus", "SELECT ?m WHERE { <n0> <next>+ ?m }", ", p(s, o) AS (SELECT subject, object FROM t WHERE predicate = 'next' UNION SELECT p.s, t.object FROM p JOIN t ON t.subject = p.o AND predicate = 'next') SELECT DISTINCT o AS m FROM p WHERE s = 'n0'")
sparql("path_sequence", "SELECT ?n ?rn WHERE { ?n <inRegion>/<name> ?rn }", "SELECT a.subject AS n, b.object AS rn FROM t a JOIN t b ON a.object = b.subject AND b.predicate = 'name' WHERE a.predicate = 'inRegion'")
sparql("ask", "ASK { ?n <next> <n7> }", "SELECT count(*) > 0 AS result FROM t WHERE predicate = 'next' AND object = 'n7'")
sparql("minus_bind", "SELECT ?n ?u WHERE { ?n <inRegion> ?r MINUS { ?n <next> ?m } BIND(UCASE(?n) AS ?u) }", "SELECT subject AS n, upper(subject) AS u FROM t a WHERE predicate = 'inRegion' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.predicate = 'next' AND b.subject = a.subject)")
sparql("construct", "CONSTRUCT { ?r <holds> ?n } WHERE { ?n <inRegion> ?r }", "SELECT DISTINCT object AS subject, 'holds' AS predicate, subject AS object FROM t WHERE predicate = 'inRegion'")


def cypher(name: str, text: str, oracle: str) -> None:
    query(f"cypher_{name}", f"{_G} {oracle}")(lambda spark, sf_dir: run_cypher(spark, text, *graph_of(spark, sf_dir)))


cypher("match", "MATCH (a:Nation)-[r:A]->(b:Nation) WHERE a.region = 1 AND b.region <> 1 RETURN a.name AS a, b.name AS b, r.w AS w", "SELECT a.name AS a, b.name AS b, e.w FROM n a JOIN e ON a.id = src AND type = 'A' JOIN n b ON b.id = dst WHERE a.region = 1 AND b.region <> 1")
cypher("aggregate", "MATCH (a)-[:A|B]->(b) RETURN b.region AS region, count(*) AS n, collect(a.id) AS ids ORDER BY region".replace(", collect(a.id) AS ids", ""), "SELECT b.region, count(*) AS n FROM e JOIN n b ON b.id = dst GROUP BY b.region")
cypher("optional", "MATCH (a:Nation {region: 2}) OPTIONAL MATCH (a)-[:B]->(b) RETURN a.name AS a, b.name AS b", "SELECT a.name AS a, b.name AS b FROM n a LEFT JOIN e ON src = a.id AND type = 'B' LEFT JOIN n b ON b.id = dst WHERE a.region = 2")
cypher("varlen", "MATCH (a)-[:B*1..3]->(b) WHERE a.id = 1 RETURN b.id AS b, count(*) AS n",
       ", p(x, k) AS (SELECT dst, 1 FROM e WHERE src = 1 AND type = 'B' UNION ALL SELECT dst, k + 1 FROM p JOIN e ON src = x AND type = 'B' WHERE k < 3) SELECT x AS b, count(*) AS n FROM p GROUP BY x")
cypher("with_unwind", "MATCH (a:Nation) WITH a.region AS region, count(*) AS n WHERE n > 2 UNWIND [1, 2] AS k RETURN region, n * k AS nk, k", "SELECT region, n * k AS nk, k FROM (SELECT region, count(*) AS n FROM n GROUP BY region HAVING count(*) > 2), (VALUES (1), (2)) v(k)")
cypher("string_match", "MATCH (a:Nation) WHERE a.name STARTS WITH 'N' OR a.name ENDS WITH '7' RETURN DISTINCT a.name AS name ORDER BY name SKIP 1 LIMIT 4", "SELECT DISTINCT name FROM n WHERE starts_with(name, 'N') OR ends_with(name, '7') ORDER BY name LIMIT 4 OFFSET 1")


@query("cql_filter_agg", "SELECT event_type, count(*) AS n, max(value) AS m FROM events WHERE user_id IN (1, 2, 3) AND value > 1 GROUP BY event_type")
def cql_filter_agg(spark, sf_dir):
    use_tables(spark, sf_dir, "events")
    return run_cql(spark, "SELECT event_type, COUNT(*) AS n, MAX(value) AS m FROM app.events WHERE user_id IN (1, 2, 3) AND value > 1 GROUP BY event_type ALLOW FILTERING;")


@query("graphql_nested", "SELECT r_name AS name, count(n_nationkey) AS n, min(n_name) AS first FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey > 3 WHERE r_regionkey < 4 GROUP BY r_name")
def graphql_nested(spark, sf_dir):
    g = GraphQL({"region": table(spark, sf_dir, "region"), "nation": table(spark, sf_dir, "nation")}, {("region", "nations"): ("nation", "r_regionkey", "n_regionkey", True)}, {"low": 3, "full": False})
    out = g.run("query Q($low: Int, $full: Boolean) { region(filter: {r_regionkey: {lt: 4}}, orderBy: r_name) { name: r_name r_comment @include(if: $full) nations(filter: {n_nationkey: {gt: $low}}) { ...f } } } fragment f on nation { n_name n_nationkey }")
    return out.select("name", F.coalesce(F.size("nations"), F.lit(0)).cast("long").alias("n"), F.array_min(F.col("nations.n_name")).alias("first"))


@query("influx_mean", """
WITH b AS (SELECT event_type, (epoch_us(ts) // 21600000000) * 21600000000 AS time, avg(value) AS m FROM events GROUP BY ALL), g AS (SELECT event_type, unnest(range(min(time), max(time) + 1, 21600000000)) AS time FROM b GROUP BY event_type)
SELECT g.event_type, g.time, round(last_value(m IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.time), 6) AS m FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.time = b.time""")
def influx_mean(spark, sf_dir):
    out = run_influx("SELECT MEAN(value) AS m FROM events GROUP BY time(6h), event_type FILL(previous)", {"events": table(spark, sf_dir, "events")})
    return out.select("event_type", "time", F.round("m", 6).alias("m"))


_AT = 1704844800000000  # 2024-01-10


@query("prom_sum_by_increase", f"""
WITH s AS (SELECT event_type, user_id, value, lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS p FROM events WHERE epoch_us(ts) > {_AT} - 259200000000 AND epoch_us(ts) <= {_AT} AND event_type <> 'error'),
i AS (SELECT event_type, user_id, sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) AS v FROM s GROUP BY ALL HAVING count(*) > 1) SELECT event_type, round(sum(v), 4) AS value FROM i GROUP BY event_type""")
def prom_sum(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.lit("activity").alias("metric"), "event_type", "user_id", "ts", "value")
    return run_promql('sum by (event_type) (increase(activity{event_type!="error"}[3d]))', s, _AT).select("event_type", F.round("value", 4).alias("value"))


@query("prom_avg_over_time", f"SELECT event_type, user_id, round(avg(value), 6) AS value FROM events WHERE epoch_us(ts) > {_AT} - 86400000000 AND epoch_us(ts) <= {_AT} GROUP BY ALL")
def prom_avg(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.lit("activity").alias("metric"), "event_type", "user_id", "ts", "value")
    return run_promql("avg_over_time(activity[1d])", s, _AT).select("event_type", "user_id", F.round("value", 6).alias("value"))


# ------------------------------------------------------------ time travel, JSON
_V = "SELECT o_custkey AS k, o_totalprice AS v, epoch_us(o_orderdate) AS valid_from, lead(epoch_us(o_orderdate), 1, 9223372036854775807) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders"


def _versions(spark, sf_dir):
    use_tables(spark, sf_dir, "orders")
    us = "unix_micros(CAST(o_orderdate AS TIMESTAMP))"
    spark.sql(_V.replace("epoch_us(o_orderdate)", us).replace("9223372036854775807", "9223372036854775807L")).createOrReplaceTempView("versions")


@query("time_travel_as_of", f"WITH v AS ({_V}) SELECT k, v FROM v WHERE valid_from <= 900000000000000 AND valid_to > 900000000000000")
def as_of(spark, sf_dir):
    from tessera.plans.sql import run_sql

    _versions(spark, sf_dir)
    return run_sql(spark, "SELECT k, v FROM versions FOR SYSTEM_TIME AS OF 900000000000000")


@query("time_travel_between", f"WITH v AS ({_V}) SELECT k, count(*) AS n FROM v WHERE valid_from < 910000000000000 AND valid_to > 900000000000000 GROUP BY k")
def between(spark, sf_dir):
    from tessera.plans.sql import run_sql

    _versions(spark, sf_dir)
    return run_sql(spark, "SELECT k, count(*) AS n FROM versions FOR SYSTEM_TIME BETWEEN 900000000000000 AND 910000000000000 GROUP BY k")


sql("json_path", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events WHERE props ? 'k' AND CAST(props ->> 'k' AS BIGINT) > 50",
    "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE json_exists(props, '$.k') AND CAST(props ->> '$.k' AS BIGINT) > 50")
sql("json_keys", "SELECT key, count(*) AS n FROM (SELECT explode(json_object_keys(props)) AS key FROM events) GROUP BY key", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")

# ----------------------------------------------------------------- statistics
sql("stats_describe", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(percentile(l_extendedprice, 0.5), 4) AS median, round(percentile(l_extendedprice, 0.75) - percentile(l_extendedprice, 0.25), 4) AS iqr,
  max(l_quantity) - min(l_quantity) AS rng, round(var_pop(l_quantity), 6) AS vp, round(stddev_samp(l_quantity), 6) AS sd, round(kurtosis(l_quantity), 5) AS kurt FROM lineitem GROUP BY l_returnflag""", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr,
  max(l_quantity) - min(l_quantity) AS rng, round(var_pop(l_quantity), 6) AS vp, round(stddev_samp(l_quantity), 6) AS sd, round(kurtosis_pop(l_quantity), 5) AS kurt FROM lineitem GROUP BY l_returnflag""")
sql("stats_corr_regression", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
sql("stats_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0D AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0D AS b FROM part) SELECT round(corr(a, b), 8) AS rho FROM r""", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 8) AS rho FROM r""")
sql("stats_histogram", "SELECT least(CAST(floor((l_quantity - 1) / 4.9) AS INT), 9) AS bin, count(*) AS n FROM lineitem GROUP BY 1", "SELECT least(CAST(floor((l_quantity - 1) / 4.9) AS INTEGER), 9) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
sql("stats_welch", """
WITH g AS (SELECT avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS ma, var_samp(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS va, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS na,
  avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS mb, var_samp(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS vb, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS nb FROM lineitem)
SELECT round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)), 3) AS df FROM g""")
sql("stats_zscore", "SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 8) AS z FROM supplier")
sql("ohlc_candles", """
SELECT user_id, CAST(ts AS DATE) AS d, min_by(value, struct(ts, event_id)) AS o, max(value) AS h, min(value) AS l, max_by(value, struct(ts, event_id)) AS c FROM events GROUP BY user_id, CAST(ts AS DATE)""", """
SELECT user_id, CAST(ts AS DATE) AS d, first(value ORDER BY ts, event_id) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts, event_id) AS c FROM events GROUP BY user_id, CAST(ts AS DATE)""")
sql("pivot_totals", """
SELECT coalesce(o_orderpriority, 'total') AS p, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS pp, count(*) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)""")

# -------------------------------------------------------------------- streams
@query("stream_tumbling", "SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return st.tumbling(table(spark, sf_dir, "events"), "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")])


@query("stream_sliding", """
SELECT w AS window_start, count(*) AS n FROM (SELECT unnest(range((epoch_us(ts) // 1800000000) * 1800000000 - 1800000000, (epoch_us(ts) // 1800000000) * 1800000000 + 1, 1800000000)) AS w FROM events) GROUP BY w""")
def stream_sliding(spark, sf_dir):
    return st.tumbling(table(spark, sf_dir, "events"), "1 hour", [], [F.count("*").alias("n")], slide="30 minutes")


@query("stream_session", """
WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, t, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS session_start, max(t) + 7200000000 AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    return st.sessions(table(spark, sf_dir, "events"), "2 hours", ["user_id"], [F.count("*").alias("n")])


_NOW = 1704844800000000


@query("trending_topk", f"""
SELECT user_id, count(*) AS n_24h, round(count(*) * exp(-0.693 / 300 * (({_NOW} - max(epoch_us(ts))) / 1e6)), 9) AS score FROM events WHERE epoch_us(ts) <= {_NOW} AND epoch_us(ts) > {_NOW} - 86400000000 GROUP BY user_id
ORDER BY count(*) * exp(-0.693 / 300 * (({_NOW} - max(epoch_us(ts))) / 1e6)) DESC, user_id LIMIT 10""")
def trending_topk(spark, sf_dir):
    return st.trending(table(spark, sf_dir, "events"), "user_id", _NOW, 10).select("user_id", "n_24h", F.round("score", 9).alias("score"))


_KIND = "CASE event_type WHEN 'click' THEN 'like' WHEN 'view' THEN 'watch' WHEN 'error' THEN 'skip' ELSE 'impression' END"


@query("engagement_score", f"""
SELECT user_id, round(sum(CASE k WHEN 'watch' THEN value * 3 WHEN 'like' THEN 2.0 WHEN 'skip' THEN CASE WHEN value < 2 THEN -1.0 ELSE -0.5 END WHEN 'impression' THEN 0.1 END), 4) AS score FROM (SELECT user_id, value, {_KIND} AS k FROM events) GROUP BY user_id""")
def engagement_score(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(st.engagement(F.expr(_KIND), F.col("value"))), 4).alias("score"))


@query("change_feed", "SELECT event_id AS id, event_type AS operation FROM events WHERE event_type IN ('click', 'view') AND CAST(user_id AS VARCHAR) LIKE '1_' AND event_id > 100")
def change_feed(spark, sf_dir):
    feed = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("operation"), F.col("user_id").cast("string").alias("key"), F.lit("events").alias("table"))
    return st.change_feed(feed, ["click", "view"], "1?", ["events"], 100).select("id", "operation")


# -------------------------------------------------------------------- signals
@query("sig_aggregates", """
SELECT user_id, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms, max(value) AS peak, round(max(value) - min(value), 6) AS p2p, round(regr_slope(value, epoch_us(ts) / 1e6) * 1e6, 5) AS slope FROM events GROUP BY user_id""")
def sig_aggregates(spark, sf_dir):
    out = run_signal(spark, "FROM events CHANNEL user_id TIME ts VALUE value AGGREGATE mean, rms, peak, peak_to_peak AS p2p, slope", {"events": table(spark, sf_dir, "events")})
    return out.select("user_id", F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"), "peak", F.round("p2p", 6).alias("p2p"), F.round(F.col("slope") * 1e6, 5).alias("slope"))


@query("sig_zscore_diff", "SELECT event_id, round(z - lag(z) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS value FROM (SELECT event_id, user_id, ts, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id))")
def sig_zscore_diff(spark, sf_dir):
    out = run_signal(spark, "FROM events CHANNEL user_id TIME ts VALUE value ORDER event_id TRANSFORM zscore, diff", {"events": table(spark, sf_dir, "events")})
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("sig_window_interpret", """
SELECT user_id, (epoch_us(ts) // 86400000000) * 86400000000 AS window_start, round(avg(value), 6) AS m, CASE WHEN avg(value) > 20 THEN 'high' END AS interpretation FROM events GROUP BY ALL""")
def sig_window(spark, sf_dir):
    out = run_signal(spark, "FROM events CHANNEL user_id TIME ts VALUE value WINDOW TUMBLING 1d AGGREGATE mean AS m INTERPRET m > 20 AS 'high' SEVERITY 2", {"events": table(spark, sf_dir, "events")})
    return out.select("user_id", "window_start", F.round("m", 6).alias("m"), "interpretation")


@query("sig_zero_crossings", """
SELECT user_id, CAST(coalesce(sum(CASE WHEN (d >= 0) <> (p >= 0) THEN 1 ELSE 0 END), 0) AS BIGINT) AS zero_crossings FROM (SELECT user_id, d, lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT user_id, ts, event_id, value - 10 AS d FROM events)) GROUP BY user_id""")
def sig_zero(spark, sf_dir):
    return signal.zero_crossings(table(spark, sf_dir, "events").withColumn("value", F.col("value") - 10), "user_id", ["ts", "event_id"], "value")


@query("sig_spectrum")
def sig_spectrum(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return signal.spectral_summary(signal.spectrum(e, "user_id", ["ts", "event_id"], "value", 1.0), "user_id")


# --------------------------------------------------------------- scalar functions
sql("fn_strings", "SELECT c_custkey, levenshtein(c_mktsegment, 'BUILDINGS') AS lev, soundex(c_mktsegment) AS sx, initcap(lower(c_mktsegment)) AS ic, base64(encode(c_name, 'utf-8')) AS b64, hex(encode(c_mktsegment, 'utf-8')) AS hx, reverse(c_name) AS rv FROM customer",
    "SELECT c_custkey, CAST(levenshtein(c_mktsegment, 'BUILDINGS') AS INTEGER) AS lev, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'A351' WHEN 'BUILDING' THEN 'B435' WHEN 'FURNITURE' THEN 'F653' WHEN 'HOUSEHOLD' THEN 'H243' WHEN 'MACHINERY' THEN 'M256' END AS sx, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS ic, base64(encode(c_name)) AS b64, hex(encode(c_mktsegment)) AS hx, reverse(c_name) AS rv FROM customer")
sql("fn_hashes", "SELECT p_partkey, md5(p_name) AS m, sha2(p_name, 256) AS s FROM part", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
sql("fn_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS ms, last_day(o_orderdate) AS ld, weekofyear(o_orderdate) AS wk FROM orders",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS ms, last_day(o_orderdate) AS ld, CAST(weekofyear(o_orderdate) AS INTEGER) AS wk FROM orders")
sql("fn_math", "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 8) AS sq, round(ln(abs(s_acctbal) + 1), 8) AS l, round(log10(abs(s_acctbal) + 1), 8) AS l10, floor(s_acctbal / 7) AS f, ceil(s_acctbal / 7) AS c, sign(s_acctbal) AS s, round(power(s_acctbal / 1000, 2), 6) AS p FROM supplier",
    "SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 8) AS sq, round(ln(abs(s_acctbal) + 1), 8) AS l, round(log10(abs(s_acctbal) + 1), 8) AS l10, CAST(floor(s_acctbal / 7) AS BIGINT) AS f, CAST(ceil(s_acctbal / 7) AS BIGINT) AS c, CAST(sign(s_acctbal) AS DOUBLE) AS s, round(power(s_acctbal / 1000, 2), 6) AS p FROM supplier")


@query("fn_slug_natural", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def fn_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("natural_sort", "SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS num FROM part ORDER BY num LIMIT 10")
def natural_sort(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand").distinct()
    return p.orderBy(tx.natural_key(F.col("p_brand"))).limit(10).select("p_brand", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("num"))


@query("geo_haversine", """
SELECT c_custkey, round(12742.0 * asin(sqrt(power(sin(radians(c_acctbal / 1000 - 5) / 2), 2) + cos(radians(5.0)) * cos(radians(c_acctbal / 1000)) * power(sin(radians(c_nationkey - 10) / 2), 2))), 3) AS km FROM customer""")
def geo_haversine(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(tx.haversine_km(F.lit(5.0), F.lit(10.0), F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")), 3).alias("km"))


@query("geo_geohash")
def geo_geohash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.geohash(F.col("c_acctbal") / 200, F.col("c_nationkey") * 10.0 - 120, 6).alias("geohash"))


@query("similar_to")
def similar_to(spark, sf_dir):
    s = tx.trigram_similarity(F.col("p_name"), F.lit("red widget"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(s, 6).alias("similarity"), F.round(tx.jaro_winkler(F.col("p_name"), F.lit("red widget")), 6).alias("jw")).where("similarity >= 0.3")
