"""Queries of the front ends' less common forms: writes, containment, open paths, unbound joins, rates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import signal, spatial
from tessera.operators import timeseries as ts
from tessera.operators.graph import shared_dir
from tessera.plans.cypher import GraphStore, run_cypher
from tessera.plans.datalog import run_datalog
from tessera.plans.dml import Database
from tessera.plans.metrics import run_cql, run_promql
from tessera.plans.registry import query, sql, table, use_tables
from tessera.plans.sparql import run_sparql
from tessera.plans.sql import run_sql


@query("dml_statements", """
WITH a AS (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part UNION ALL SELECT 0, 'none', NULL),
u AS (SELECT k, CASE WHEN size > 25 THEN 'big' ELSE name END AS name, CASE WHEN size > 25 THEN size * 2 ELSE size END AS size FROM a)
SELECT name, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM u WHERE NOT coalesce(k % 7 = 3, false) GROUP BY name""")
def dml_statements(spark, sf_dir):
    use_tables(spark, sf_dir, "part")
    db = Database(spark, f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")
    db.run("CREATE TABLE items (k BIGINT, name STRING, size INT)")
    db.run("INSERT INTO items SELECT p_partkey, p_name, p_size FROM part")
    db.run("INSERT INTO items (name, k) VALUES ('none', 0)")
    db.run("UPDATE items SET name = 'big', size = size * 2 WHERE size > 25")
    db.run("DELETE FROM items WHERE k % 7 = 3")
    db.run("CREATE VIEW by_name AS SELECT name, count(*) AS n, sum(size) AS total FROM items GROUP BY name")
    return db.run("SELECT * FROM by_name")


sql("sql_literals", "SELECT c_custkey, 'x AS OF 5' AS a, 'q <=> r -> ''k''' AS b FROM customer WHERE c_mktsegment <> 'a QUALIFY b'")


@query("spaceship_by_type", "SELECT a.n_nationkey AS k, round(list_cosine_distance([a.n_nationkey + 1.0, 2.0], [1.0, a.n_regionkey + 1.0]), 9) AS d, (a.n_nationkey IS NOT DISTINCT FROM a.n_regionkey) AS same FROM nation a")
def spaceship_by_type(spark, sf_dir):
    use_tables(spark, sf_dir, "nation")
    text = "SELECT k, round(x <=> y, 9) AS d, (k <=> r) AS same FROM (SELECT n_nationkey AS k, n_regionkey AS r, array(n_nationkey + 1.0D, 2.0D) AS x, array(1.0D, n_regionkey + 1.0D) AS y FROM nation)"
    return run_sql(spark, text)


@query("json_containment", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 2 AND n_nationkey % 3 = 1")
def json_containment(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    n.select(F.col("n_nationkey").alias("k"), F.to_json(F.struct(F.struct(F.col("n_regionkey").alias("r")).alias("in"), F.array(F.lit("t"), (F.col("n_nationkey") % 3).cast("string")).alias("tags"))).alias("j")).createOrReplaceTempView("json_nation")
    return run_sql(spark, """SELECT k FROM json_nation WHERE j @> '{"in": {"r": 2}, "tags": ["1"]}'""")


def _chain(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"))
    edges = n.where("n_nationkey > 0").select((F.col("n_nationkey") - 1).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"), F.lit("NEXT").alias("type"))
    return nodes, edges


@query("cypher_open_path", "SELECT n_name AS name FROM nation WHERE n_nationkey >= 2")
def cypher_open_path(spark, sf_dir):
    return run_cypher(spark, "MATCH (a:Nation {id: 0})-[:NEXT*2..]->(b:Nation) RETURN b.name AS name", *_chain(spark, sf_dir))


@query("cypher_parallel_edges", "SELECT n_name AS name, CAST(2 AS BIGINT) AS paths FROM nation WHERE n_nationkey > 0")
def cypher_parallel(spark, sf_dir):
    nodes, edges = _chain(spark, sf_dir)
    return run_cypher(spark, "MATCH (a:Nation)-[:NEXT]->(b:Nation) RETURN b.name AS name, count(*) AS paths", nodes, edges.union(edges))


@query("cypher_writes", """
SELECT n_name AS name, CAST(CASE WHEN n_regionkey = 2 THEN 7 END AS BIGINT) AS mark FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT 'Atlantis', NULL""")
def cypher_writes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("Nation").alias("label"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    store = GraphStore(spark, f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}")
    store.load(nodes, _chain(spark, sf_dir)[1])
    store.run("CREATE (a:Nation {name: 'Atlantis', region: 9})-[:NEXT]->(b:Nation {name: 'Mu', region: 4})")
    store.run("MERGE (a:Nation {name: 'Atlantis'})")
    store.run("MATCH (a:Nation) WHERE a.region = 2 SET a.mark = 7")
    store.run("MATCH (a:Nation) WHERE a.region = 4 DETACH DELETE a")
    return store.run("MATCH (a:Nation) RETURN a.name AS name, a.mark AS mark")


@query("datalog_negation_unbound", "SELECT r_name AS N FROM region")
def datalog_negation(spark, sf_dir):
    tables = {"region": table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "none": table(spark, sf_dir, "region").where("r_regionkey < 0").select("r_regionkey")}
    return run_datalog(spark, "all(N) :- region(_, N), not none(_). ?- all(N).", tables)


def _triples(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    parts = [n.select(s.alias("subject"), F.lit("name").alias("predicate"), F.col("n_name").alias("object")), n.where("n_nationkey % 2 = 0").select(s.alias("subject"), F.lit("region").alias("predicate"), F.col("n_regionkey").cast("string").alias("object"))]
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("subject"), F.lit("title").alias("predicate"), F.col("r_name").alias("object"))
    return parts[0].union(parts[1]).union(r)


@query("sparql_minus_unshared", "SELECT n_name AS name FROM nation")
def sparql_minus(spark, sf_dir):
    return run_sparql(spark, "SELECT ?name WHERE { ?s <name> ?name . MINUS { ?x <title> ?y } }", _triples(spark, sf_dir))


@query("sparql_unbound_join", """
SELECT n_name AS name, r_name AS title FROM nation JOIN region ON n_nationkey % 2 <> 0 OR n_regionkey = r_regionkey""")
def sparql_unbound(spark, sf_dir):
    return run_sparql(spark, "SELECT ?name ?title WHERE { ?s <name> ?name . OPTIONAL { ?s <region> ?r } ?r <title> ?title }", _triples(spark, sf_dir))


@query("cql_per_partition_limit", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2")
def cql_per_partition(spark, sf_dir):
    use_tables(spark, sf_dir, "events")
    return run_cql(spark, "SELECT user_id, event_id FROM app.events ORDER BY event_id DESC PER PARTITION LIMIT 2", {"events": (["user_id"], ["event_id"])})


_AT = 1704844800000000  # 2024-01-10
_IN = f"SELECT event_type, ts, epoch_us(ts) AS t, avg(value) AS value FROM events WHERE epoch_us(ts) > {_AT} - 259200000000 AND epoch_us(ts) <= {_AT} GROUP BY event_type, ts"


def _samples(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", "ts").agg(F.avg("value").alias("value"))
    return e.select(F.lit("activity").alias("metric"), "event_type", "ts", "value")


@query("prom_irate", f"""
WITH s AS ({_IN}), p AS (SELECT *, lag(value) OVER w AS pv, lag(t) OVER w AS pt, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM s WINDOW w AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, round((CASE WHEN value < pv THEN value ELSE value - pv END) / ((t - pt) / 1e6), 9) AS value FROM p WHERE r = 1 AND pv IS NOT NULL""")
def prom_irate(spark, sf_dir):
    return run_promql("irate(activity[3d])", _samples(spark, sf_dir), _AT).select("event_type", F.round("value", 9).alias("value"))


@query("prom_predict_linear", f"""
WITH s AS ({_IN}) SELECT event_type, round(regr_intercept(value, (t - {_AT}) / 1e6) + 3600 * regr_slope(value, (t - {_AT}) / 1e6), 4) AS value FROM s GROUP BY event_type HAVING count(*) > 1""")
def prom_predict_linear(spark, sf_dir):
    return run_promql("predict_linear(activity[3d], 3600)", _samples(spark, sf_dir), _AT).select("event_type", F.round("value", 4).alias("value"))


@query("prom_changes_quantile", f"""
WITH s AS ({_IN}), p AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS pv FROM s), c AS (SELECT event_type, sum(CASE WHEN value < pv THEN 1.0 ELSE 0.0 END) AS v FROM p GROUP BY event_type)
SELECT quantile_cont(v, 0.5)::DOUBLE AS value FROM c""")
def prom_changes_quantile(spark, sf_dir):
    return run_promql("quantile(0.5, resets(activity[3d]))", _samples(spark, sf_dir), _AT)


# ------------------------------------------------------- space, signals, JSON functions
_POINTS = "SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey * 1.0 AS y, CAST(c_custkey AS DOUBLE) / 10 AS z FROM customer"
_SHOPS = "SELECT s_suppkey AS id, s_acctbal / 100 AS x, s_nationkey * 1.0 AS y, CAST(s_suppkey AS DOUBLE) / 10 AS z FROM supplier"


def _points(spark, sf_dir, name, p):
    t = table(spark, sf_dir, name)
    return t.select(F.col(f"{p}key").alias("id"), (F.col(f"{p[0]}_acctbal") / 100).alias("x"), (F.col(f"{p[0]}_nationkey") * 1.0).alias("y"), (F.col(f"{p}key").cast("double") / 10).alias("z"))


_D3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("spatial_box", f"SELECT id FROM ({_POINTS}) WHERE x BETWEEN 10 AND 50 AND y BETWEEN 3 AND 9")
def spatial_box(spark, sf_dir):
    return spatial.in_box(_points(spark, sf_dir, "customer", "c_cust"), ["x", "y"], [10, 3], [50, 9]).select("id")


@query("spatial_radius", f"SELECT a.id AS l_id, b.id AS r_id, round({_D3}, 6) AS distance FROM ({_POINTS}) a JOIN ({_SHOPS}) b ON {_D3} <= 7.5")
def spatial_radius(spark, sf_dir):
    out = spatial.radius_join(_points(spark, sf_dir, "customer", "c_cust"), _points(spark, sf_dir, "supplier", "s_supp"), ["x", "y", "z"], 7.5)
    return out.select("l_id", "r_id", F.round("distance", 6).alias("distance"))


@query("spatial_knn", f"""
SELECT l_id, r_id, rank FROM (SELECT b.id AS l_id, a.id AS r_id, row_number() OVER (PARTITION BY b.id ORDER BY {_D3}, a.id) AS rank FROM ({_SHOPS}) b, ({_POINTS}) a) WHERE rank <= 3""")
def spatial_knn(spark, sf_dir):
    out = spatial.knn_join(_points(spark, sf_dir, "supplier", "s_supp"), _points(spark, sf_dir, "customer", "c_cust"), ["x", "y", "z"], 3, 5.0)
    return out.select("l_id", "r_id", F.col("rank").cast("long").alias("rank"))


@query("sig_taper_hann", """
SELECT event_id, round(value * CASE WHEN n = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) END, 6) AS value
FROM (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def sig_taper(spark, sf_dir):
    out = signal.tapered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", "hann")
    return out.select("event_id", F.round("value", 6).alias("value"))


_HOURS = "SELECT epoch_us(ts) // 3600000000 AS h, avg(value) AS v FROM events WHERE event_type = '{}' GROUP BY 1"


@query("sig_correlate", f"""
WITH a AS ({_HOURS.format('click')}), b AS ({_HOURS.format('view')}), l AS (SELECT unnest(range(-3, 4)) AS lag)
SELECT CAST(lag AS INTEGER) AS lag, round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM l, a JOIN b ON b.h = a.h + lag GROUP BY lag""")
def sig_correlate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("h", F.floor(ts.micros("ts") / 3600000000))
    one, two = (e.where(F.col("event_type") == k).groupBy("h").agg(F.avg("value").alias("v")) for k in ("click", "view"))
    out = signal.cross_correlation(one, two, "h", "v", 3)
    return out.select(F.col("lag").cast("int").alias("lag"), F.round("r", 6).alias("r"), "n")


sql("json_functions", "SELECT event_id, jsonb_typeof(props) AS kind, jsonb_extract_path_text(jsonb_build_object('a', event_type, 'b', user_id), 'b') AS b, jsonb_array_length(jsonb_build_array(user_id, user_id + 1)) AS n FROM events",
    "SELECT event_id, 'object' AS kind, CAST(user_id AS VARCHAR) AS b, CAST(2 AS INTEGER) AS n FROM events")


sql("similar_to_pattern", "SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)[1-3]' OR p_name SIMILAR TO '%(red|blue)_%'",
    "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2)[1-3]') OR regexp_full_match(p_name, '.*(red|blue)..*')")
sql("where_without_from", "SELECT 1 AS one WHERE 2 > 1")
sql("stats_shape", """
SELECT event_type, mode(user_id, true) AS common, round(sqrt(count(*) * (count(*) - 1)) / (count(*) - 2) * skewness(value), 6) AS skew,
  round((count(*) - 1) / ((count(*) - 2) * (count(*) - 3)) * ((count(*) + 1) * kurtosis(value) + 6), 6) AS kurt FROM events GROUP BY event_type""",
    """
WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT event_type, user_id AS common FROM c QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) = 1)
SELECT event_type, common, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS kurt FROM events JOIN m USING (event_type) GROUP BY event_type, common""")
