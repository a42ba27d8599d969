"""Queries of the time-series, vector, search and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, search, timeseries as ts, vector
from tessera.plans.registry import query, sql, table

HOUR = 3_600_000_000
_B = f"(epoch_us(ts) // {HOUR}) * {HOUR}"


@query("ts_bucket_each_agg", f"""
SELECT event_type, {_B} AS bucket, round(sum(value), 4) AS sum, count(value) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
  first(value ORDER BY ts, event_id) AS first, last(value ORDER BY ts, event_id) AS last, round(coalesce(stddev_samp(value), 0), 6) AS stddev,
  round(coalesce(var_samp(value), 0), 6) AS variance FROM events GROUP BY event_type, {_B}""")
def ts_bucket_each_agg(spark, sf_dir):
    out = ts.bucketed(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", HOUR, tie="event_id")
    return out.select("event_type", "bucket", F.round("sum", 4).alias("sum"), "count", F.round("mean", 6).alias("mean"), "min", "max", "first", "last", F.round("stddev", 6).alias("stddev"), F.round("variance", 6).alias("variance"))


@query("ts_percentile", "SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90 FROM events GROUP BY event_type")
def ts_percentile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(ts.percentile_index("value", 90).alias("p90"))


@query("ts_range", "SELECT event_id, value FROM events WHERE epoch_us(ts) BETWEEN 1704153600000000 AND 1704240000000000")
def ts_range(spark, sf_dir):
    return ts.in_range(table(spark, sf_dir, "events"), "ts", 1704153600000000, 1704240000000000).select("event_id", "value")


@query("ts_downsample_first_aligned", f"""
WITH f AS (SELECT user_id, min(epoch_us(ts)) AS t0 FROM events GROUP BY user_id)
SELECT user_id, t0 + ((epoch_us(ts) - t0) // {24 * HOUR}) * {24 * HOUR} AS bucket, round(avg(value), 6) AS value FROM events JOIN f USING (user_id) GROUP BY ALL""")
def ts_downsample(spark, sf_dir):
    return ts.downsampled(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 24 * HOUR).select("user_id", "bucket", F.round("value", 6).alias("value"))


_GRID = f"""
WITH b AS (SELECT event_type, {_B} AS bucket, avg(value) AS value FROM events GROUP BY ALL),
g AS (SELECT event_type, unnest(range(min(bucket), max(bucket) + 1, {HOUR})) AS bucket FROM b GROUP BY event_type),
j AS (SELECT g.event_type, g.bucket, b.value FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.bucket = b.bucket)"""


@query("ts_fill_previous", _GRID + " SELECT event_type, bucket, round(last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket), 6) AS value FROM j")
def ts_fill_previous(spark, sf_dir):
    return ts.filled(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", HOUR, "mean", "previous").select("event_type", "bucket", F.round("value", 6).alias("value"))


@query("ts_fill_null", _GRID + " SELECT event_type, bucket, round(value, 6) AS value FROM j")
def ts_fill_null(spark, sf_dir):
    return ts.filled(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", HOUR).select("event_type", "bucket", F.round("value", 6).alias("value"))


@query("ts_interpolate", _GRID + """, n AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN bucket END IGNORE NULLS) OVER w AS t0, last_value(value IGNORE NULLS) OVER w AS v0,
  first_value(CASE WHEN value IS NOT NULL THEN bucket END IGNORE NULLS) OVER x AS t1, first_value(value IGNORE NULLS) OVER x AS v1
  FROM j WINDOW w AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, bucket, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (bucket - t0) / (t1 - t0) END, 5) AS value FROM n""")
def ts_interpolate(spark, sf_dir):
    return ts.filled(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", HOUR, "mean", "linear").select("event_type", "bucket", F.round("value", 5).alias("value"))


@query("ts_gaps", f"""
SELECT user_id, p AS gap_start, t AS gap_end FROM (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE t - p > {12 * HOUR}""")
def ts_gaps(spark, sf_dir):
    return ts.gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", 12 * HOUR, "event_id")


@query("ts_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events")
def ts_moving_avg(spark, sf_dir):
    return ts.moving_average(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 5, "event_id").select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


@query("ts_rate", """
SELECT event_id, round((value - lag(value) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000, 0), 9) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def ts_rate(spark, sf_dir):
    return ts.rate_of_change(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", "event_id").select("event_id", F.round("rate", 9).alias("rate"))


@query("ts_ewm", "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: s * 0.9 + x * 0.1), 6) AS ewm FROM events GROUP BY user_id")
def ts_ewm(spark, sf_dir):
    return ts.ewm(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 0.9, "event_id").select("user_id", F.round("ewm", 6).alias("ewm"))


@query("ts_merge", f"""
WITH a AS (SELECT {_B} AS bucket, round(avg(value), 6) AS v FROM events WHERE event_type = 'click' GROUP BY ALL), b AS (SELECT {_B} AS bucket, round(avg(value), 6) AS v FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT coalesce(a.bucket, b.bucket) AS bucket, coalesce(b.v, a.v) AS mean FROM a FULL JOIN b ON a.bucket = b.bucket""")
def ts_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one, two = (ts.bucketed(e.where(F.col("event_type") == k), [], "ts", "value", HOUR, ["mean"]).withColumn("mean", F.round("mean", 6)) for k in ("click", "view"))
    return ts.merged(one, two, ["bucket"], "mean")


@query("asof_join", """
SELECT c.event_id, v.event_id AS right_event_id, v.value AS right_value FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    out = ts.asof_join(left, right, "user_id", "ts", "ts", "event_id")
    return out.select("event_id", "right_event_id", F.col("value").alias("right_value"))


@query("temporal_overlap_join", """
WITH a AS (SELECT event_id AS id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 3600000000 AS e FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 1800000000 AS e FROM events WHERE event_type = 'view')
SELECT a.id AS l_id, b.id AS r_id FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e""")
def temporal_overlap_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("start", ts.micros("ts"))
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), "start", (F.col("start") + HOUR).alias("end"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("id"), "start", (F.col("start") + HOUR // 2).alias("end"))
    return ts.overlap_join(a, b, HOUR, ["user_id"]).select("l_id", "r_id")


# ------------------------------------------------------------------ vectors
for _name, _op, _duck in (("l2", "<->", "list_distance"), ("cosine", "<=>", "list_cosine_distance"), ("ip", "<#>", "list_inner_product")):
    _sel = "SELECT b.vec_id, round({d}, 6) AS d FROM embeddings a JOIN embeddings b ON a.vec_id = 0 AND b.vec_id <> 0 ORDER BY d " + ("DESC" if _name == "ip" else "ASC") + ", b.vec_id LIMIT 10"
    sql(f"vec_{_name}_topk", _sel.format(d=f"a.embedding {_op} b.embedding"), _sel.format(d=f"{_duck}(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"))


@query("vec_l1_topk", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: abs(q[i] - CAST(embedding[i] AS DOUBLE)))), 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10""")
def vec_l1_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 3").first().embedding
    return vector.top_k(e, "vec_id", "embedding", q, 10, "l1").select("vec_id", F.round("distance", 6).alias("distance"))


@query("vec_normalise", """
SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, len(embedding) AS dims FROM embeddings""")
def vec_normalise(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("long").alias("dims"))


@query("vec_knn_join", """
WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, distance, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) WHERE rank <= 5 GROUP BY query_id, distance""")
def vec_knn_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = vector.knn_join(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return near.groupBy("query_id", F.round("distance", 5).alias("distance")).agg(F.count("*").alias("n"))


@query("vec_ivf_probe")
def vec_ivf_probe(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.ivf_search(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query("vec_lsh_buckets")
def vec_lsh_buckets(spark, sf_dir):
    return vector.hyperplane_codes(table(spark, sf_dir, "embeddings"), "embedding", 8, 64).groupBy("code").agg(F.count("*").alias("n"))


@query("vec_quantise")
def vec_quantise(spark, sf_dir):
    q = vector.quantise(table(spark, sf_dir, "embeddings"), "embedding")
    return q.select("vec_id", F.round(vector.distance("l2", F.col("embedding"), F.col("restored")), 6).alias("error"))


@query("hv_bundle_similarity")
def hv_bundle(spark, sf_dir):
    # hypervectors are made where they are summed and compared; the rows before are too small for Spark to keep its partitions
    e = table(spark, sf_dir, "events").select("user_id", "event_type").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    hv = e.withColumn("hv", vector.bind(vector.random_hv(F.col("event_type")), vector.random_hv(F.lit("event"))))
    whole = vector.bundle(hv, ["user_id"], "hv")
    return hv.join(whole.withColumnRenamed("hv", "sum"), "user_id").select("user_id", "event_type", F.round(vector.similarity(F.col("hv"), F.col("sum")), 4).alias("similarity"))


# ------------------------------------------------------------------- search
_T = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_BM25 = f"""
WITH t AS (SELECT doc_id, {_T} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
p AS (SELECT doc_id AS id, term, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (VALUES ('the'), ('thing'), ('tion')) q(term)),
i AS (SELECT term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p, s WHERE tf > 0 GROUP BY term)
SELECT id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM p JOIN i USING (term), s WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 20"""


@query("bm25", _BM25)
def bm25(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", "the thing tion", 20).select("id", F.round("score", 6).alias("score"))


@query("tfidf_keywords", f"""
WITH t AS (SELECT doc_id AS id, {_T} AS w FROM documents), p AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM t),
c AS (SELECT id, term, dl, count(*) AS tf FROM p GROUP BY id, term, dl), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT id, term, tf / dl * ln((SELECT count(*) FROM documents) / df) AS score FROM c JOIN d USING (term))
SELECT id, round(max(score), 6) AS best, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, term) AS rank FROM s) WHERE rank <= 3 GROUP BY id""")
def tfidf(spark, sf_dir):
    return search.tfidf_keywords(table(spark, sf_dir, "documents"), "doc_id", "text", 3).groupBy("id").agg(F.round(F.max("score"), 6).alias("best"), F.count("*").alias("n"))


@query("rrf_hybrid")
def rrf_hybrid(spark, sf_dir):
    from pyspark.sql.window import Window

    d = table(spark, sf_dir, "documents")
    words = search.bm25(d, "doc_id", "text", "the thing", 50).withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "id")) - 1)
    e = table(spark, sf_dir, "embeddings")
    near = vector.top_k(e, "vec_id", "embedding", e.where("vec_id = 1").first().embedding, 50, "cosine")
    near = near.withColumn("rank", F.row_number().over(Window.orderBy(F.round("distance", 9), "vec_id")) - 1).withColumnRenamed("vec_id", "id")
    return search.rrf([(words, 0.5), (near, 0.5)], 20).select("id", F.round("score", 9).alias("score"))


@query("minhash_dups")
def minhash_dups(spark, sf_dir):
    return search.minhash_near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", 0.8)


@query("keyword_facets", f"SELECT lang, count(*) AS n FROM documents WHERE list_contains({_T}, 'the') AND NOT list_contains({_T}, 'idiot') GROUP BY lang")
def keyword_facets(spark, sf_dir):
    w = search.terms("text")
    return table(spark, sf_dir, "documents").where(F.array_contains(w, "the") & ~F.array_contains(w, "idiot")).groupBy("lang").agg(F.count("*").alias("n"))


# -------------------------------------------------------------------- graph
#: Every customer points to three others, chosen by remainders of its key by the number of customers.
_E = "SELECT DISTINCT c_custkey AS src, (c_custkey * m + c_nationkey) % (SELECT count(*) FROM customer) AS dst FROM customer, (VALUES (7), (11), (13)) v(m)"


def edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    to = [((F.col("c_custkey") * m + F.col("c_nationkey")) % F.lit(c.count())).alias("dst") for m in (7, 11, 13)]
    return c.select(F.col("c_custkey").alias("src"), F.explode(F.array(*to)).alias("dst")).distinct()


@query("graph_bfs", f"WITH RECURSIVE e AS ({_E}), r(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 8) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def graph_bfs(spark, sf_dir):
    return graph.bfs(edges(spark, sf_dir), 3, 8)


@query("graph_neighbors", f"WITH RECURSIVE e AS ({_E}), r(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 2) SELECT DISTINCT node FROM r WHERE node <> 3")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(edges(spark, sf_dir), 3, 2)


@query("graph_components", f"""
WITH RECURSIVE e AS ({_E}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(node, o) AS (SELECT a, a FROM u UNION SELECT u.b, r.o FROM r JOIN u ON u.a = r.node)
SELECT node, min(o) AS component FROM r GROUP BY node""")
def graph_components(spark, sf_dir):
    return graph.connected_components(edges(spark, sf_dir))


def _rank_sql(rounds: int) -> str:
    parts = [f"e AS ({_E})", "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "c AS (SELECT count(*) AS k FROM n)", "o AS (SELECT src, count(*) AS deg FROM e GROUP BY src)", "r0 AS (SELECT node, 1.0::DOUBLE / k AS rank FROM n, c)"]
    for i in range(rounds):
        parts.append(f"l{i} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE node NOT IN (SELECT src FROM o))")
        parts.append(f"g{i} AS (SELECT dst, sum(rank / deg) AS s FROM e JOIN o USING (src) JOIN r{i} ON node = src GROUP BY dst)")
        parts.append(f"r{i + 1} AS (SELECT node, 0.15::DOUBLE / k + 0.85::DOUBLE * lost / k + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM n CROSS JOIN c CROSS JOIN l{i} LEFT JOIN g{i} ON dst = node)")
    return f"WITH {', '.join(parts)} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query("graph_pagerank", _rank_sql(5))
def graph_pagerank(spark, sf_dir):
    return graph.pagerank(edges(spark, sf_dir), 5).select("node", F.round("rank", 9).alias("rank"))


#: The SQL for all pairs is too slow on whole tables; tests compare with brute force.
@query("graph_closeness")
def graph_closeness(spark, sf_dir):
    return graph.closeness(edges(spark, sf_dir)).select("node", F.round("closeness", 6).alias("closeness"))


@query("graph_triangles", f"""
WITH e AS ({_E}), u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst)
SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b""")
def graph_triangles(spark, sf_dir):
    return graph.triangles(edges(spark, sf_dir))


@query("graph_shortest_path", f"""
WITH RECURSIVE e AS ({_E}), r(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < 30),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node),
p(node, pos) AS (SELECT node, depth FROM d WHERE node = 60 UNION ALL SELECT (SELECT min(src) FROM e JOIN d ON d.node = src WHERE dst = p.node AND d.depth = p.pos - 1), pos - 1 FROM p WHERE pos > 0)
SELECT pos, node FROM p""")
def graph_shortest_path(spark, sf_dir):
    path = graph.shortest_path(edges(spark, sf_dir), 3, 60) or []
    return spark.createDataFrame(list(enumerate(path)), "pos int, node long")
