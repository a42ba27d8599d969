"""Relational queries: scans, expressions, joins, aggregates, windows, sets, subqueries."""

from __future__ import annotations

from tessera.plans.registry import sql

# ------------------------------------------------------------------ TPC-H
sql("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
sql("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, CAST(o_orderdate AS DATE) ORDER BY revenue DESC, l_orderkey LIMIT 10""")
sql("tpch_q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY n_name""")
sql("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
sql("tpch_q10", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("tpch_q12", """
SELECT o_orderpriority, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines, count(*) AS all_lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""", """
SELECT o_orderpriority, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_lines, count(*) AS all_lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
sql("tpch_q14", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-10-01 00:00:00'""")
sql("tpch_q18", """
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS qty
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY o_custkey, o_orderkey, o_totalprice""")

# ------------------------------------------------------- scans and predicates
sql("scan_project_filter", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
sql("columnar_aggregate", "SELECT round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n FROM lineitem")
sql("expr_arithmetic", """
SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 7 AS md, -l_linenumber AS neg, l_extendedprice / l_quantity AS unit,
  (l_linenumber + 3) * 2 - 1 AS a FROM lineitem""")
sql("expr_bitwise", """
SELECT o_orderkey, o_orderkey & 255 AS b_and, o_orderkey | 7 AS b_or, o_orderkey ^ 1023 AS b_xor, ~o_orderkey AS b_not FROM orders""", """
SELECT o_orderkey, o_orderkey & 255 AS b_and, o_orderkey | 7 AS b_or, xor(o_orderkey, 1023) AS b_xor, ~o_orderkey AS b_not FROM orders""")
sql("expr_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label, upper(c_mktsegment) AS up, lower(c_name) AS low, CAST(length(c_name) AS BIGINT) AS n FROM customer")
sql("expr_logic", """
SELECT s_suppkey, (s_acctbal > 0 AND s_nationkey < 10) AS both_true, (s_acctbal < 0 OR s_nationkey >= 10) AS either, NOT (s_acctbal > 0) AS no,
  (s_acctbal > 0) <> (s_nationkey < 10) AS one_only FROM supplier""")
sql("like_between_in", """
SELECT p_partkey, p_name, p_size FROM part WHERE p_name LIKE '%r%' AND p_size BETWEEN 3 AND 40 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_type ILIKE 'pro%'""")
sql("not_like_between", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%red%' AND p_size NOT BETWEEN 10 AND 20 AND p_brand IS NOT NULL")
sql("coalesce_null", """
SELECT c_custkey, coalesce(o.total, 0.0) AS total, CASE WHEN o.total IS NULL THEN 'none' ELSE 'some' END AS has_orders, nullif(c_nationkey, 3) AS nation
FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) o ON o_custkey = c_custkey""")
sql("case_simple", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE 'other' END AS status,
  CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS band FROM orders""")
sql("cast_values", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS s, CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderdate AS DATE) AS d FROM orders",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderdate AS DATE) AS d FROM orders")
sql("string_predicates", "SELECT c_custkey, c_name FROM customer WHERE startswith(c_name, 'Cust') AND endswith(c_name, '7') AND contains(c_name, '1') AND c_name RLIKE '[0-9]{3}$'",
    "SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Cust') AND ends_with(c_name, '7') AND contains(c_name, '1') AND regexp_matches(c_name, '[0-9]{3}$')")
sql("safe_division", "SELECT l_orderkey, l_linenumber, try_divide(l_extendedprice, l_linenumber - 1) AS q FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_linenumber - 1, 0) AS q FROM lineitem")
sql("insert_select_union", "SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_name FROM supplier")
sql("update_rewrite", "SELECT p_partkey, CASE WHEN p_size > 25 THEN round(p_retailprice * 1.1, 2) ELSE p_retailprice END AS p_retailprice FROM part")
sql("delete_rewrite", "SELECT p_partkey, p_name FROM part WHERE NOT (p_size > 25)")

# ------------------------------------------------------------------- joins
sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
sql("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
sql("join_full", """
SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 8000 GROUP BY c_nationkey) a
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b ON a.k = b.k""")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
sql("join_null_keys", """
SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 1) AS k FROM customer) a JOIN (SELECT s_suppkey, nullif(s_nationkey, 1) AS k FROM supplier) b ON a.k = b.k""")
sql("join_residual", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_extendedprice > o_totalprice / 2")
sql("hash_join_count_sum", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'")
sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
sql("join_lateral", "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
sql("triangle_join", """
WITH e AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT count(*) AS triangles FROM e x JOIN e y ON x.b = y.a JOIN e z ON y.b = z.a AND z.b = x.a""")

# -------------------------------------------------------------- aggregation
sql("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("group_by_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
sql("group_by_case", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END")
sql("group_null_key", "SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'P')")
sql("agg_empty", "SELECT count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
sql("agg_stddev", "SELECT o_orderpriority, round(stddev_samp(o_totalprice), 4) AS sd, round(var_pop(o_totalprice) / 1e6, 4) AS vp FROM orders GROUP BY o_orderpriority")
sql("string_agg", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("array_agg", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("agg_first_last", "SELECT user_id, min_by(value, struct(ts, event_id)) AS first_value, max_by(value, struct(ts, event_id)) AS last_value FROM events GROUP BY user_id",
    "SELECT user_id, first(value ORDER BY ts, event_id) AS first_value, last(value ORDER BY ts, event_id) AS last_value FROM events GROUP BY user_id")

# ------------------------------------------------------------------ windows
W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("win_row_number", f"SELECT o_orderkey, CAST(row_number() OVER ({W}) AS BIGINT) AS rn FROM orders")
sql("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS d FROM part")
sql("win_percent_rank", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS cd FROM part")
sql("win_ntile", f"SELECT o_orderkey, ntile(4) OVER ({W}) AS t FROM orders", f"SELECT o_orderkey, CAST(ntile(4) OVER ({W}) AS INTEGER) AS t FROM orders")
sql("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice, 1, -1.0) OVER ({W}) AS prev, lead(o_totalprice, 2) OVER ({W}) AS nxt FROM orders")
sql("win_first_last_nth", f"""
SELECT o_orderkey, first_value(o_totalprice) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
  last_value(o_totalprice) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
  nth_value(o_totalprice, 2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM orders""")
sql("win_sum_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, count(*) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders")
sql("win_avg_range", "SELECT p_partkey, round(avg(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS a FROM part")
sql("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part")
sql("win_nested", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS diff FROM customer")
sql("win_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
sql("win_min_max", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events")

# --------------------------------------------------------- sort and limits
sql("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 0)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
sql("null_order", "SELECT k, row_number() OVER (ORDER BY k ASC NULLS LAST) AS up, row_number() OVER (ORDER BY k DESC NULLS FIRST) AS down FROM (SELECT DISTINCT nullif(c_nationkey, 5) AS k FROM customer)",
    "SELECT k, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST) AS INTEGER) AS up, CAST(row_number() OVER (ORDER BY k DESC NULLS FIRST) AS INTEGER) AS down FROM (SELECT DISTINCT nullif(c_nationkey, 5) AS k FROM customer)")

# --------------------------------------------- set operations and subqueries
sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("cte_chain", """
WITH totals AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), large AS (SELECT * FROM totals WHERE t > 1000000)
SELECT c_nationkey, count(*) AS n FROM large JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""")
sql("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM r WHERE n < 12) SELECT n, f FROM r")
sql("scalar_subquery", "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS diff FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql("correlated_subquery", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
sql("exists_subquery", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)")
sql("any_subquery", "SELECT p_partkey FROM part WHERE p_retailprice < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)")
sql("all_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 12)")
sql("values_table", "SELECT v.k, v.name, count(n_nationkey) AS n FROM (VALUES (0, 'a'), (1, 'b'), (9, 'c')) AS v(k, name) LEFT JOIN nation ON n_regionkey = v.k GROUP BY v.k, v.name")
