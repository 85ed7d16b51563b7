"""Relational queries: scans, predicates, joins, aggregates, windows, sorting, set operations, CTEs, row changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import filters
from quarry.operators import relational as rel
from quarry.plans.base import Suite

S = Suite()
MONEY = "CAST(round(sum({}), 2) AS DOUBLE)"

S.sql("market_segment_revenue", """
    SELECT c_mktsegment, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue, count(*) AS n_items, round(avg(l_quantity), 4) AS avg_qty
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
    WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
    GROUP BY c_mktsegment ORDER BY revenue DESC, c_mktsegment LIMIT 10""")
# Scans
S.sql("seq_scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity > 45 AND l_discount >= 0.05")
S.sql("index_scan_point", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey = 77")
S.sql("bitmap_scan_ranges", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 20000 OR o_orderpriority = '1-URGENT'")
S.sql("index_only_scan", "SELECT DISTINCT o_orderpriority FROM {orders}")
S.sql("values_result", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
S.sql("range_entries", "WITH x AS (SELECT n_nationkey AS k, n_name AS nm FROM {nation}) SELECT x.nm, s.n FROM x JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s ON s.s_nationkey = x.k")
S.op("generic_scan_keys", lambda t: t.part.where((F.col("p_size") >= 10) & (F.col("p_size") < 20) & (F.col("p_brand") != "Brand#11")).orderBy(F.col("p_partkey").desc()).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11'")
# Projection, predicates, expressions
S.sql("project_star_alias", "SELECT r.*, r_regionkey + 1 AS next_key FROM {region} r")
S.sql("comparison_logic", "SELECT p_partkey FROM {part} WHERE (p_size = 5 OR p_size <> 7 AND p_retailprice <= 1200) AND NOT (p_brand > 'Brand#4')")
S.sql("in_list", "SELECT n_name FROM {nation} WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4)")
S.sql("between_like", "SELECT p_partkey, p_type FROM {part} WHERE p_size BETWEEN 5 AND 15 AND p_size NOT BETWEEN 8 AND 9 AND p_type LIKE '%E%' AND p_name NOT LIKE 'x%'")
S.sql("is_null_is_true", "SELECT c_custkey, (NULLIF(c_mktsegment, 'BUILDING') IS NULL) AS a, ((c_acctbal > 0) IS TRUE) AS b, ((NULLIF(c_acctbal, c_acctbal) > 0) IS FALSE) AS c, ((c_acctbal < 0) IS NOT TRUE) AS d FROM {customer}")
S.sql("arithmetic_concat", "SELECT p_partkey, p_size + 2 * 3 - 1 AS a, p_size % 7 AS b, CAST(p_size AS DOUBLE) / 4 AS c, p_brand || '-' || p_type AS d FROM {part}")
S.sql("json_arrow", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
S.sql("case_nullif_coalesce", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS size_class, COALESCE(NULLIF(o_orderstatus, 'F'), 'done') AS status FROM {orders}")
S.sql("cast_types", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS qi, CAST(l_linenumber AS STRING) AS ls, CAST(l_shipdate AS DATE) AS ld FROM {lineitem}", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS qi, CAST(l_linenumber AS VARCHAR) AS ls, CAST(l_shipdate AS DATE) AS ld FROM lineitem")
S.sql("array_row_subscript", "SELECT vec_id, CAST(embedding[0] AS DOUBLE) AS first_x, size(embedding) AS dims, named_struct('a', vec_id, 'b', label).b AS row_b, array(1, 2, 3)[1] AS two FROM {embeddings}", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_x, CAST(len(embedding) AS INTEGER) AS dims, label AS row_b, 2 AS two FROM embeddings")
S.sql("greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 100, 3) AS g, least(l_quantity, l_tax * 100) AS l FROM {lineitem}")
S.sql("sublinks", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} WHERE o_custkey = c_custkey) AS top_order FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1)")
S.op("parameters", lambda t: t.spark.sql("SELECT s_suppkey, s_name FROM {s} WHERE s_nationkey = :n AND s_acctbal > :b", args={"n": 3, "b": 0.0}, s=t.supplier), "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0")
S.op("set_returning_project", lambda t: t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("double").alias("x")), "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
S.op("text_filter_language", lambda t: t.part.where(filters.text_filter("(p_size >= 10 AND p_brand != 'Brand#11') OR NOT p_retailprice > 1000.5", set(t.part.columns))).select("p_partkey"), "SELECT p_partkey FROM part WHERE (p_size >= 10 AND p_brand <> 'Brand#11') OR NOT p_retailprice > 1000.5")
S.op("json_filter_language", lambda t: t.part.where(filters.json_filter('{"p_size": {"$gte": 5, "$lt": 25}, "$or": [{"p_brand": {"$in": ["Brand#11", "Brand#22"]}}, {"p_retailprice": {"$between": [900, 1000]}}]}')).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size < 25 AND (p_brand IN ('Brand#11', 'Brand#22') OR p_retailprice BETWEEN 900 AND 1000)")
# Joins
for kind, how in (("inner", "inner"), ("left", "left"), ("right", "right"), ("full", "full")):
    S.op(f"hash_join_{kind}", lambda t, how=how: rel.hash_join(t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"), "c_custkey"), t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), "s_suppkey"), ["k"], how), f"SELECT coalesce(c_nationkey, s_nationkey) AS k, c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) {how.upper()} JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON c_nationkey = s_nationkey")
S.op("semi_join", lambda t: rel.hash_join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), t.customer.where("c_acctbal < 0").select("c_custkey"), ["c_custkey"], "left_semi"), "SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
S.op("anti_join", lambda t: t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
S.op("merge_join_duplicates", lambda t: rel.merge_join(t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber"), t.orders.select(F.col("o_orderkey").alias("k"), "o_custkey"), ["k"]), "SELECT l_orderkey AS k, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
S.op("theta_join", lambda t: rel.theta_join(t.nation, t.region, F.col("n_nationkey") < F.col("r_regionkey") * 4).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey < r_regionkey * 4")
S.sql("comma_join", "SELECT r_name, n_name FROM {region}, {nation} WHERE r_regionkey = n_regionkey")
S.sql("cross_join", "SELECT r.r_name AS a, s.r_name AS b FROM {region} r CROSS JOIN {region} s")
S.sql("join_using", "SELECT k, n, m FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) JOIN (SELECT s_nationkey AS k, count(*) AS m FROM {supplier} GROUP BY s_nationkey) USING (k)", "SELECT k, n, m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY s_nationkey) USING (k)")
S.op("broadcast_join", lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")), "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
S.sql("cross_model_join", "SELECT n_name, count(*) AS n_events, count(DISTINCT user_id) AS users FROM {events} JOIN {customer} ON user_id = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE get_json_object(props, '$.k') IS NOT NULL GROUP BY n_name", "SELECT n_name, count(*) AS n_events, count(DISTINCT user_id) AS users FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE props ->> '$.k' IS NOT NULL GROUP BY n_name")
# Aggregation
S.sql("plain_aggregate", "SELECT count(*) AS n, sum(l_linenumber) AS s, min(l_quantity) AS a, max(l_quantity) AS z, round(avg(l_quantity), 4) AS m FROM {lineitem}", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS a, max(l_quantity) AS z, round(avg(l_quantity), 4) AS m FROM lineitem")
S.sql("group_by_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
S.sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
S.sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
S.sql("rollup", "SELECT p_brand, p_size, count(*) AS n FROM {part} GROUP BY ROLLUP (p_brand, p_size)")
S.sql("distinct_on", "SELECT DISTINCT p_brand, p_size FROM {part}")
S.sql("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag")
S.sql("first_last_aggregate", "SELECT user_id, min_by(value, struct(ts, event_id)) AS first_value, max_by(value, struct(ts, event_id)) AS last_value FROM {events} GROUP BY user_id", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
S.sql("percentile_linear", "SELECT event_type, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95, round(percentile(value, 1.0), 6) AS p100 FROM {events} GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 1.0), 6) AS p100 FROM events GROUP BY event_type")
# Windows
S.sql("window_functions", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr,
    lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS nxt, first_value(o_totalprice) OVER w AS fv, ntile(3) OVER w AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS dr,
    lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS nxt, first_value(o_totalprice) OVER w AS fv, CAST(ntile(3) OVER w AS INTEGER) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
S.sql("window_frames", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n3, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_max, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice), 6) AS pr, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {orders}")
# Sort, limit
S.sql("sort_nulls", "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM {customer} ORDER BY seg DESC NULLS LAST, c_custkey LIMIT 50")
S.sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
S.sql("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
# Set operations, CTEs
S.sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
S.sql("union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
S.sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
S.sql("intersect_distinct", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
S.sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
S.sql("except_distinct", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
S.op("cross_model_union", lambda t: t.events.select(F.col("event_id").alias("id"), F.lit("event").alias("model"), "value").unionByName(t.embeddings.select(F.col("vec_id").alias("id"), F.lit("vector").alias("model")), allowMissingColumns=True), "SELECT event_id AS id, 'event' AS model, value FROM events UNION ALL SELECT vec_id, 'vector', NULL FROM embeddings")
S.sql("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN top ON n = m")
S.sql("recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
_SETS = lambda t: [(t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("member"), F.lit(1.0).alias("score")), 2.0), (t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("member"), (F.col("c_custkey") % 5).cast("double").alias("score")), 1.0)]
_DUCK = "(SELECT c_custkey AS member, 2.0::DOUBLE AS score FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, (c_custkey % 5)::DOUBLE FROM customer WHERE c_custkey % 3 = 0)"
S.op("weighted_union", lambda t: rel.weighted_union(_SETS(t)), f"SELECT member, sum(score) AS score FROM {_DUCK} GROUP BY member")
S.op("weighted_union_max", lambda t: rel.weighted_union(_SETS(t), "max"), f"SELECT member, max(score) AS score FROM {_DUCK} GROUP BY member")
S.op("weighted_intersection", lambda t: rel.weighted_intersection(_SETS(t), "min"), f"SELECT member, min(score) AS score FROM {_DUCK} GROUP BY member HAVING count(*) = 2")
# Row changes
S.op("insert_rows", lambda t: rel.Table(t.region).insert(t.spark.createDataFrame([(99, "NOWHERE")], "r_regionkey int, r_name string"))[0].rows, "SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE'")
S.op("update_rows", lambda t: rel.Table(t.part).update(F.col("p_size") > 40, {"p_size": F.lit(40)})[0].rows.select("p_partkey", "p_size"), "SELECT p_partkey, CASE WHEN p_size > 40 THEN 40 ELSE p_size END AS p_size FROM part")
S.op("delete_rows", lambda t: rel.Table(t.part).delete(F.col("p_size") > 40)[0].rows.select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT p_size > 40")
S.op("returning_rows", lambda t: rel.Table(t.part).update(F.col("p_size") > 45, {"p_size": F.col("p_size") - 1})[1].select("p_partkey", "p_size"), "SELECT p_partkey, p_size - 1 AS p_size FROM part WHERE p_size > 45")
S.op("triggers", lambda t: rel.Table(t.region, {"insert": [rel.validate_data(F.length("r_name") > 3)]}, {"insert": [rel.audit_log("insert", "r_regionkey")]}).insert(t.spark.createDataFrame([(7, "LONGER"), (8, "no")], "r_regionkey int, r_name string"))[1], """SELECT 'insert' AS event, '7' AS key, '{"r_regionkey":7,"r_name":"LONGER"}' AS image""")

QUERIES, ORACLES = S.queries, S.oracles
