"""Queries of the other models: text, vectors, graphs, space, documents, keys, trees, Datalog, retrieval, catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.registry import standard
from quarry.operators import catalog, datalog, document, graph, kv, rag, spatial, text, timeseries, tree, vector
from quarry.operators import relational as rel
from quarry.plans.base import Suite
from quarry.sources import copy
from quarry.streaming import run
from quarry.streaming import windows as win

S = Suite()
TOKENS = "[w FOR w IN string_split_regex(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') IF w <> '']"

# Streams
S.op("stream_tumbling", lambda t: run.drain(win.stream_windows(run.table_stream(t.spark, t.sf_dir, "events"), "ts", "1 day"), "complete").select("window_start", "window_end", "value_count", F.round("value_sum", 2).alias("value_sum")), "SELECT (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 AS window_start, window_start + 86400000 AS window_end, count(*) AS value_count, round(sum(value), 2) AS value_sum FROM events GROUP BY ALL")
S.op("stream_sliding", lambda t: run.drain(win.stream_windows(run.table_stream(t.spark, t.sf_dir, "events"), "ts", "12 hours", "6 hours"), "complete").select("window_start", "value_count"), "SELECT w AS window_start, count(*) AS value_count FROM (SELECT unnest([(epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 21600000, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 21600000 - 21600000]) AS w FROM events) GROUP BY w")


def _stream_join(t) -> DataFrame:
    stream = run.table_stream(t.spark, t.sf_dir, "events")
    left = stream.where("event_type = 'click'").select(F.col("event_id").alias("l"), F.col("ts").alias("lts"))
    right = run.table_stream(t.spark, t.sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("r"), F.col("ts").alias("rts"))
    return run.drain(win.stream_interval_join(left, right, "lts", "rts", 60, "30 days")).select("l", "r")


S.op("stream_interval_join", _stream_join, "SELECT a.event_id AS l, b.event_id AS r FROM events a JOIN events b ON a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 60 SECONDS AND a.ts + INTERVAL 60 SECONDS")


def _continuous(t) -> DataFrame:
    folder = run.shared(t.spark) + "/rollup"
    stream = run.table_stream(t.spark, t.sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value", "event_type")
    run.drain(stream, each=win.refresh_rollup(t.spark, folder, 3_600_000, ["event_type"]))
    return timeseries.merge_states(t.spark.read.parquet(folder), 86_400_000, ["event_type"]).select("event_type", "bucket", "count", F.round("sum", 2).alias("sum"), "max")


S.op("continuous_aggregate", _continuous, "SELECT event_type, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 AS bucket, count(value) AS count, round(sum(value), 2) AS sum, max(value) AS max FROM events GROUP BY ALL")

# Text
S.op("tokenize", lambda t: t.documents.select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"), F.array_join(F.slice(text.tokens(F.col("text")), 1, 5), " ").alias("head")), f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS n, array_to_string(({TOKENS})[1:5], ' ') AS head FROM documents")
S.op("tokenize_pipeline", lambda t: t.documents.select("doc_id", F.size(text.tokens(F.col("text"), 2)).alias("n")), f"SELECT doc_id, CAST(len([x FOR x IN {TOKENS} IF length(x) >= 2]) AS INTEGER) AS n FROM documents")
S.op("postings", lambda t: text.postings(t.benchmark, "item_id", text.tokens(F.col("text"))).select("item_id", "term", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")), f"WITH x AS (SELECT item_id, unnest({TOKENS}) AS term, generate_subscripts({TOKENS}, 1) - 1 AS pos FROM benchmark) SELECT item_id, term, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM x GROUP BY ALL")
QUERY = ["then", "thering", "with", "idiot"]
_BM = lambda idf, gain: f"""WITH d AS (SELECT doc_id, {TOKENS} AS toks FROM documents), s AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM d),
    q AS (SELECT unnest(['then', 'thering', 'with', 'idiot']) AS term), p AS (SELECT doc_id, term, len([x FOR x IN toks IF x = term]) AS tf, len(toks) AS l FROM d, q WHERE list_contains(toks, term)),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT doc_id, round(sum({idf} * {gain}), 4) AS score FROM p JOIN f USING (term), s GROUP BY doc_id"""  # noqa: E731
_GAIN = "(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a)))"
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"
S.op("bm25", lambda t: text.bm25(t.documents, "doc_id", "text", QUERY).withColumn("score", F.round("score", 4)), _BM(_IDF, _GAIN))
S.op("bm25_plus", lambda t: text.bm25(t.documents, "doc_id", "text", QUERY, delta=1.0).withColumn("score", F.round("score", 4)), _BM(_IDF, f"({_GAIN} + 1.0)"))
S.op("bm25_pipeline", lambda t: text.bm25(t.documents, "doc_id", "text", QUERY, kind="pipeline").withColumn("score", F.round("score", 4)), _BM("greatest(ln((n - df + 0.5) / (df + 0.5)), 0)", "(tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / floor(a))))"))
S.op("bm25f_fields", lambda t: text.bm25_fields(t.documents, "doc_id", {"text": 1.0, "source": 2.0}, ["then", "src3"]))
S.op("full_text_match", lambda t: t.documents.where(text.match(F.col("text"), "Idiot clown moron", 2)).select("doc_id"), f"SELECT doc_id FROM documents WHERE (list_contains({TOKENS}, 'idiot')::INT + list_contains({TOKENS}, 'clown')::INT + list_contains({TOKENS}, 'moron')::INT) >= 2")
S.op("fuzzy_search", lambda t: t.benchmark.where(text.fuzzy_match(F.col("text"), "there", 1)).select("item_id"), f"SELECT item_id FROM benchmark WHERE len([x FOR x IN {TOKENS} IF levenshtein(x, 'there') <= 1]) > 0")
S.op("phrase_search", lambda t: t.documents.where(text.phrase(F.col("text"), ["of", "the"])).select("doc_id"), f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')")
S.op("highlight", lambda t: t.benchmark.select("item_id", text.highlight(F.col("text"), ["the", "with"]).alias("marked")), "SELECT item_id, regexp_replace(text, '(?i)\\b(the|with)\\b', '<em>\\1</em>', 'g') AS marked FROM benchmark")
S.op("text_search_top_k", lambda t: text.top(text.bm25(t.documents, "doc_id", "text", QUERY).withColumn("score", F.round("score", 4)), "doc_id", 10), f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ({_BM(_IDF, _GAIN)}) ORDER BY score DESC, doc_id LIMIT 10")

# Vectors; the query is the first vector
_Q = lambda t: [float(x) for x in t.embeddings.orderBy("vec_id").select("embedding").first()[0]]
_QV = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_D = {"l2": "sqrt(list_sum([(e.embedding[i]::DOUBLE - q[i]::DOUBLE) ** 2 FOR i IN range(1, len(q) + 1)]))", "ip": "-list_sum([e.embedding[i]::DOUBLE * q[i]::DOUBLE FOR i IN range(1, len(q) + 1)])"}
_D["l2_squared"] = f"({_D['l2']}) ** 2"
_D["cosine"] = "1 + (" + _D["ip"] + ") / sqrt(list_sum([x::DOUBLE ** 2 FOR x IN e.embedding]) * list_sum([x::DOUBLE ** 2 FOR x IN q]))"
for m in ("l2", "l2_squared", "cosine", "ip"):
    S.op(f"vector_distance_{m}", lambda t, m=m: t.embeddings.select("vec_id", (F.round(vector.distance(F.col("embedding"), vector.literal(_Q(t)), m), 5) + 0.0).alias("d")), f"SELECT vec_id, round({_D[m]}, 5) + 0.0 AS d FROM embeddings e, {_QV}")
S.op("vector_knn", lambda t: vector.knn(t.embeddings, "vec_id", _Q(t), 10).select("vec_id", F.round("distance", 5).alias("distance"), "rank"), f"SELECT vec_id, round({_D['l2']}, 5) AS distance, CAST(row_number() OVER (ORDER BY {_D['l2']}, vec_id) AS INTEGER) AS rank FROM embeddings e, {_QV} ORDER BY rank LIMIT 10")
S.op("vector_filtered_knn", lambda t: vector.knn(t.embeddings, "vec_id", _Q(t), 5, "cosine", F.col("label") == 3).select("vec_id", "rank"), f"SELECT vec_id, CAST(row_number() OVER (ORDER BY {_D['cosine']}, vec_id) AS INTEGER) AS rank FROM embeddings e, {_QV} WHERE label = 3 ORDER BY rank LIMIT 5")
S.op("vector_radius", lambda t: vector.within_radius(t.embeddings, "vec_id", _Q(t), 1.2).select("vec_id"), f"SELECT vec_id FROM embeddings e, {_QV} WHERE {_D['l2']} <= 1.2")
S.op("vector_offset", lambda t: vector.knn(t.embeddings, "vec_id", _Q(t), 5, offset=3).select("vec_id", "rank"), f"SELECT vec_id, CAST(row_number() OVER (ORDER BY {_D['l2']}, vec_id) AS INTEGER) AS rank FROM embeddings e, {_QV} ORDER BY rank LIMIT 5 OFFSET 3")


def _ivf(t) -> DataFrame:
    index, centres = vector.ivf_index(t.embeddings, 16)
    return vector.ivf_search(index, centres, "vec_id", _Q(t), 10, 13)


S.op("vector_ivf", _ivf)
S.op("vector_lsh", lambda t: vector.lsh_search(t.embeddings, "vec_id", _Q(t), 10))
S.op("vector_binary_codes", lambda t: t.embeddings.select("vec_id", vector.hyperplane_bits(F.col("embedding"), 64).alias("code")))


def _pq(t) -> DataFrame:
    centres = vector.product_quantiser(t.embeddings, 16, 16, 64)
    coded = t.embeddings.withColumn("codes", vector.product_codes(F.col("embedding"), centres))
    return vector.two_stage(coded, "vec_id", _Q(t), 10, max(100, t.embeddings.count() // 3), centres)  # candidates grow with the table


S.op("vector_pq_two_stage", _pq)
S.op(
    "vector_scalar_quantised",
    lambda t: (lambda q: vector.knn(q[0].withColumn("embedding", vector.dequantised(F.col("codes"), q[1], q[2])), "vec_id", _Q(t), 10).select("vec_id", F.round("distance", 5).alias("distance"), "rank"))(vector.scalar_quantised(t.embeddings)),
    f"WITH r AS (SELECT min(list_min(embedding))::DOUBLE AS low, max(list_max(embedding))::DOUBLE AS high FROM embeddings), e AS (SELECT vec_id, [low + round((x::DOUBLE - low) / ((high - low) / 255)) * ((high - low) / 255) FOR x IN embedding] AS embedding FROM embeddings, r) SELECT vec_id, round({_D['l2']}, 5) AS distance, CAST(row_number() OVER (ORDER BY {_D['l2']}, vec_id) AS INTEGER) AS rank FROM e, {_QV} ORDER BY rank LIMIT 10",
)
S.op("vector_mmr", lambda t: vector.mmr(vector.knn(t.embeddings, "vec_id", _Q(t), 30).join(t.embeddings.select("vec_id", "embedding"), "vec_id").withColumn("query_id", F.lit(0)), "vec_id", "query_id", 10, 0.7))
S.op("vector_multi_metric", lambda t: vector.multi_metric(t.embeddings.select("vec_id", vector.distance(F.col("embedding"), vector.literal(_Q(t)), "l2").alias("a"), vector.distance(F.col("embedding"), vector.literal(_Q(t)), "cosine").alias("b")), "vec_id", {"a": 0.6, "b": 0.4}).select("vec_id", F.round("score", 5).alias("score")), f"WITH x AS (SELECT vec_id, {_D['l2']} AS a, {_D['cosine']} AS b FROM embeddings e, {_QV}) SELECT vec_id, round(0.6 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.4 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 5) AS score FROM x")
S.op("vector_soft_delete", lambda t: vector.live(t.embeddings, t.embeddings.where("vec_id % 7 = 0"), "vec_id").select("vec_id"), "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
S.op("vector_delta_merge", lambda t: vector.merged_delta(t.embeddings.select("vec_id", "label"), t.embeddings.where("vec_id < 30").select("vec_id", (F.col("label") + 100).alias("label")), "vec_id"), "SELECT vec_id, CASE WHEN vec_id < 30 THEN label + 100 ELSE label END AS label FROM embeddings")


def _lists(t) -> tuple[DataFrame, DataFrame]:
    words = text.top(text.bm25(t.documents, "doc_id", "text", QUERY), "doc_id", 20)
    near = vector.knn(t.embeddings, "vec_id", _Q(t), 20).select(F.col("vec_id").alias("doc_id"), "rank", (1 / (1 + F.col("distance"))).alias("score"))
    return words.select("doc_id", "rank", "score"), near


S.op("hybrid_rrf", lambda t: text.rrf(list(_lists(t)), "doc_id", 60).withColumn("score", F.round("score", 6)), f"WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_BM(_IDF, _GAIN).replace('round(', 'round(').replace(', 4) AS score', ', 12) AS score')}) ORDER BY rank LIMIT 20), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_D['l2']}, vec_id) AS rank FROM embeddings e, {_QV} ORDER BY rank LIMIT 20) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM v) GROUP BY doc_id")
S.op("hybrid_weighted", lambda t: text.weighted_fusion(*[text.min_max(x) for x in _lists(t)], "doc_id", 0.4))

# Graphs: customers' nations and regions as one hierarchy, and suppliers with shared parts
_V = lambda t: t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.array(F.lit("nation")).alias("labels"), F.create_map(F.lit("name"), "n_name").alias("props")).union(t.region.select(F.col("r_regionkey").cast("long"), F.array(F.lit("region")), F.create_map(F.lit("name"), "r_name"))).union(t.supplier.select((F.col("s_suppkey") + 1000).cast("long"), F.array(F.lit("supplier")), F.create_map(F.lit("name"), "s_name")))
_E = lambda t: t.nation.select((F.col("n_nationkey") + 100).cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), F.lit("in_region").alias("type"), (F.col("n_nationkey") % 3 + 1.0).alias("weight")).union(t.supplier.select((F.col("s_suppkey") + 1000).cast("long"), (F.col("s_nationkey") + 100).cast("long"), F.lit("in_nation"), F.lit(1.0)))
_DE = "(SELECT n_nationkey + 100::BIGINT AS src, n_regionkey::BIGINT AS dst, 'in_region' AS type, n_nationkey % 3 + 1.0 AS weight FROM nation UNION ALL SELECT s_suppkey + 1000, s_nationkey + 100, 'in_nation', 1.0 FROM supplier)"
_BOTH = f"(SELECT src, dst, weight FROM {_DE} UNION ALL SELECT dst, src, weight FROM {_DE})"
S.op("graph_neighbours", lambda t: graph.neighbours(_E(t), 101, "both"), f"SELECT DISTINCT dst AS id FROM {_BOTH} WHERE src = 101")
S.op("graph_traverse", lambda t: graph.traverse(_E(t), 1, 3, "both").select("id", "depth"), f"WITH RECURSIVE r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT b.dst, depth + 1 FROM r JOIN {_BOTH} b ON b.src = r.id WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id")
S.op("graph_scan", lambda t: graph.degrees(_E(t)), f"SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {_DE} UNION ALL SELECT dst, 1, 0 FROM {_DE}) GROUP BY id")
S.op("graph_centrality", lambda t: graph.degree_centrality(_E(t)).withColumn("centrality", F.round("centrality", 6)), f"WITH d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM {_DE} UNION ALL SELECT dst FROM {_DE}) GROUP BY id) SELECT id, round(n / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d")
S.op("graph_shortest_path", lambda t: graph.shortest_path(_E(t), 101, 103, "both", 8).select("length", F.size("path").alias("n")), f"WITH RECURSIVE r(id, depth) AS (SELECT 101::BIGINT, 0 UNION SELECT b.dst, depth + 1 FROM r JOIN {_BOTH} b ON b.src = r.id WHERE depth < 6) SELECT min(depth) AS length, min(depth) + 1 AS n FROM r WHERE id = 103 HAVING min(depth) IS NOT NULL")
S.op("graph_weighted_distances", lambda t: graph.distances(_E(t), 1001, "out"), f"WITH RECURSIVE r(id, distance) AS (SELECT 1001::BIGINT, 0.0::DOUBLE UNION SELECT e.dst, distance + e.weight FROM r JOIN {_DE} e ON e.src = r.id) SELECT id, min(distance) AS distance FROM r GROUP BY id")
S.op("graph_k_shortest", lambda t: graph.k_shortest_paths(_E(t), 101, 103, 3, 3, "both").select("distance"), f"WITH RECURSIVE b AS (SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM {_DE} UNION ALL SELECT dst, src, weight FROM {_DE}) GROUP BY ALL), p(path, here, d) AS (SELECT [101::BIGINT], 101::BIGINT, 0.0::DOUBLE UNION ALL SELECT list_append(path, b.dst), b.dst, d + b.weight FROM p JOIN b ON b.src = p.here WHERE NOT list_contains(path, b.dst) AND len(path) <= 3 AND here <> 103) SELECT d AS distance FROM p WHERE here = 103 ORDER BY d LIMIT 3")
S.op("graph_pagerank", lambda t: graph.pagerank(_E(t), rounds=30))
S.op("graph_components", lambda t: graph.components(_E(t)), f"WITH RECURSIVE r(id, c) AS (SELECT src, src FROM {_BOTH} UNION SELECT r.id, b.dst FROM r JOIN {_BOTH} b ON b.src = r.c) SELECT id, min(c) AS component FROM r GROUP BY id")
S.op("graph_strong_components", lambda t: graph.strong_components(_E(t).union(_E(t).where("type = 'in_region' and src % 2 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight"))), f"WITH RECURSIVE x AS (SELECT src, dst FROM {_DE} UNION SELECT dst, src FROM {_DE} WHERE type = 'in_region' AND src % 2 = 0), r(a, b) AS (SELECT src, src FROM x UNION SELECT dst, dst FROM x UNION SELECT r.a, x.dst FROM r JOIN x ON x.src = r.b) SELECT p.a AS id, max(p.b) AS component FROM r p JOIN r q ON p.a = q.b AND p.b = q.a GROUP BY p.a")
S.op("graph_communities", lambda t: graph.communities(_E(t)))
S.op("graph_statistics", lambda t: graph.statistics(_E(t)).select("vertices", "edges", "min_degree", "max_degree", "triangles", F.round("density", 8).alias("density")), f"WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_DE} WHERE src <> dst), d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id) SELECT count(*) AS vertices, (SELECT count(*) FROM u) AS edges, min(n) AS min_degree, max(n) AS max_degree, (SELECT count(*) FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) AS triangles, round(2.0 * (SELECT count(*) FROM u) / (count(*) * (count(*) - 1)), 8) AS density FROM d")
S.op("graph_subgraph", lambda t: graph.subgraph(_E(t), _V(t).where("id < 1000")).select("src", "dst"), f"SELECT src, dst FROM {_DE} WHERE src < 1000 AND dst < 1000")
S.op("graph_common_neighbours", lambda t: graph.common_neighbours(_E(t), 101, 102), f"SELECT dst AS id FROM {_BOTH} WHERE src = 101 INTERSECT SELECT dst FROM {_BOTH} WHERE src = 102")
S.op("graph_pattern", lambda t: graph.query(_V(t), _E(t), "MATCH (s:supplier)-[:in_nation]->(n:nation)-[:in_region]->(r:region) WHERE r.name STARTS WITH 'A' RETURN r.name AS region, n.name AS nation, count(*) AS suppliers ORDER BY region, nation LIMIT 100"), "SELECT r_name AS region, n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE starts_with(r_name, 'A') GROUP BY ALL")
S.op("graph_variable_length", lambda t: graph.query(_V(t), _E(t), "MATCH (s:supplier)-[*1..2]->(x) RETURN DISTINCT id(x) AS x"), "SELECT DISTINCT s_nationkey + 100::BIGINT AS x FROM supplier UNION SELECT DISTINCT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")

# Space: parts as points
_P = lambda t: t.part.select("p_partkey", (F.col("p_partkey") % 100).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
_DP = "(SELECT p_partkey, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part)"
POLYGON = "POLYGON ((10 5, 60 5, 60 40, 10 40, 10 5), (20 10, 30 10, 30 20, 20 20, 20 10))"
S.op("spatial_box", lambda t: spatial.box_search(_P(t), "x", "y", 2, 2, 30, 10), f"SELECT * FROM {_DP} WHERE x BETWEEN 2 AND 30 AND y BETWEEN 2 AND 10")
S.op("spatial_knn", lambda t: spatial.nearest(_P(t), "p_partkey", "x", "y", 0.0, 0.0, 10).withColumn("distance", F.round("distance", 6)), f"SELECT p_partkey, x, y, round(sqrt(x * x + y * y), 6) AS distance, CAST(row_number() OVER (ORDER BY sqrt(x * x + y * y), p_partkey) AS INTEGER) AS rank FROM {_DP} ORDER BY rank LIMIT 10")
S.op("spatial_contains", lambda t: _P(t).where(spatial.contains(spatial.parse_wkt(F.lit(POLYGON)), spatial.point(F.col("x"), F.col("y")))).select("p_partkey"), f"SELECT p_partkey FROM {_DP} WHERE x BETWEEN 10 AND 60 AND y BETWEEN 5 AND 40 AND NOT (x > 20 AND x < 30 AND y > 10 AND y < 20)")
S.op("spatial_distance", lambda t: _P(t).select("p_partkey", F.round(spatial.distance(spatial.point(F.col("x"), F.col("y")), spatial.parse_wkt(F.lit("LINESTRING (0 0, 100 0)"))), 6).alias("d")), f"SELECT p_partkey, y AS d FROM {_DP}")
S.op("spatial_intersects", lambda t: _P(t).where(spatial.intersects(spatial.buffer(F.col("x"), F.col("y"), 2.0, 4), spatial.parse_wkt(F.lit("LINESTRING (0 20, 100 20)")))).select("p_partkey"), f"SELECT p_partkey FROM {_DP} WHERE abs(y - 20) <= 2 AND x BETWEEN -2 AND 102")
S.op("spatial_sphere", lambda t: _P(t).select("p_partkey", F.round(spatial.sphere_distance(F.lit(0.0), F.lit(0.0), F.col("y"), F.col("x")), 1).alias("m")), f"SELECT p_partkey, round(2 * 6371000.0 * asin(sqrt(sin(radians(y) / 2) ** 2 + cos(radians(y)) * sin(radians(x) / 2) ** 2)), 1) AS m FROM {_DP}")
S.op("spatial_join", lambda t: spatial.distance_join(_P(t), _P(t).select(F.col("p_partkey").alias("q"), F.col("x").alias("x2"), F.col("y").alias("y2")), 3.0, "x", "y", "x2", "y2").select("p_partkey", "q"), f"SELECT a.p_partkey, b.p_partkey AS q FROM {_DP} a, {_DP} b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3.0")
S.op("spatial_wkt_round_trip", lambda t: _P(t).select("p_partkey", spatial.to_wkt(spatial.parse_wkt(F.format_string("POINT (%.1f %.1f)", "x", "y"))).alias("wkt"), spatial.box_area(spatial.bbox(spatial.parse_wkt(F.lit(POLYGON)))).alias("area")), f"SELECT p_partkey, 'POINT (' || CAST(CAST(x AS INT) AS VARCHAR) || ' ' || CAST(CAST(y AS INT) AS VARCHAR) || ')' AS wkt, 1750.0::DOUBLE AS area FROM {_DP}")
S.op("spatial_hilbert", lambda t: _P(t).select("p_partkey", spatial.hilbert(F.col("x"), F.col("y"), 7).alias("h")))

# Documents
S.op("doc_scan", lambda t: document.scan(t.events, "event_id", "props", "$.k"), "SELECT event_id AS doc_id, props ->> '$.k' AS value, '$.k' AS json_path FROM events WHERE props ->> '$.k' IS NOT NULL ORDER BY 1 LIMIT 100")
S.op("doc_json_functions", lambda t: t.events.select("event_id", document.json_type(F.col("props")).alias("kind"), document.object_size(F.col("props")).alias("n")), "SELECT event_id, lower(json_type(props)) AS kind, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events")
S.op("doc_deep_path", lambda t: t.events.select("event_id", F.array_join(document.find_all(F.concat(F.lit('{"a": [{"p": '), "props", F.lit("}]}")), "$..k"), ",").alias("k")), "SELECT event_id, props ->> '$.k' AS k FROM events")
S.op("doc_partial_update", lambda t: t.events.select("event_id", document.update_json(F.col("props"), "k bigint", [("INCREMENT", "k", F.lit(5)), ("SET", "seen", F.lit(True))]).alias("doc")), """SELECT event_id, '{"k":' || (CAST(props ->> '$.k' AS BIGINT) + 5) || ',"seen":true}' AS doc FROM events""")
S.op("doc_terms", lambda t: document.terms(t.events, "event_type", 3).withColumn("percent", F.round("percent", 4)), "SELECT event_type AS term, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
S.op("doc_ranges", lambda t: document.ranges(t.events, "value", [("low", None, 10.0), ("mid", 10.0, 50.0), ("high", 50.0, None)]).select("bucket", "count", F.round("avg", 8).alias("avg")), "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS count, round(avg(value), 8) AS avg FROM events GROUP BY 1")
S.op("doc_histogram", lambda t: document.histogram(t.events, "value", 20.0), "WITH c AS (SELECT CAST(floor(value / 20) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1) SELECT s.k * 20.0::DOUBLE AS bucket, coalesce(n, 0) AS count FROM (SELECT unnest(generate_series((SELECT min(k) FROM c), (SELECT max(k) FROM c))) AS k) s LEFT JOIN c ON c.k = s.k")
S.op("doc_stats", lambda t: t.events.groupBy("event_type").agg(*document.stats("value")).select("event_type", "count", "min", "max", *(F.round(c, 8).alias(c) for c in ("avg", "std", "median")), F.round("variance", 6).alias("variance")), "SELECT event_type, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 8) AS avg, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 8) AS std, round(median(value), 8) AS median FROM events GROUP BY 1")
S.op("doc_percentiles", lambda t: t.events.agg(document.percentiles("value", [25, 50, 99]).alias("p")).select(*(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p99")))), "SELECT round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
S.op("doc_cardinality", lambda t: t.lineitem.agg(document.cardinality("l_partkey").alias("n")))
_DAYS = lambda t: t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
_DDAYS = "(SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)"
S.op("pipeline_cumulative_sum", lambda t: document.cumulative_sum(_DAYS(t), "day", "n"), f"SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS cumulative FROM {_DDAYS}")
S.op("pipeline_moving_average", lambda t: document.moving_average(_DAYS(t), "day", "n", 3).withColumn("moving", F.round("moving", 4)), f"SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS 2 PRECEDING), 4) AS moving FROM {_DDAYS}")
S.op("pipeline_bucket_sort", lambda t: document.bucket_sort(_DAYS(t), "n", 5, 2), f"SELECT day, n FROM {_DDAYS} ORDER BY n DESC, day LIMIT 5 OFFSET 2")
S.op("pipeline_stats", lambda t: _DAYS(t).agg(F.avg("n").alias("avg"), F.sum("n").alias("sum"), F.min("n").alias("min"), F.max("n").alias("max")).withColumn("avg", F.round("avg", 4)), f"SELECT round(avg(n), 4) AS avg, CAST(sum(n) AS BIGINT) AS sum, min(n) AS min, max(n) AS max FROM {_DDAYS}")

# Keys, sorted sets
_KV = lambda t: t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
_Z = lambda t: t.part.select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("member"), F.col("p_retailprice").alias("score"))
_DZ = "(SELECT p_brand AS set, p_partkey AS member, p_retailprice AS score FROM part)"
S.op("kv_lookup", lambda t: kv.get(_KV(t), 17), "SELECT p_partkey AS key, p_name AS value FROM part WHERE p_partkey = 17")
S.op("kv_range_scan", lambda t: kv.scan(_KV(t), 10, 40), "SELECT p_partkey AS key, p_name AS value FROM part WHERE p_partkey >= 10 AND p_partkey < 40")
S.op("kv_batch_get", lambda t: kv.batch_get(_KV(t), t.nation.select(F.col("n_nationkey").cast("long").alias("key"))), "SELECT p_partkey AS key, p_name AS value FROM part WHERE p_partkey IN (SELECT n_nationkey FROM nation)")
S.op("kv_put_delete", lambda t: kv.delete(kv.put(_KV(t), t.spark.createDataFrame([(3, "new"), (-1, "low")], "key long, value string")), t.spark.createDataFrame([(5,)], "key long")), "SELECT p_partkey AS key, CASE WHEN p_partkey = 3 THEN 'new' ELSE p_name END AS value FROM part WHERE p_partkey <> 5 UNION ALL SELECT -1, 'low'")
S.op("kv_latest", lambda t: kv.latest(t.events.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("version"))).select("key", "value"), "SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY 1")
S.op("kv_ttl", lambda t: kv.alive(t.events.select(F.col("event_id").alias("key"), (F.col("ts") + F.expr("interval 7 days")).alias("expire_at")), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("key"), "SELECT event_id AS key FROM events WHERE ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-20 00:00:00'")
S.op("zset_range", lambda t: kv.zrange(_Z(t), 0, 2).select("set", "member", "rank"), f"SELECT set, member, CAST(row_number() OVER (PARTITION BY set ORDER BY score, member) - 1 AS INTEGER) AS rank FROM {_DZ} QUALIFY rank <= 2")
S.op("zset_reverse_range", lambda t: kv.zrange(_Z(t), -2, -1, True).select("set", "member"), f"SELECT set, member FROM {_DZ} QUALIFY row_number() OVER (PARTITION BY set ORDER BY score, member) <= 2")
S.op("zset_rank_score", lambda t: kv.zrank(_Z(t), 17).join(kv.zrangebyscore(_Z(t), 0, 1e9).where("member = 17"), "set").select("set", "rank", "score"), f"SELECT set, rank, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY set ORDER BY score, member) - 1 AS INTEGER) AS rank FROM {_DZ}) WHERE member = 17")
S.op("zset_count_card", lambda t: kv.zcount(_Z(t), 1000, 1500).join(kv.zcard(_Z(t)), "set"), f"SELECT set, count(*) FILTER (WHERE score BETWEEN 1000 AND 1500) AS count, count(*) AS card FROM {_DZ} GROUP BY set")
S.op("zset_increment", lambda t: kv.zincrby(_Z(t), _Z(t).where("member <= 10").withColumn("score", F.lit(1.0))).withColumn("score", F.round("score", 2)), f"SELECT set, member, round(score + CASE WHEN member <= 10 THEN 1 ELSE 0 END, 2) AS score FROM {_DZ}")

# Trees and Datalog
_T = lambda t: t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name").alias("path"))
_DT = "(SELECT '/' || r_name || '/' || n_name AS path, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
S.op("tree_functions", lambda t: _T(t).select("path", tree.depth(F.col("path")).alias("depth"), tree.parent(F.col("path")).alias("parent"), tree.leaf(F.col("path")).alias("leaf"), F.array_join(tree.ancestors(F.col("path")), " ").alias("ancestors")), f"SELECT path, 2 AS depth, '/' || r_name AS parent, n_name AS leaf, '/' || r_name || ' ' || path AS ancestors FROM {_DT}")
S.op("tree_descendants", lambda t: tree.descendants(_T(t), "/ASIA"), f"SELECT path FROM {_DT} WHERE r_name = 'ASIA'")
S.op("tree_scan", lambda t: _T(t).where(tree.matches(F.col("path"), "/A*")), f"SELECT path FROM {_DT} WHERE starts_with(path, '/A')")
S.op("tree_children_prune", lambda t: tree.children(tree.without_subtree(_T(t), "/EUROPE"), "/ASIA").union(tree.without_subtree(_T(t), "/ASIA")), f"SELECT path FROM {_DT} WHERE r_name = 'ASIA' UNION ALL SELECT path FROM {_DT} WHERE r_name <> 'ASIA'")
S.op("datalog_transitive", lambda t: datalog.evaluate(["path(x, y) :- edge(x, y)", "path(x, z) :- edge(x, y), path(y, z)"], {"edge": _E(t).select("src", "dst")})["path"], f"WITH RECURSIVE e AS {_DE}, r(c0, c1) AS (SELECT src, dst FROM e UNION SELECT e.src, r.c1 FROM e JOIN r ON e.dst = r.c0) SELECT c0, c1 FROM r")
S.op("datalog_rules", lambda t: datalog.evaluate(["same(x, y) :- edge(x, z), edge(y, z)", "near(x) :- same(x, 101)"], {"edge": _E(t).where("type = 'in_region'").select("src", "dst")})["near"], f"SELECT DISTINCT a.src AS c0 FROM {_DE} a JOIN {_DE} b ON a.dst = b.dst WHERE a.type = 'in_region' AND b.type = 'in_region' AND b.src = 101")

# Retrieval
for kind in ("fixed", "recursive", "semantic", "code"):
    S.op(f"chunk_{kind}", lambda t, kind=kind: rag.chunk(t.documents, "doc_id", "text", kind))
S.op("embed_text", lambda t: t.benchmark.select("item_id", text.hashed_embedding(F.col("text"), 16).alias("v")))
S.op("content_hashes", lambda t: t.documents.select("doc_id", rag.content_hash(F.col("text")).alias("hash")), "SELECT doc_id, sha256(text) AS hash FROM documents")
S.op("changed_chunks", lambda t: (lambda h: rag.changed_chunks(h.where("doc_id % 2 = 0"), h.where("doc_id % 3 = 0"))[0].select("doc_id"))(t.documents.select("doc_id", rag.content_hash(F.col("text")).alias("hash"))), "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
S.op("token_jaccard", lambda t: t.benchmark.select("item_id", F.round(rag.token_jaccard(text.tokens(F.col("text")), F.array(F.lit("the"), F.lit("of"), F.lit("in"))), 6).alias("j")), f"SELECT item_id, round(len(list_intersect({TOKENS}, ['the', 'of', 'in'])) / (len(list_distinct({TOKENS})) + 3 - len(list_intersect({TOKENS}, ['the', 'of', 'in']))), 6) AS j FROM benchmark")
S.op("lightweight_rerank", lambda t: t.documents.select("doc_id", F.round(rag.lightweight_rerank(["the", "moron"], F.col("text"), F.lit(0.5), F.lit(0.2), F.lit(0)), 6).alias("score")), "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE round(greatest(0, least(1, 0.4::DOUBLE * ((contains(lower(text), 'the')::INT + contains(lower(text), 'moron')::INT) / 2 + CASE WHEN starts_with(lower(text), 'the moron') THEN 0.2::DOUBLE ELSE 0 END) + 0.26::DOUBLE - CASE WHEN strlen(text) < 100 OR strlen(text) > 2000 THEN 0.02::DOUBLE ELSE 0 END)), 6) END AS score FROM documents")


def _metrics(t) -> DataFrame:
    found = text.top(text.bm25(t.documents, "doc_id", "text", QUERY).withColumn("score", F.round("score", 4)), "doc_id", 10).select(F.lit(1).alias("query_id"), F.col("doc_id").alias("id"), "rank")
    good = t.labels.where("toxic = 1").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("id"))
    return rag.retrieval_metrics(found, good, 10).select("query_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")), "hit")


S.op("retrieval_metrics", _metrics, f"WITH f AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_BM(_IDF, _GAIN)}) ORDER BY rank LIMIT 10), g AS (SELECT doc_id AS id FROM labels WHERE toxic = 1), h AS (SELECT * FROM f JOIN g USING (id)) SELECT 1 AS query_id, round((SELECT count(*) FROM h) / 10, 6) AS precision, round((SELECT count(*) FROM h) / (SELECT count(*) FROM g), 6) AS recall, round(coalesce((SELECT 1.0 / min(rank) FROM h), 0), 6)::DOUBLE AS mrr, round(coalesce((SELECT sum(1 / log2(rank + 1)) FROM h), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(10, (SELECT count(*) FROM g))) r(i)), 6) AS ndcg, CAST((SELECT count(*) FROM h) > 0 AS INTEGER) AS hit")
S.op("entity_extraction", lambda t: rag.merged_entities(rag.entities(t.documents, "doc_id", "text"), "doc_id"))
S.op("relation_extraction", lambda t: rag.relations(t.documents, "doc_id", "text"))
S.op("context_window", lambda t: rag.context_window(t.conversations, size=2).select("conv_id", "turn", F.length("context").alias("n")), "SELECT conv_id, turn, CAST(coalesce(length(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)), 0) AS INTEGER) AS n FROM conversations")
S.op("multimodal_fusion", lambda t: rag.multimodal_fusion({"text": (_lists(t)[0], 1.0), "vector": (_lists(t)[1], 0.8)}, "doc_id"))
S.op("tenant_filter", lambda t: rag.for_tenant(t.documents.withColumn("tenant_id", F.col("source")), "src3", 5, "doc_id").select("doc_id"), "SELECT doc_id FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 5")

# Catalog, copy
S.op("alter_columns", lambda t: catalog.rename_column(catalog.change_type(catalog.drop_column(catalog.add_column(t.region, "extra", "bigint", 5), "r_name"), "r_regionkey", "bigint"), "r_regionkey", "id"), "SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(5 AS BIGINT) AS extra FROM region")
S.op("partition_routes", lambda t: t.part.select("p_partkey", rel.hash_route(F.col("p_partkey") - 50, 7).alias("h"), rel.range_route(F.col("p_size"), [10, 20, 30]).alias("r"), rel.list_route(F.col("p_size"), [[1, 2], [3, 50]]).alias("l")), "SELECT p_partkey, ((p_partkey - 50) % 7 + 7) % 7 AS h, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS r, CASE WHEN p_size IN (1, 2) THEN 0 WHEN p_size IN (3, 50) THEN 1 ELSE -1 END AS l FROM part")


def _views(t) -> DataFrame:
    views = catalog.Views(t.spark, run.shared(t.spark))
    views.define("daily", lambda v: t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    views.define("peak", lambda v: v.read("daily").agg(F.max("n").alias("n")), ("daily",))
    views.refresh()
    return views.read("daily").join(views.read("peak"), "n")


S.op("materialised_views", _views, f"SELECT n, day FROM {_DDAYS} WHERE n = (SELECT max(n) FROM {_DDAYS})")
S.op("change_feed", lambda t: rel.change_feed(t.region, t.region.where("r_regionkey <> 2").withColumn("r_name", F.when(F.col("r_regionkey") == 1, "NEW").otherwise(F.col("r_name"))).union(t.spark.createDataFrame([(9, "X")], "r_regionkey int, r_name string")), ["r_regionkey"]).select("r_regionkey", "op"), "SELECT * FROM (VALUES (1, 'UPDATE'), (2, 'DELETE'), (9, 'INSERT')) t(r_regionkey, op)")
S.op("constraint_checks", lambda t: rel.violations(t.orders, ["o_custkey"], ["o_custkey"], [("o_custkey", t.customer.where("c_custkey > 10"), "c_custkey")]), "SELECT 'not_null(o_custkey)' AS \"constraint\", count(*) FILTER (WHERE o_custkey IS NULL) AS violations FROM orders UNION ALL SELECT 'unique(o_custkey)', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'foreign(o_custkey)', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 10)")


def _ledger(t) -> DataFrame:
    """A ledger over all orders: an account's entries are chained by hash, but every 50th order names no entry before
    it, and every 70th was changed after it was signed."""
    prev = "if(e.o % 50 = 0, 'none', try_element_at(acc, -1).hash)"
    entry = f"named_struct('o', e.o, 'payload', e.payload, 'prev_hash', {prev}, 'hash', sha2(concat(coalesce({prev}, ''), e.payload), 256))"
    chain = f"aggregate(es, cast(array() as array<struct<o: bigint, payload: string, prev_hash: string, hash: string>>), (acc, e) -> concat(acc, array({entry})))"
    accounts = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("payload")))).alias("es"))
    log = accounts.select("o_custkey", F.explode(F.expr(chain)).alias("e")).select("o_custkey", "e.*")
    log = log.withColumn("payload", F.when(F.col("o") % 70 == 0, F.concat("payload", F.lit("x"))).otherwise(F.col("payload")))
    return rel.ledger_problems(log, "o", "o_custkey").groupBy("problem").count()


S.op("ledger_check", _ledger, "SELECT CASE WHEN o_orderkey % 70 = 0 THEN 'hash' ELSE 'chain' END AS problem, count(*) AS count FROM orders WHERE o_orderkey % 70 = 0 OR o_orderkey % 50 = 0 GROUP BY 1")
S.op("analyse_columns", lambda t: catalog.analyse(t.part).select("column", "rows", "nulls"), "SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column, count(*) AS rows, 0::BIGINT AS nulls FROM part")
S.op("data_ageing", lambda t: (lambda h: t.part.select("p_partkey", catalog.age_class(h).alias("class"), catalog.age_action(h).alias("action")))(F.lit(0.05) * (F.col("p_size") % 20)), "SELECT p_partkey, CASE WHEN 0.05 * (p_size % 20) >= 0.7::DOUBLE THEN 'HOT' WHEN 0.05::DOUBLE * (p_size % 20) >= 0.3::DOUBLE THEN 'WARM' ELSE 'COLD' END AS class, CASE WHEN 0.05::DOUBLE * (p_size % 20) < 0.1::DOUBLE THEN 'delete' WHEN 0.05::DOUBLE * (p_size % 20) < 0.2::DOUBLE THEN 'archive' ELSE 'keep' END AS action FROM part".replace("0.05 * (p_size", "0.05::DOUBLE * (p_size"))
for fmt in ("csv", "text", "json", "binary"):

    def _copy(t, fmt=fmt) -> DataFrame:
        rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("p"))
        path = run.shared(t.spark)
        copy.write(rows, path, format=fmt)
        return copy.read(t.spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, p string", format=fmt)

    S.op(f"copy_{fmt}", _copy, "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS p FROM orders")
S.op("copy_sql", lambda t: t.region.select(copy.insert_statement(t.region, "r").alias("line")), "SELECT 'INSERT INTO r (r_regionkey, r_name) VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS line FROM region")
S.op("function_registry", lambda t: t.spark.createDataFrame([(n,) for n in standard().names()], "name string"))
S.op("registered_function", lambda t: standard().call("GRAPH_NEIGHBORS", _E(t), 101), f"SELECT DISTINCT dst AS id FROM {_BOTH} WHERE src = 101")

QUERIES, ORACLES = S.queries, S.oracles
