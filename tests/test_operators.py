"""Operators on small tables with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import filters, registry
from quarry.operators import catalog, datalog, document, graph, kv, rag, relational, spatial, text, timeseries, tree, vector
from quarry.sources import copy
from quarry.streaming import windows


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_text_filter(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, None, 3.5)], "id int, name string, x double")
    assert [r.id for r in df.where(filters.text_filter("name = 'a' OR NOT (id < 3 AND x >= 1.5)")).orderBy("id").collect()] == [1, 3]
    with pytest.raises(ValueError):
        filters.text_filter("id = 1 extra")
    with pytest.raises(ValueError):
        filters.text_filter("other = 1", {"id"})
    assert df.where(filters.json_filter({"id": {"$in": [1, 2]}, "$or": [{"x": {"$gt": 2}}, {"name": "a"}]})).count() == 2
    assert df.where(filters.json_filter({})).count() == 3


def test_interval_join(spark):
    left = spark.createDataFrame([(0, "a"), (1000, "b"), (None, "c")], "l long, x string")
    right = spark.createDataFrame([(500, 1), (1500, 2), (1501, 3), (-500, 4)], "r long, y int")
    assert rows(relational.interval_join(left, right, 500, "l", "r").select("x", "y"), "x", "y") == [("a", 1), ("a", 4), ("b", 1), ("b", 2)]


def test_weighted_sets(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "member string, score double")
    b = spark.createDataFrame([("y", 5.0), ("z", 7.0)], "member string, score double")
    assert rows(relational.weighted_union([(a, 2.0), (b, 1.0)]), "member") == [("x", 2.0), ("y", 9.0), ("z", 7.0)]
    assert rows(relational.weighted_intersection([(a, 2.0), (b, 1.0)], "max")) == [("y", 5.0)]


def test_table_changes(spark):
    t = relational.Table(spark.createDataFrame([(1, 10), (2, None)], "id int, v int"))
    changed, hit = t.update(F.col("v") > 5, {"v": F.col("v") + 1})
    assert rows(changed.rows, "id") == [(1, 11), (2, None)] and rows(hit) == [(1, 11)]
    assert rows(changed.delete(F.col("id") == 2)[0].rows) == [(1, 11)]


def test_routes_and_feed(spark):
    df = spark.createDataFrame([(-3,), (0,), (15,)], "k int")
    assert rows(df.select("k", relational.hash_route(F.col("k"), 4), relational.range_route(F.col("k"), [0, 10]), relational.list_route(F.col("k"), [[0], [15]])), "k") == [(-3, 1, 0, -1), (0, 0, 1, 0), (15, 3, 2, 1)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, v string")
    assert rows(relational.change_feed(old, new, ["id"]).select("id", "op"), "id") == [(2, "UPDATE"), (3, "INSERT")]


def points(spark, values):
    return spark.createDataFrame(values, "ms long, value double")


def test_series(spark):
    df = points(spark, [(-1, 1.0), (0, 2.0), (999, 3.0), (1000, 4.0)])
    assert rows(timeseries.aggregate(df, 1000, "sum"), "bucket") == [(-1000, 1.0), (0, 5.0), (1000, 4.0)]
    d = points(spark, [(0, 1.0), (0, 3.0), (10, 1.0)])
    assert [r.derivative for r in timeseries.derivative(d).orderBy("ms", "value").collect()] == [None, 0.0, -0.2]
    assert [r.rate for r in timeseries.rate(d).orderBy("ms", "value").collect()] == [None, 0.0, 0.0]
    assert rows(timeseries.histogram(points(spark, [(0, 0.0), (1, 2.5), (2, 3.0)]), 1.0), "bucket") == [(0, 0.0, 1.0, 1), (1, 1.0, 2.0, 0), (2, 2.0, 3.0, 2)]
    assert df.agg(timeseries.percentile("value", 100)).first()[0] == 4.0
    state = timeseries.rollup_state(df, 1000)
    assert timeseries.merge_states(state, 10_000).where("bucket = 0").select("avg", "count").first() == (3.0, 3)
    assert timeseries.granularity("Hours") == "hour"
    with pytest.raises(ValueError):
        timeseries.granularity("fortnight")


def test_windows(spark):
    df = points(spark, [(100, 1.0), (300, 1.0), (1200, 1.0), (3100, 1.0)])
    assert rows(windows.tumbling(df, 1000), "window_start") == [(0, 1000, 2), (1000, 2000, 1), (2000, 3000, 0), (3000, 4000, 1)]
    assert rows(windows.sliding(df, 1000, 500), "window_start") == [(100, 1100, 2), (600, 1600, 1), (1100, 2100, 1), (1600, 2600, 0), (2100, 3100, 0), (2600, 3600, 1)]
    assert rows(windows.session(df, 900), "window_start") == [(100, 1200, 3), (3100, 3100, 1)]
    assert rows(windows.aggregated(df, 1000, "count"), "window_end") == [(1000, 2.0), (2000, 1.0), (4000, 1.0)]
    assert windows.sliding(df.limit(0), 1000).count() == 0


def test_text(spark):
    df = spark.createDataFrame([(1, "The cat, the CAT sat"), (2, "a dog"), (3, "")], "id int, text string")
    assert df.select(text.tokens(F.col("text"), 2)).first()[0] == ["the", "cat", "the", "cat", "sat"]
    scores = {r.id: r.score for r in text.bm25(df, "id", "text", ["cat"]).collect()}
    idf, length, mean = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1), 5, 7 / 3
    assert scores == pytest.approx({1: idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length / mean))})
    assert df.where(text.phrase(F.col("text"), ["cat", "sat"])).count() == 1
    assert df.where("id = 1").select(text.highlight(F.col("text"), ["cat"])).first()[0] == "The <em>cat</em>, the <em>CAT</em> sat"
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1)], "id int, rank int")
    assert {r.id: r.score for r in text.rrf([a, b], "id").collect()} == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61})


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id int, embedding array<float>")
    assert rows(vector.knn(df, "id", [1.2, 0.0], 2).select("id", "rank")) == [(1, 1), (2, 2)]
    assert df.select(vector.distance(F.col("embedding"), vector.literal([0.0, 1.0]), "cosine")).first()[0] == 1.0
    picks = vector.mmr(df.withColumn("distance", F.col("id").cast("double")).withColumn("q", F.lit(0)), "id", "q", 3, 0.5)
    assert [r.id for r in picks.orderBy("rank").collect()] == [0, 4, 2]
    assert vector.choose_index(100) == ("exact", 0, 0) and vector.choose_index(1_000_000)[1] == 4000


EDGES = [(1, 2, "knows", 1.0), (2, 3, "knows", 1.0), (3, 4, "knows", 1.0), (1, 4, "knows", 5.0), (5, 6, "knows", 1.0), (4, 2, "likes", 1.0)]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "src long, dst long, type string, weight double")
    v = spark.createDataFrame([(i, ["person"], {"name": f"v{i}"}) for i in range(1, 7)], "id long, labels array<string>, props map<string,string>")
    assert rows(graph.traverse(e, 1, 2, "out").select("id", "depth"), "id") == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert dict(rows(graph.distances(e, 1))) == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0}
    assert graph.shortest_path(e, 1, 3, "both").first().path == [1, 2, 3]
    assert graph.shortest_path(e, 1, 6).count() == 0
    assert rows(graph.k_shortest_paths(e, 1, 4, 2, 3).select("distance")) == [(3.0,), (5.0,)]
    assert dict(rows(graph.components(e))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert dict(rows(graph.strong_components(e))) == {1: 1, 2: 4, 3: 4, 4: 4, 5: 5, 6: 6}
    assert sum(r.rank for r in graph.pagerank(e, rounds=20).collect()) == pytest.approx(1.0)
    assert rows(graph.triangles(e), "a", "b") == [(1, 2, 4), (2, 3, 4)]
    found = graph.query(v, e, "MATCH (a:person {name: 'v1'})-[:knows]->(b)-[:knows]->(c) RETURN b.name AS b, c.name AS c ORDER BY b")
    assert rows(found) == [("v2", "v3")]
    assert rows(graph.query(v, e, "MATCH (a)-[:knows*1..3]->(c) WHERE id(a) = 1 RETURN DISTINCT id(c) AS c ORDER BY c")) == [(2,), (3,), (4,)]


def test_spatial(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))",)], "w string")
    g = spatial.parse_wkt(F.col("w"))
    at = lambda x, y: spatial.point(F.lit(x), F.lit(y))
    assert df.select(*(spatial.contains(g, at(*p)) for p in ((1, 1), (5, 5), (10, 5), (11, 5)))).first() == (True, False, True, False)
    assert df.select(spatial.distance(g, at(13, 14)), spatial.to_wkt(g)).first() == (5.0, df.first()[0])
    assert df.select(spatial.intersects(g, spatial.parse_wkt(F.lit("LINESTRING (-5 5, 20 5)")))).first()[0]
    assert spark.range(16).select(F.col("id"), spatial.hilbert(F.col("id") % 4, F.floor(F.col("id") / 4), 2).alias("h")).select("h").distinct().count() == 16


def test_document(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": 1}, {"c": 5}]}, "n": 2}')], "id int, doc string")
    assert df.select(document.extract(F.col("doc"), "$.a.b[1].c")).first()[0] == "5"
    assert df.select(document.find_all(F.col("doc"), "$..c"), document.find_all(F.col("doc"), "$.a.b[?(@.c > 1)]")).first() == (["1", "5"], ['{"c": 5}'])
    changed = document.update_json(F.col("doc"), "n int, tags array<string>", [("INCREMENT", "n", F.lit(3)), ("SET", "tags", F.array(F.lit("x"))), ("PUSH", "tags", F.lit("y"))])
    assert df.select(changed).first()[0] == '{"n":5,"tags":["x","y"]}'
    assert rows(document.histogram(spark.createDataFrame([(1.0,), (31.0,)], "v double"), "v", 10.0), "bucket") == [(0.0, 1), (10.0, 0), (20.0, 0), (30.0, 1)]


def test_keys_trees(spark):
    z = spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0), ("s", "c", 0.5)], "set string, member string, score double")
    assert [r.member for r in kv.zrange(z, 0, -1).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.member for r in kv.zrange(z, 0, 0, True).collect()] == ["b"]
    p = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",), ("/ab",)], "path string")
    assert rows(tree.descendants(p, "/a"), "path") == [("/a/b",), ("/a/b/c",)]
    assert p.where("path = '/a/b/c'").select(tree.ancestors(F.col("path")), tree.parent(F.col("path"))).first() == (["/a", "/a/b", "/a/b/c"], "/a/b")
    assert p.where(tree.matches(F.col("path"), "/a*")).count() == 4


def test_datalog(spark):
    facts = {"parent": spark.createDataFrame([(1, 2), (2, 3)], "x int, y int")}
    out = datalog.evaluate(["anc(x, y) :- parent(x, y)", "anc(x, z) :- parent(x, y), anc(y, z)"], facts)
    assert rows(out["anc"], "c0", "c1") == [(1, 2), (1, 3), (2, 3)]
    empty = datalog.evaluate(["anc(x, y) :- parent(x, y)"], {"parent": facts["parent"].limit(0)})
    assert empty["anc"].count() == 0


def test_retrieval(spark):
    body = "One two three. Four five six.\n\nSeven eight nine ten."
    for chunker in rag.CHUNKERS.values():
        spans = chunker(body, 20)
        assert all(b - a <= 20 or chunker is rag.sentence_chunks for a, b in spans)
        assert {w for a, b in spans for w in body[a:b].split()} >= {"One", "nine"}
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query_id int, id int, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 99)], "query_id int, id int")
    r = rag.retrieval_metrics(results, relevant, 3).first()
    assert (r.precision, r.recall, r.hit, r.mrr) == pytest.approx((1 / 3, 0.5, 1, 0.5))
    assert r.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert rag.table_markdown([["a", "b"], ["1"]]) == "| a | b |\n| --- | --- |\n| 1 |  |"


@pytest.mark.parametrize("fmt", ["csv", "text", "json", "binary"])
def test_copy(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'a "q", b', 1.5), (2, None, None), (3, "", -2.0)], "id int, name string, x double")
    copy.write(df, str(tmp_path / fmt), format=fmt)
    assert rows(copy.read(spark, str(tmp_path / fmt), "id int, name string, x double", format=fmt), "id") == rows(df, "id")


def test_copy_options_and_registry(spark):
    assert copy.options("WITH (FORMAT csv, DELIMITER '|', HEADER false)") == copy.DEFAULTS | {"delimiter": "|", "header": False}
    with pytest.raises(ValueError):
        copy.options("WITH (COLOUR red)")
    known = registry.standard()
    assert known.lookup("st_distance").most == 2
    with pytest.raises(TypeError):
        known.call("TREE_DEPTH")
    assert registry.spark_type("DECIMAL(10,2)") == "decimal(10,2)" and registry.spark_type("int8") == "bigint"


def test_views(spark, tmp_path):
    source = {"n": 3}
    views = catalog.Views(spark, str(tmp_path))
    views.define("top", lambda v: v.read("base").agg(F.max("id").alias("m")), ("base",))
    views.define("base", lambda v: spark.range(source["n"]))
    assert views.refresh() == ["base", "top"] and views.read("top").first().m == 2
    source["n"] = 9
    views.changed("base")
    views.refresh()
    assert views.read("top").first().m == 8


def test_open_walks_reach_everything(spark):
    from quarry.operators import graph

    vertices = spark.createDataFrame([(i, "v") for i in range(16)], "id long, label string")
    edges = spark.createDataFrame([(i, i + 1, "n", 1.0) for i in range(14)], "src long, dst long, type string, weight double")
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    assert {tuple(r) for r in graph._reachable(step, 1).collect()} == {(a, b) for a in range(15) for b in range(a + 1, 15)}
    assert {tuple(r) for r in graph._reachable(step, 3).collect()} == {(a, b) for a in range(15) for b in range(a + 3, 15)}
    assert vertices.count() == 16


def test_paths_without_json_are_null(spark):
    from quarry.operators import document

    docs = spark.createDataFrame([('{"a": {"k": 1}}',), ("{broken",), (None,)], "d string")
    assert [r[0] for r in docs.select(document.find_all(F.col("d"), "$..k")).collect()] == [["1"], None, None]


def test_approximate_searches_recall(spark):
    import numpy as np

    from quarry.operators import vector

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    m = np.array([r.embedding for r in rows], float)
    index, centres = vector.ivf_index(df, 16)
    parts = vector.product_quantiser(df, 16, 16, 64)
    coded = df.withColumn("codes", vector.product_codes(F.col("embedding"), parts)).cache()
    index = index.cache()
    hits = [0, 0]
    for q in (0, 100, 200, 300):
        near = {rows[i].vec_id for i in np.argsort(((m - m[q]) ** 2).sum(1), kind="stable")[:10]}
        for j, found in enumerate((vector.ivf_search(index, centres, "vec_id", list(m[q]), 10, 13), vector.two_stage(coded, "vec_id", list(m[q]), 10, len(rows) // 3, parts))):
            hits[j] += len(near & {r.vec_id for r in found.collect()})
    assert min(hits) >= 0.9 * 40, hits


def test_band_joins_are_not_broadcast(spark):
    a = spark.range(100).select(F.col("id").alias("l"), (F.col("id") % 10).cast("double").alias("x"), F.lit(0.0).alias("y"))
    b = a.toDF("r", "x2", "y2")
    near = spatial.distance_join(a, b, 1.0, "x", "y", "x2", "y2")
    times = relational.interval_join(a.select(F.col("l").alias("lms")), b.select(F.col("r").alias("rms")), 1, "lms", "rms")
    for df, n in ((near, 2800), (times, 298)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == n


def test_first_and_last_of_one_time(spark):
    df = spark.createDataFrame([(3, 10, 7.0), (1, 10, 9.0), (2, 10, 8.0), (0, 10, None), (5, 20, 1.0), (4, 20, 2.0)], "id long, ms long, value double").coalesce(1)
    for order in (df.orderBy("id"), df.orderBy(F.col("id").desc())):
        assert rows(timeseries.aggregate(order, 100, "first", place="id")) == [(0, 9.0)]
        assert rows(timeseries.aggregate(order, 100, "last", place="id")) == [(0, 2.0)]
        assert rows(timeseries.aggregate(order, 100, "first")) == [(0, 7.0)]


def test_chunks_leave_in_bounded_batches(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k": list(range(500)), "t": ["some words. " * 1000, *[None, ""], *["word " * 2000] * 497]})
    for kind, chunker in rag.CHUNKERS.items():
        got = list(rag.cut(iter([batch]), chunker, {}))
        sizes = [sum(map(len, b.column(4).to_pylist())) for b in got]
        assert len(got) > 3 and max(sizes) < 2 * rag._CHARS
        want = [(k, i, a, b, t[a:b]) for k, t in zip(*batch.to_pydict().values(), strict=True) if t for i, (a, b) in enumerate(chunker(t))]
        assert [r for b in got for r in zip(*b.to_pydict().values(), strict=True)] == want, kind


def test_copy_blocks_are_read_one_at_a_time(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [str(i) for i in range(1000)], "b": ["x" * 5000, None] * 500})
    blocks = list(copy.pack(iter([batch]), 300))
    assert len(blocks) > 3 and max(b.nbytes for b in blocks) < 2 * copy._BLOCK
    joined = pa.RecordBatch.from_pydict({"block": [x for b in blocks for x in b.column(0).to_pylist()]})
    got = list(copy.unpack(iter([joined]), ["a", "b"]))
    assert [b.num_rows for b in got] == [300, 300, 300, 100]
    assert [r for b in got for r in b.to_pylist()] == batch.to_pylist()


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_outer", "left_semi", "left_anti"])
def test_hash_join_deals_a_key_to_many_tasks(spark, how):
    left = spark.createDataFrame([(k, i) for i in range(40) for k in (1, 1, 2, None)], "k int, a long")
    right = spark.createDataFrame([(k, i) for i in range(5) for k in (1, 3, None)], "k long, b long")
    got = relational.hash_join(left, right, ["k"], how)
    want = left.join(right, ["k"], how)
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    if how in ("inner", "right", "full"):
        assert got.where("k = 1 and b is not null").select(F.spark_partition_id()).distinct().count() > 1


def test_sample_of_least_hashes(spark):
    df = spark.range(3000, numPartitions=7).select(F.array(F.when(F.col("id") % 4 == 0, 1.0).otherwise(F.col("id") % 900)).alias("v"))
    for n in (1, 20, 500, 2900, 5000):
        got = vector.least_hashed(df, "v", n)
        assert got.rdd.getNumPartitions() == 1 and got.collect() == df.orderBy(F.xxhash64("v")).limit(n).collect()
    assert vector.least_hashed(df.limit(0), "v", 5).count() == 0
