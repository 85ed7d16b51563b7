"""Property graphs as vertices(id, labels, props) and edges(src, dst, type, weight): traversal, paths, centrality,
communities and patterns. Iterations cut their lineage by checkpoints in the session's checkpoint folder."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _saved(df: DataFrame) -> DataFrame:
    """Checkpoint to spark.checkpoint.dir; only where none is set, as in tests, to a temporary folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def _steps(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """(src, dst, weight) of the moves that a direction ('out', 'in', 'both') allows."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    e = e if "weight" in e.columns else e.withColumn("weight", F.lit(1.0))
    out = e.select("src", "dst", "weight")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def neighbours(edges: DataFrame, vertex: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    return _steps(edges, direction, types).where(F.col("src") == vertex).select(F.col("dst").alias("id")).distinct()


def traverse(edges: DataFrame, start: int, max_depth: int, direction: str = "both", types: list[str] | None = None, include_start: bool = True) -> DataFrame:
    """(id, depth, parent) of every vertex within max_depth hops: the fewest hops, the smallest parent at that depth.

    One frontier join a level; visited vertices leave by anti-join.
    """
    steps = _steps(edges, direction, types).select("src", "dst").distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0, None)], "id long, depth int, parent long")
    front = seen
    for d in range(1, max_depth + 1):
        front = _saved(steps.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(seen, "id", "left_anti").select(F.col("id").cast("long").alias("id"), F.lit(d).alias("depth"), F.col("parent").cast("long").alias("parent")))
        if front.isEmpty():
            break
        seen = _saved(seen.union(front))
    return seen if include_start else seen.where(F.col("id") != start)


def distances(edges: DataFrame, start: int, direction: str = "out", weighted: bool = True, rounds: int = 1000) -> DataFrame:
    """(id, distance) from the start: non-negative weights relaxed over the vertices that changed, until none does."""
    steps = _steps(edges, direction)
    if not weighted:
        steps = steps.withColumn("weight", F.lit(1.0))
    steps = steps.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    known = front = edges.sparkSession.createDataFrame([(start, 0.0)], "id long, distance double")
    for _ in range(rounds):
        step = steps.join(front.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("_d"))
        front = _saved(step.join(known, "id", "left").where(F.col("distance").isNull() | (F.col("_d") < F.col("distance"))).select(F.col("id").cast("long").alias("id"), F.col("_d").alias("distance")))
        if front.isEmpty():
            break
        known = _saved(known.join(front, "id", "left_anti").union(front))
    return known


def shortest_path(edges: DataFrame, start: int, end: int, direction: str = "both", max_depth: int = 64) -> DataFrame:
    """(path, length): one path with the fewest hops, of such the least by vertex ids; no row without one."""
    return all_shortest_paths(edges, start, end, direction, max_depth).orderBy("path").limit(1)


def all_shortest_paths(edges: DataFrame, start: int, end: int, direction: str = "both", max_depth: int = 64) -> DataFrame:
    """(path, length) of every path with the fewest hops. Only vertices on such paths are expanded: depths from both
    ends must add up."""
    ahead = traverse(edges, start, max_depth, direction)
    reached = ahead.where(F.col("id") == end).select("depth").first()
    if reached is None:
        return edges.sparkSession.createDataFrame([], "path array<bigint>, length int")
    n = reached[0]
    back = traverse(edges, end, n, {"out": "in", "in": "out", "both": "both"}[direction])
    on = _saved(ahead.join(back.select("id", F.col("depth").alias("rest")), "id").where(F.col("depth") + F.col("rest") == n).select("id", "depth"))
    steps = _steps(edges, direction).select("src", "dst").distinct()
    paths = on.where("depth = 0").select(F.array("id").alias("path"), F.col("id").alias("src"))
    for d in range(1, n + 1):
        level = on.where(F.col("depth") == d).select(F.col("id").alias("dst"))
        paths = paths.join(steps, "src").join(level, "dst").select(F.concat("path", F.array(F.col("dst").cast("long"))).alias("path"), F.col("dst").alias("src"))
    return paths.select("path", F.lit(n).alias("length"))


def k_shortest_paths(edges: DataFrame, start: int, end: int, k: int, max_depth: int, direction: str = "out") -> DataFrame:
    """The k simple paths of least weight with at most max_depth hops: (path, distance). Unless an edge has a negative
    weight, paths longer than the k-th best so far aren't carried on."""
    steps = _steps(edges, direction).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    prune = steps.where("weight < 0").isEmpty()
    paths = edges.sparkSession.createDataFrame([([start], start, 0.0)], "path array<bigint>, src long, distance double")
    done = []
    for _ in range(max_depth):
        paths = _saved(paths.join(steps, "src").where(~F.array_contains("path", F.col("dst").cast("long"))).select(F.concat("path", F.array(F.col("dst").cast("long"))).alias("path"), F.col("dst").cast("long").alias("src"), (F.col("distance") + F.col("weight")).alias("distance")))
        done.append(paths.where(F.col("src") == end))
        paths = paths.where(F.col("src") != end)
        best = reduce(DataFrame.union, done).select("distance").orderBy("distance").limit(k).collect() if prune else []
        if len(best) == k:
            paths = paths.where(F.col("distance") <= best[-1][0])
    return reduce(DataFrame.union, done).select("path", "distance").orderBy("distance", "path").limit(k)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, personal: list[int] | None = None) -> DataFrame:
    """(id, rank) with the ranks of vertices without out-edges spread by the restart distribution, which is even or
    over the ``personal`` vertices. Ends when ranks change by less than the tolerance in sum."""
    steps = _saved(edges.select("src", "dst"))
    degree = steps.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    ids = _saved(steps.select(F.col("src").alias("id")).union(steps.select(F.col("dst").alias("id"))).distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(1.0))
    restart = F.lit(1.0 / n) if personal is None else F.when(F.col("id").isin(personal), 1.0 / len(set(personal))).otherwise(0.0)
    rank = _saved(ids.select("id", restart.alias("rank")).join(degree.withColumnRenamed("src", "id"), "id", "left"))
    for _ in range(rounds):
        stuck = rank.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = steps.join(rank.where("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        new = _saved(rank.join(given, "id", "left").select("id", ((1 - damping) * restart + damping * (F.coalesce("got", F.lit(0.0)) + stuck * restart)).alias("rank"), "out", F.col("rank").alias("_old")))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("_old")))).first()[0]
        rank = new.drop("_old")
        if change < tolerance:
            break
    return rank.select("id", "rank")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degrees over the number of other vertices."""
    d = degrees(edges)
    n = max(d.count() - 1, 1)
    return d.select("id", (F.col("degree") / n).alias("centrality"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least vertex reachable when directions don't matter. Labels move along edges and jump to
    their label's label, until none changes."""
    both = _saved(_steps(edges, "both").select("src", "dst").distinct())
    labels = _saved(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "src"}), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("_m"))
        step = labels.join(near, "id").select("id", F.least("component", "_m").alias("component"), F.col("component").alias("_old"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("_j"))
        new = _saved(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("_j", "component")).alias("component"), "_old"))
        changed = new.where("component <> _old").isEmpty()
        labels = new.drop("_old")
        if changed:
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): vertices that reach each other, named by their largest. Colours spread forward as maxima; the
    vertices that reach a colour's root inside it form its component and leave."""
    left = _saved(edges.select("src", "dst").where("src <> dst").distinct())
    ids = _saved(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct())
    done = None
    while not ids.isEmpty():
        colour = ids.select("id", F.col("id").alias("colour"))
        while True:
            got = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("_c"))
            new = _saved(colour.join(got, "id", "left").select("id", F.greatest("colour", F.coalesce("_c", "colour")).alias("colour"), F.col("colour").alias("_old")))
            same = new.where("colour <> _old").isEmpty()
            colour = new.drop("_old")
            if same:
                break
        inside = _saved(left.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", "a"))
        found = _saved(colour.where("id = colour").select("id", "colour"))
        front = found
        while not front.isEmpty():
            front = _saved(inside.join(front.select(F.col("id").alias("dst"), F.col("colour").alias("a")), ["dst", "a"]).select(F.col("src").alias("id"), F.col("a").alias("colour")).distinct().join(found, "id", "left_anti"))
            found = _saved(found.union(front))
        part = found.select("id", F.col("colour").alias("component"))
        done = part if done is None else _saved(done.union(part))
        ids = _saved(ids.join(found, "id", "left_anti"))
        left = _saved(left.join(ids.withColumnRenamed("id", "src"), "src").join(ids.withColumnRenamed("id", "dst"), "dst").select("src", "dst"))
    return done if done is not None else ids.withColumn("component", F.col("id"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by label propagation over undirected edges: each vertex takes the label of greatest weight
    among its neighbours and itself, ties to smaller labels."""
    both = _saved(_steps(edges, "both").groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "community", "weight").union(labels.select("id", "community", F.lit(0.5).alias("weight")))
        tally = votes.groupBy("id", "community").agg(F.sum("weight").alias("w"))
        new = _saved(tally.groupBy("id").agg(F.max(F.struct("w", (-F.col("community")).alias("c"))).alias("m")).select("id", (-F.col("m.c")).alias("community")))
        same = new.join(labels.withColumnRenamed("community", "_o"), "id").where("community <> _o").isEmpty()
        labels = new
        if same:
            break
    return labels


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, all joined by undirected edges. Edges point to the vertex of higher degree first, so a
    hub opens few wedges."""
    e = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).where("x <> y").distinct()
    d = e.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").count()
    ranked = e.join(d.select(F.col("id").alias("x"), F.struct("count", "id").alias("rx")), "x").join(d.select(F.col("id").alias("y"), F.struct("count", "id").alias("ry")), "y").select(F.least("rx", "ry").alias("p"), F.greatest("rx", "ry").alias("q"))
    wedge = ranked.alias("s").join(ranked.alias("t"), (F.col("s.p") == F.col("t.p")) & (F.col("s.q") < F.col("t.q"))).select(F.col("s.p").alias("a"), F.col("s.q").alias("p"), F.col("t.q").alias("q"))
    three = wedge.join(ranked, ["p", "q"]).select(F.sort_array(F.array("a.id", "p.id", "q.id")).alias("t"))
    return three.select(*(F.col("t")[i].alias(n) for i, n in enumerate("abc")))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, avg/min/max degree, density, triangles and the global clustering coefficient."""
    d = degrees(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())
    n = d.agg(F.count(F.lit(1)).alias("vertices"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("avg_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.sum(F.expr("degree * (degree - 1) div 2")).alias("wedges"))
    t = triangles(edges).agg(F.count(F.lit(1)).alias("triangles"))
    both = n.join(t, F.lit(True))
    return both.select("vertices", "edges", "avg_degree", "min_degree", "max_degree", F.try_divide(2.0 * F.col("edges"), F.col("vertices") * (F.col("vertices") - 1)).alias("density"), "triangles", F.coalesce(F.try_divide(3.0 * F.col("triangles"), F.col("wedges")), F.lit(0.0)).alias("clustering"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between vertices of the set."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def common_neighbours(edges: DataFrame, a: int, b: int) -> DataFrame:
    return neighbours(edges, a).join(neighbours(edges, b), "id")


_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)")
_EDGE = re.compile(r"\s*(<)?-\s*(?:\[\s*(\w+)?\s*(?::\s*(\w+))?\s*(\*\s*(\d+)?\s*(\.\.)?\s*(\d+)?)?\s*\])?\s*-(>)?\s*")
_QUERY = re.compile(r"^\s*(?:MATCH|match)\s+(?P<pattern>.*?)(?:\s+WHERE\s+(?P<where>.*?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<returns>.*?)(?:\s+ORDER\s+BY\s+(?P<order>.*?))?(?:\s+SKIP\s+(?P<skip>\d+))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$", re.I | re.S)


def match(vertices: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    """Compile a chain such as (a:person)-[e:knows]->(b)-[*1..3]->(c {name: 'x'}) into joins; several chains stand
    between commas and share names.

    Each named vertex is a struct column (id, labels, props), each named edge one of (src, dst, type). A variable
    length is the union of its unrolled joins, up to 8 hops where open. Relations within a chain don't repeat an edge
    end pair only as far as data repeats it (walk semantics).
    """
    out, names, unnamed = None, set(), 0
    steps = edges.select(F.struct("src", "dst", "type").alias("e"))

    def vertex(name: str, label: str | None, props: str | None) -> DataFrame:
        v = vertices if label is None else vertices.where(F.array_contains("labels", label))
        for k, raw in re.findall(r"(\w+)\s*:\s*('[^']*'|[^,}\s]+)", props or ""):
            v = v.where(F.col("props")[k] == raw.strip("'"))
        return v.select(F.struct("id", "labels", "props").alias(name))

    for chain in re.split(r",\s*(?=\()", pattern.strip()):
        at, before, hop = 0, None, None
        while at < len(chain):
            m = _NODE.match(chain, at)
            if not m:
                raise ValueError(f"expected a vertex at {chain[at:]!r}")
            at = m.end()
            name = m[1] or f"_v{(unnamed := unnamed + 1)}"
            own = vertex(name, m[2], m[3]) if name not in names or m[2] or m[3] else None
            if before is None:
                if out is None:
                    out = own
                elif name in names:
                    out = out if own is None else out.join(own.select(F.col(f"{name}.id").alias("_id")), F.col(f"{name}.id") == F.col("_id"), "left_semi")
                else:
                    out = out.join(own, F.lit(True))
            else:
                back, edge, kind, star, least, dots, most, ahead = hop
                moves = steps if kind is None else steps.where(F.col("e.type") == kind)
                moves = moves.select("e", F.col("e.src").alias("_s"), F.col("e.dst").alias("_d"))
                if back and not ahead:
                    moves = moves.select("e", F.col("_d").alias("_s"), F.col("_s").alias("_d"))
                elif bool(back) == bool(ahead):
                    moves = moves.union(moves.select("e", F.col("_d").alias("_s"), F.col("_s").alias("_d")))
                low = int(least or 1) if star else 1
                open_ = bool(star) and not most and bool(dots or not least)  # no upper bound: every pair that is reachable
                high = (int(most) if most else low) if star else 1
                single = moves.select("_s", "_d")
                paths, walk = [], None
                for n in range(1, 0 if open_ else high + 1):
                    walk = single if walk is None else walk.withColumnRenamed("_d", "_m").join(single.withColumnsRenamed({"_s": "_m"}), "_m").select("_s", "_d")
                    if n >= low:
                        paths.append(walk)
                reach = _reachable(single, max(low, 1)) if open_ else moves if not star else reduce(DataFrame.union, paths) if paths else single.limit(0)
                if low == 0:
                    same = vertices.select(F.col("id").alias("_s"), F.col("id").alias("_d"))
                    reach = reach.union(same)
                cols = ["_s", "_d"] + ([F.col("e").alias(edge)] if edge and not star else [])
                out = out.join(reach.select(*cols), F.col(f"{before}.id") == F.col("_s")).drop("_s")
                if name in names:
                    out = out.where(F.col(f"{name}.id") == F.col("_d")).drop("_d")
                else:
                    out = out.join(own, F.col("_d") == F.col(f"{name}.id")).drop("_d")
            names.add(name)
            before = name
            if at < len(chain):
                m = _EDGE.match(chain, at)
                if not m or m.end() == at:
                    raise ValueError(f"expected an edge at {chain[at:]!r}")
                hop, at = m.groups(), m.end()
    return out


def _reachable(steps: DataFrame, least: int) -> DataFrame:
    """Distinct pairs (_s, _d) that a walk of at least so many steps joins."""
    on = steps.withColumnsRenamed({"_s": "_m"}).distinct()
    further = lambda pairs: pairs.withColumnRenamed("_d", "_m").join(on, "_m").select("_s", "_d").distinct()
    new = steps.distinct()
    for _ in range(least - 1):
        new = further(new)
    seen = new = _saved(new)
    while not new.isEmpty():
        new = _saved(further(new).join(seen, ["_s", "_d"], "left_anti"))
        seen = seen.union(new)
    return seen


def _expression(text: str) -> Column:
    """A property or predicate in terms of match's columns: a.name is a.props['name'], id(a) is a.id."""
    parts = re.split(r"('[^']*')", text)
    for i in range(0, len(parts), 2):
        x = re.sub(r"\bid\(\s*(\w+)\s*\)", r"\1.`id`", parts[i], flags=re.I)
        x = re.sub(r"\btype\(\s*(\w+)\s*\)", r"\1.`type`", x, flags=re.I)
        x = re.sub(r"\blabels\(\s*(\w+)\s*\)", r"\1.`labels`", x, flags=re.I)
        x = re.sub(r"\bproperties\(\s*(\w+)\s*\)", r"\1.`props`", x, flags=re.I)
        x = re.sub(r"\bcollect\(", "collect_list(", x, flags=re.I)
        parts[i] = re.sub(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)", r"\1.props['\2']", x)
    text = "".join(parts)
    text = re.sub(r"(\S+)\s+STARTS\s+WITH\s+('[^']*')", r"startswith(\1, \2)", text, flags=re.I)
    text = re.sub(r"(\S+)\s+ENDS\s+WITH\s+('[^']*')", r"endswith(\1, \2)", text, flags=re.I)
    text = re.sub(r"(\S+)\s+CONTAINS\s+('[^']*')", r"contains(\1, \2)", text, flags=re.I)
    text = re.sub(r"\bIN\s*\[([^\]]*)\]", r"IN (\1)", text, flags=re.I)
    return F.expr(text)


def query(vertices: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """MATCH pattern [WHERE ...] RETURN [DISTINCT] items [ORDER BY ...] [SKIP n] [LIMIT n]; aggregates among the items
    group by the others."""
    m = _QUERY.match(text)
    if not m:
        raise ValueError("expected MATCH ... RETURN ...")
    rows = match(vertices, edges, m["pattern"])
    if m["where"]:
        rows = rows.where(_expression(m["where"]))
    items = []
    for item in re.split(r",\s*(?![^()]*\))", m["returns"]):
        body, _, alias = re.match(r"(.*?)(\s+AS\s+(\w+))?$", item.strip(), re.I | re.S).groups()
        items.append((body.strip(), alias or re.sub(r"\W+", "_", body.strip()).strip("_")))
    is_sum = [bool(re.match(r"(count|sum|avg|min|max|collect)\s*\(", b, re.I)) for b, _ in items]
    cols = [(F.count(F.lit(1)) if re.match(r"count\(\s*\*\s*\)", b, re.I) else _expression(f"{b}.`id`" if re.fullmatch(r"\w+", b) and b in rows.columns else b)).alias(a) for b, a in items]
    if any(is_sum):
        rows = rows.groupBy(*(c for c, s in zip(cols, is_sum, strict=True) if not s)).agg(*(c for c, s in zip(cols, is_sum, strict=True) if s)).select(*(a for _, a in items))
    else:
        rows = rows.select(*cols)
    if m["distinct"]:
        rows = rows.distinct()
    if m["order"]:
        rows = rows.orderBy(*(F.col(re.sub(r"\W+", "_", k.split()[0]).strip("_")).desc() if k.lower().endswith(" desc") else F.col(re.sub(r"\W+", "_", k.split()[0]).strip("_")).asc() for k in map(str.strip, m["order"].split(","))))
    if m["skip"]:
        rows = rows.offset(int(m["skip"]))
    return rows.limit(int(m["limit"])) if m["limit"] else rows
