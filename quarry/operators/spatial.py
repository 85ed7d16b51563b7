"""Planar geometry from WKT as struct(kind, rings array<array<struct<x, y>>>), built of Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH = 6371000.0  # metres


def parse_wkt(text: Column) -> Column:
    """POINT, LINESTRING and POLYGON (holes are further rings), MULTIPOINT and MULTILINESTRING as parts."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    rings = F.regexp_extract_all(F.regexp_replace(text, r"\(\s*\(", "("), F.lit(r"\(([^()]*)\)"), F.lit(1))
    point = lambda p: F.struct(F.element_at(F.split(F.trim(p), r"\s+"), 1).cast("double").alias("x"), F.element_at(F.split(F.trim(p), r"\s+"), 2).cast("double").alias("y"))
    return F.struct(kind.alias("kind"), F.transform(rings, lambda r: F.transform(F.split(r, ","), point)).alias("rings"))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("POINT").alias("kind"), F.array(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))).alias("rings"))


def to_wkt(g: Column, digits: int = 6) -> Column:
    number = lambda v: F.regexp_replace(F.format_string(f"%.{digits}f", v), r"\.?0+$", "")
    ring = lambda r: F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))), ", ")
    flat = F.concat(F.lit("("), ring(g["rings"][0]), F.lit(")"))
    nested = F.concat(F.lit("("), F.array_join(F.transform(g["rings"], lambda r: F.concat(F.lit("("), ring(r), F.lit(")"))), ", "), F.lit(")"))
    return F.concat_ws(" ", g["kind"], F.when(g["kind"].isin("POLYGON", "MULTILINESTRING"), nested).otherwise(flat))


def bbox(g: Column) -> Column:
    points = F.flatten(g["rings"])
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(side(F.array_min, "x").alias("x1"), side(F.array_min, "y").alias("y1"), side(F.array_max, "x").alias("x2"), side(F.array_max, "y").alias("y2"))


def box(x1: float, y1: float, x2: float, y2: float) -> Column:
    return F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)))


def box_contains(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def box_intersects(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def box_area(a: Column) -> Column:
    return F.greatest(a["x2"] - a["x1"], F.lit(0.0)) * F.greatest(a["y2"] - a["y1"], F.lit(0.0))


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))


def box_enlargement(a: Column, b: Column) -> Column:
    return box_area(box_union(a, b)) - box_area(a)


def box_distance(a: Column, b: Column) -> Column:
    gap = lambda lo, hi: F.greatest(a[lo] - b[hi], b[lo] - a[hi], F.lit(0.0))
    return F.hypot(gap("x1", "x2"), gap("y1", "y2"))


def _segments(g: Column) -> Column:
    """Consecutive points of every ring; a point is a segment of itself."""
    return F.flatten(F.transform(g["rings"], lambda r: F.when(F.size(r) == 1, F.array(F.struct(r[0].alias("a"), r[0].alias("b")))).otherwise(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))))


def _to_segment(p: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / F.nullif(n, F.lit(0.0)))))
    return F.hypot(p["x"] - s["a"]["x"] - t * dx, p["y"] - s["a"]["y"] - t * dy)


def _side(o: Column, a: Column, b: Column) -> Column:
    return F.signum((a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"]))


def _cross(s: Column, t: Column) -> Column:
    return (_side(s["a"], s["b"], t["a"]) * _side(s["a"], s["b"], t["b"]) < 0) & (_side(t["a"], t["b"], s["a"]) * _side(t["a"], t["b"], s["b"]) < 0)


def covers_point(g: Column, p: Column) -> Column:
    """Whether a polygon holds a point: inside by ray casting over all rings (holes flip it), or on the border."""
    on = F.exists(_segments(g), lambda s: _to_segment(p, s) < 1e-12)
    flips = F.aggregate(_segments(g), F.lit(0), lambda n, s: n + F.when(((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) + s["a"]["x"]), 1).otherwise(0))
    return on | ((g["kind"] == "POLYGON") & (flips % 2 == 1))


def intersects(a: Column, b: Column) -> Column:
    touch = F.exists(_segments(a), lambda s: F.exists(_segments(b), lambda t: _cross(s, t)))
    corner = F.exists(F.flatten(b["rings"]), lambda p: covers_point(a, p)) | F.exists(F.flatten(a["rings"]), lambda p: covers_point(b, p))
    return box_intersects(bbox(a), bbox(b)) & (corner | touch)


def contains(a: Column, b: Column) -> Column:
    """Whether every corner of b lies in a and no edges cross."""
    return F.forall(F.flatten(b["rings"]), lambda p: covers_point(a, p)) & ~F.exists(_segments(a), lambda s: F.exists(_segments(b), lambda t: _cross(s, t)))


def within(a: Column, b: Column) -> Column:
    return contains(b, a)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance, 0 where they intersect."""
    nearest = lambda g, h: F.array_min(F.flatten(F.transform(F.flatten(g["rings"]), lambda p: F.transform(_segments(h), lambda s: _to_segment(p, s)))))
    return F.when(intersects(a, b), 0.0).otherwise(F.least(nearest(a, b), nearest(b, a)))


def relation(name: str, a: Column, b: Column) -> Column:
    """INTERSECTS, DISJOINT, CONTAINS, WITHIN, COVERS, EQUALS, TOUCHES, OVERLAPS or CROSSES."""
    inner = lambda g, h: F.exists(F.flatten(h["rings"]), lambda p: covers_point(g, p) & ~F.exists(_segments(g), lambda s: _to_segment(p, s) < 1e-12)) | F.exists(_segments(g), lambda s: F.exists(_segments(h), lambda t: _cross(s, t)))
    return {
        "INTERSECTS": lambda: intersects(a, b), "DISJOINT": lambda: ~intersects(a, b), "CONTAINS": lambda: contains(a, b), "COVERS": lambda: contains(a, b),
        "WITHIN": lambda: contains(b, a), "EQUALS": lambda: contains(a, b) & contains(b, a), "TOUCHES": lambda: intersects(a, b) & ~inner(a, b) & ~inner(b, a),
        "OVERLAPS": lambda: intersects(a, b) & ~contains(a, b) & ~contains(b, a) & (inner(a, b) | inner(b, a)),
        "CROSSES": lambda: F.exists(_segments(a), lambda s: F.exists(_segments(b), lambda t: _cross(s, t))),
    }[name.upper()]()


def sphere_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres by the haversine formula."""
    rad = lambda c: c * (math.pi / 180)
    h = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def buffer(x: Column, y: Column, radius: float, corners: int = 32) -> Column:
    """A point's buffer as a regular polygon."""
    angle = lambda i: i * (2 * math.pi / corners)
    ring = F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.struct((x + radius * F.cos(angle(i % corners))).alias("x"), (y + radius * F.sin(angle(i % corners))).alias("y")))
    return F.struct(F.lit("POLYGON").alias("kind"), F.array(ring).alias("rings"))


def box_search(df: DataFrame, x: str, y: str, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Points in a box, ends included; plain comparisons that reach the scan."""
    return df.where(F.col(x).between(x1, x2) & F.col(y).between(y1, y2))


def nearest(df: DataFrame, key: str, x: str, y: str, px: float, py: float, k: int) -> DataFrame:
    """(key, x, y, distance, rank) of the k nearest points, ties to smaller keys."""
    best = df.select(key, x, y, F.hypot(F.col(x) - px, F.col(y) - py).alias("distance")).orderBy("distance", key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", key)))


def distance_join(left: DataFrame, right: DataFrame, radius: float, lx: str, ly: str, rx: str, ry: str) -> DataFrame:
    """Pairs of points at most radius apart: grid cells as wide as the radius make it an equi-join.

    It goes by sort and merge: Spark takes the nine copies of the right side for the size of one, and would broadcast
    them through the driver.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.explode(F.array(*(F.struct((cell(rx) + i).alias("_cx"), (cell(ry) + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = left.withColumns({"_cx": cell(lx), "_cy": cell(ly)})
    b = right.withColumn("_c", near).select("*", "_c.*").drop("_c")
    return a.join(b.hint("merge"), ["_cx", "_cy"]).where(F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry)) <= radius).drop("_cx", "_cy")


def hilbert(x: Column, y: Column, bits: int = 8) -> Column:
    """Place of integer cell (x, y) on the Hilbert curve of 2^bits cells a side; a sort key that keeps near cells near."""
    state = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, s: Column) -> Column:
        rx, ry = (acc["x"].bitwiseAND(s) > 0).cast("long"), (acc["y"].bitwiseAND(s) > 0).cast("long")
        d = acc["d"] + s * s * F.when((rx == 1) & (ry == 0), 3).when((rx == 1) & (ry == 1), 2).when((rx == 0) & (ry == 1), 1).otherwise(0)
        n = F.lit((1 << bits) - 1).cast("long")
        fx, fy = F.when((ry == 0) & (rx == 1), n - acc["x"]).otherwise(acc["x"]), F.when((ry == 0) & (rx == 1), n - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.cast("long").alias("d"))

    return F.aggregate(F.array(*(F.lit(1 << i).cast("long") for i in reversed(range(bits)))), state, step)["d"]
