"""JSON documents: path extraction, partial updates and bucket aggregations."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extract(doc: Column, path: str) -> Column:
    """Text at a JSONPath of plain steps, [n] and [*]; null where there is nothing."""
    return F.get_json_object(doc, path)


def scan(df: DataFrame, key: str, doc: str, path: str, limit: int | None = 100) -> DataFrame:
    """(doc_id, value, json_path) of the documents that have the path."""
    out = df.select(F.col(key).alias("doc_id"), extract(F.col(doc), path).alias("value"), F.lit(path).alias("json_path")).where("value is not null")
    return out.orderBy("doc_id").limit(limit) if limit else out


_STEP = re.compile(r"\.\.(\w+|\*)|\.(\w+|\*)|\[(\d+|\*)\]|\['([^']*)'\]|\[\?\(@\.(\w+)\s*(==|!=|<=|>=|<|>)\s*('[^']*'|-?[\d.]+|true|false)\)\]")


def _walk(value: object) -> list:
    inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
    return [value] + [x for v in inner for x in _walk(v)]


def find(value: object, path: str) -> list:
    """All values at a JSONPath with recursive descent (..name), wildcards and comparisons [?(@.a > 1)]."""
    found, at = [value], 1
    compare = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"unexpected {path[at:]!r} in path")
        at = m.end()
        deep, name, index, quoted, field, op, raw = m.groups()
        if deep:
            found = [x for v in found for d in _walk(v) if isinstance(d, dict) for x in (d.values() if deep == "*" else [d[deep]] if deep in d else [])]
        elif name == "*" or index == "*":
            found = [x for v in found for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else [])]
        elif name or quoted is not None:
            k = name or quoted
            found = [v[k] for v in found if isinstance(v, dict) and k in v]
        elif index:
            found = [v[int(index)] for v in found if isinstance(v, list) and int(index) < len(v)]
        else:
            b = json.loads(raw.replace("'", '"'))
            items = [x for v in found for x in (v if isinstance(v, list) else [v])]
            found = [x for x in items if isinstance(x, dict) and field in x and type(x[field]) in ((int, float) if isinstance(b, (int, float)) and not isinstance(b, bool) else (type(b),)) and compare[op](x[field], b)]
    return found


def find_all(doc: Column, path: str) -> Column:
    """array<string> of JSON texts at a path that get_json_object can't express, by Arrow batches; null for null and
    for what isn't JSON."""

    def one(doc: str | None) -> list[str] | None:
        try:
            return None if doc is None else [json.dumps(x, ensure_ascii=False) for x in find(json.loads(doc), path)]
        except ValueError:
            return None

    @F.pandas_udf("array<string>")
    def found(docs: pd.Series) -> pd.Series:
        return docs.map(one)

    return found(doc)


def json_type(doc: Column) -> Column:
    """object, array, string, number, boolean or null."""
    first = F.substring(F.ltrim(doc), 1, 1)
    return F.when(doc.isNull(), None).when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")


def array_length(doc: Column) -> Column:
    return F.json_array_length(doc)


def object_size(doc: Column) -> Column:
    return F.size(F.json_object_keys(doc))


def change(fields: Column, op: str, name: str, value: Column | None = None) -> Column:
    """Partial update of a struct column: SET, UNSET, INCREMENT, APPEND (array to array), PUSH or PULL (one item);
    dotted names reach nested fields."""
    old = reduce(lambda c, part: c[part], name.split("."), fields)
    if op == "UNSET":
        return fields.dropFields(name)
    new = {"SET": lambda: value, "INCREMENT": lambda: F.coalesce(old, F.lit(0)) + value, "APPEND": lambda: F.concat(old, value), "PUSH": lambda: F.array_append(old, value), "PULL": lambda: F.array_remove(old, value)}[op]()
    return fields.withField(name, new)


def update_json(doc: Column, schema: str, changes: list[tuple[str, str, Column | None]]) -> Column:
    return F.to_json(reduce(lambda c, x: change(c, *x), changes, F.from_json(doc, schema)))


def terms(df: DataFrame, field: str, size: int = 10, min_doc_count: int = 1) -> DataFrame:
    """(term, count, percent) of the most frequent values; percent of all non-null rows."""
    held = df.where(F.col(field).isNotNull())
    counts = held.groupBy(F.col(field).alias("term")).count()
    return counts.withColumn("percent", 100.0 * F.col("count") / max(held.count(), 1)).where(F.col("count") >= min_doc_count).orderBy(F.col("count").desc(), "term").limit(size)


def ranges(df: DataFrame, field: str, bounds: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """(bucket, count, avg, sum) for half-open ranges [from, to), which may overlap; empty ranges count 0."""
    v = F.col(field)
    aggs = []
    for name, low, high in bounds:
        inside = (v >= low if low is not None else F.lit(True)) & (v < high if high is not None else F.lit(True))
        aggs.append(F.struct(F.lit(name).alias("bucket"), F.count(F.when(inside, v)).alias("count"), F.avg(F.when(inside, v)).alias("avg"), F.sum(F.when(inside, v)).alias("sum")))
    return df.agg(F.array(*aggs).alias("b")).select(F.explode("b").alias("b")).select("b.*")


def histogram(df: DataFrame, field: str, interval: float, min_doc_count: int = 0, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(bucket, count) by floor(v / interval) * interval; with min_doc_count 0 empty buckets between the least and the
    largest (or the extended bounds) are filled."""
    key = F.floor(F.col(field) / interval).cast("long")
    counts = df.where(F.col(field).isNotNull()).groupBy(key.alias("k")).count()
    if min_doc_count == 0:
        low, high = counts.agg(F.min("k"), F.max("k")).first()
        if bounds:
            edges = [int(b // interval) for b in bounds]
            low, high = min(edges[0], edges[0] if low is None else low), max(edges[1], edges[1] if high is None else high)
        if low is not None:
            counts = df.sparkSession.range(low, high + 1).withColumnRenamed("id", "k").join(counts, "k", "left").fillna(0, ["count"])
    return counts.where(F.col("count") >= min_doc_count).select((F.col("k") * interval).alias("bucket"), "count")


def stats(field: str) -> list[Column]:
    """count, min, max, avg, sum, population variance and deviation, median."""
    return [F.count(field).alias("count"), F.min(field).alias("min"), F.max(field).alias("max"), F.avg(field).alias("avg"), F.sum(field).alias("sum"), F.var_pop(field).alias("variance"), F.stddev_pop(field).alias("std"), F.median(field).alias("median")]


def percentiles(field: str, points: list[float], exact: bool = True, accuracy: int = 10000) -> Column:
    return F.percentile(field, [p / 100 for p in points]) if exact else F.percentile_approx(field, [p / 100 for p in points], accuracy)


def cardinality(field: str, error: float = 0.01) -> Column:
    return F.approx_count_distinct(field, error)


def bucket_sort(buckets: DataFrame, by: str, size: int, offset: int = 0, descending: bool = True) -> DataFrame:
    return buckets.orderBy(F.col(by).desc() if descending else F.col(by), *[c for c in buckets.columns if c != by]).offset(offset).limit(size)


def cumulative_sum(buckets: DataFrame, key: str, value: str, into: str = "cumulative") -> DataFrame:
    """Running sum over bucket results, which are few; one window."""
    return buckets.withColumn(into, F.sum(value).over(Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))


def moving_average(buckets: DataFrame, key: str, value: str, window: int, into: str = "moving") -> DataFrame:
    return buckets.withColumn(into, F.avg(value).over(Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(1 - window, 0)))
