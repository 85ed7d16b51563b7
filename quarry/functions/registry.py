"""Registry of user functions with classes, arity checks and type names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

# Type names and their Spark types.
TYPES = {"int": "int", "integer": "int", "int4": "int", "bigint": "bigint", "int8": "bigint", "smallint": "smallint", "tinyint": "tinyint", "real": "float", "float4": "float", "float": "float", "double": "double", "float8": "double", "decimal": "decimal(38,10)", "numeric": "decimal(38,10)", "varchar": "string", "char": "string", "character": "string", "text": "string", "boolean": "boolean", "bool": "boolean", "date": "date", "time": "string", "timestamp": "timestamp_ntz", "blob": "binary", "bytea": "binary"}
CLASSES = ("normal", "aggregate", "window", "procedural", "trigger")
RESULTS = ("scalar", "set", "table")


def spark_type(name: str) -> str:
    """Spark's name of a type; decimal(p, s) and varchar(n) keep their arguments."""
    base, _, rest = name.strip().lower().partition("(")
    if base.strip() not in TYPES:
        raise ValueError(f"unknown type {name!r}")
    if rest and base.strip() in ("decimal", "numeric"):
        return f"decimal({rest}"
    if rest and base.strip() in ("varchar", "char"):
        return f"{base.strip()}({rest}"
    return TYPES[base.strip()]


@dataclass(frozen=True)
class Function:
    name: str
    call: Callable
    least: int
    most: int | None  # None: any number
    kind: str = "normal"
    result: str = "scalar"


class Registry:
    """Functions by name (any case). Scalars take Columns, set and table functions DataFrames."""

    def __init__(self) -> None:
        self.known: dict[str, Function] = {}

    def register(self, f: Function) -> None:
        if f.kind not in CLASSES or f.result not in RESULTS:
            raise ValueError(f"{f.kind}/{f.result} is no kind of function")
        self.known[f.name.lower()] = f

    def lookup(self, name: str) -> Function:
        if name.lower() not in self.known:
            raise KeyError(f"no function {name!r}")
        return self.known[name.lower()]

    def names(self) -> list[str]:
        return sorted(self.known)

    def call(self, name: str, *args) -> Column | DataFrame:
        f = self.lookup(name)
        if len(args) < f.least or (f.most is not None and len(args) > f.most):
            raise TypeError(f"{f.name} takes {f.least} to {f.most or 'any number of'} arguments, not {len(args)}")
        return f.call(*args)


def register_sql(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """Make a Python function or pandas UDF known to SQL text."""
    spark.udf.register(name, function, *(() if hasattr(function, "returnType") else (returns,)))


def standard() -> Registry:
    """The functions every model offers under its usual name."""
    from quarry.operators import document, graph, kv, spatial, text, timeseries, tree, vector

    out = Registry()
    for name, call, least, most, kind, result in (
        ("VECTOR_DISTANCE", vector.distance, 2, 3, "normal", "scalar"),
        ("VECTOR_SEARCH", vector.knn, 3, 6, "normal", "table"),
        ("EMBED_TEXT", text.hashed_embedding, 1, 2, "normal", "scalar"),
        ("TIME_SERIES_AGG", timeseries.aggregate, 3, 5, "aggregate", "table"),
        ("FIRST", timeseries.first_n, 2, 4, "aggregate", "table"),
        ("LAST", timeseries.last_n, 2, 4, "aggregate", "table"),
        ("RATE", timeseries.rate, 1, 5, "window", "table"),
        ("GRAPH_TRAVERSE", graph.traverse, 3, 6, "normal", "table"),
        ("GRAPH_SHORTEST_PATH", graph.shortest_path, 3, 5, "normal", "table"),
        ("GRAPH_PAGERANK", graph.pagerank, 1, 5, "normal", "table"),
        ("GRAPH_NEIGHBORS", graph.neighbours, 2, 4, "normal", "table"),
        ("MATCH", text.match, 2, 3, "normal", "scalar"),
        ("HIGHLIGHT", text.highlight, 2, 4, "normal", "scalar"),
        ("JSON_EXTRACT", document.extract, 2, 2, "normal", "scalar"),
        ("ST_Distance", spatial.distance, 2, 2, "normal", "scalar"),
        ("ST_Contains", spatial.contains, 2, 2, "normal", "scalar"),
        ("ST_Within", spatial.within, 2, 2, "normal", "scalar"),
        ("ST_Intersects", spatial.intersects, 2, 2, "normal", "scalar"),
        ("ZADD", kv.zadd, 2, 2, "normal", "table"),
        ("ZSCORE", kv.zscore, 3, 3, "normal", "table"),
        ("TREE_ANCESTORS", tree.ancestors, 1, 1, "normal", "scalar"),
        ("TREE_DESCENDANTS", tree.descendants, 2, 3, "normal", "table"),
        ("TREE_DEPTH", tree.depth, 1, 1, "normal", "scalar"),
    ):
        out.register(Function(name, call, least, most, kind, result))
    return out
