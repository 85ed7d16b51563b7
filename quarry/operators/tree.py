"""Trees keyed by slash paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def depth(path: Column) -> Column:
    """Number of steps; the root '/' has 0."""
    return F.size(parts(path))


def parent(path: Column) -> Column:
    """The path one step up; null for the root."""
    return F.when(depth(path) > 0, F.concat(F.lit("/"), F.array_join(F.slice(parts(path), 1, F.greatest(depth(path) - 1, F.lit(0))), "/")))


def leaf(path: Column) -> Column:
    return F.try_element_at(parts(path), F.lit(-1))


def ancestors(path: Column) -> Column:
    """Paths from the first step to the path itself."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/")))


def descendants(df: DataFrame, path: str, column: str = "path") -> DataFrame:
    return df.where(F.startswith(F.col(column), F.lit(path.rstrip("/") + "/")) & (F.col(column) != "/"))


def children(df: DataFrame, path: str, column: str = "path") -> DataFrame:
    return descendants(df, path, column).where(depth(F.col(column)) == len([x for x in path.split("/") if x]) + 1)


def matches(path: Column, pattern: str) -> Column:
    """Exact path, a prefix where the pattern ends in *, all for **."""
    if pattern == "**":
        return path.isNotNull()
    return F.startswith(path, F.lit(pattern[:-1])) if pattern.endswith("*") else path == pattern


def without_subtree(df: DataFrame, path: str, column: str = "path") -> DataFrame:
    return df.where((F.col(column) != path) & ~F.startswith(F.col(column), F.lit(path.rstrip("/") + "/")))
