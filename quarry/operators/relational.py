"""Joins, set operations, row changes and routing that need more than one DataFrame call."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, interval_ms: int, left_ms: str, right_ms: str, keys: list[str] | None = None) -> DataFrame:
    """All pairs with abs(left_ms - right_ms) <= interval_ms (and equal keys, if given).

    The band becomes an equality on time buckets as wide as the interval: the right side stands in its own
    bucket and both neighbours, so no pair is tested against all rows. Columns of both sides must differ but for
    the keys. Rows with null times join nothing.
    """
    keys = keys or []
    width = max(interval_ms, 1)
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.withColumn("_bucket", bucket(left_ms))
    b = right.withColumn("_bucket", F.explode(F.array(*(bucket(right_ms) + d for d in (-1, 0, 1)))))
    joined = a.join(b.hint("merge"), ["_bucket", *keys])  # Spark takes the three copies for one, and might broadcast them
    return joined.where(F.abs(F.col(left_ms) - F.col(right_ms)) <= interval_ms).drop("_bucket")


def merge_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by sort and merge; repeated keys give every combination."""
    return left.hint("merge").join(right, on, how)


_SHARES = 16  # parts into which the left rows of a key are dealt


def hash_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by shuffled hash tables of the right side, which should be the smaller one.

    Repeated keys give every combination, so few keys make few and long tasks, however small both sides are. The left
    rows of a key are dealt by hash to ``_SHARES`` shares, each of which meets a copy of the key's right rows. Right
    rows without a match are added by an anti-join: a hash table that keeps account of each pair is slower. Semi- and
    anti-joins give a row once at the most, and are plain; so are joins with maps or with columns of equal names.
    """
    plain = left.join(right.hint("shuffle_hash"), on, how)
    kind = how.lower().replace("_", "").removesuffix("outer") or "full"
    kinds = {"inner": "inner", "left": "left", "right": "inner", "full": "left"}
    if kind not in kinds or len(set(plain.columns)) < len(plain.columns) or any("map<" in t or t == "variant" for _, t in left.dtypes):
        return plain
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_share", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(_SHARES)))
    copies = right.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SHARES - 1).cast("long"))))
    keys = [*on, "_share"]
    out = dealt.repartition(n, *keys).join(copies.repartition(n, *keys).hint("shuffle_hash"), keys, kinds[kind]).drop("_share")
    if kind in ("right", "full"):
        out = out.unionByName(right.join(left.select(*on).distinct(), on, "left_anti"), allowMissingColumns=True)
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in plain.schema.fields))


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join on any condition; equalities in it are still used as keys."""
    return left.join(right, condition, how)


def weighted_union(sets: list[tuple[DataFrame, float]], how: str = "sum") -> DataFrame:
    """(member, score) of the members of any set; scores times weights, combined by sum, min or max."""
    rows = reduce(DataFrame.unionByName, (s.select("member", (F.col("score") * w).alias("score")) for s, w in sets))
    return rows.groupBy("member").agg(getattr(F, how)("score").alias("score"))


def weighted_intersection(sets: list[tuple[DataFrame, float]], how: str = "sum") -> DataFrame:
    """(member, score) of the members of every set; a set has a member once."""
    rows = reduce(DataFrame.unionByName, (s.select("member", (F.col("score") * w).alias("score")) for s, w in sets))
    return rows.groupBy("member").agg(getattr(F, how)("score").alias("score"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(sets)).drop("_n")


Trigger = Callable[[DataFrame], DataFrame]


class Table:
    """A DataFrame with copy-on-write changes. Each change returns the new table and the affected rows.

    BEFORE triggers map the rows a change is about to write, AFTER triggers see the affected rows; both are
    functions from DataFrame to DataFrame, held by event ('insert', 'update', 'delete').
    """

    def __init__(self, rows: DataFrame, before: dict[str, list[Trigger]] | None = None, after: dict[str, list[Trigger]] | None = None) -> None:
        self.rows, self.before, self.after = rows, before or {}, after or {}

    def _run(self, kind: str, event: str, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, t: t(df), getattr(self, kind).get(event, []), rows)

    def _with(self, rows: DataFrame) -> Table:
        return Table(rows, self.before, self.after)

    def insert(self, new: DataFrame) -> tuple[Table, DataFrame]:
        new = self._run("before", "insert", new)
        return self._with(self.rows.unionByName(new, allowMissingColumns=True)), self._run("after", "insert", new)

    def update(self, condition: Column, values: dict[str, Column]) -> tuple[Table, DataFrame]:
        """Rows where the condition is true take the values; null counts as false."""
        hit = F.coalesce(condition, F.lit(False))
        changed = self._run("before", "update", self.rows.where(hit).withColumns(values).select(self.rows.columns))
        return self._with(self.rows.where(~hit).unionByName(changed)), self._run("after", "update", changed)

    def delete(self, condition: Column) -> tuple[Table, DataFrame]:
        hit = F.coalesce(condition, F.lit(False))
        gone = self._run("before", "delete", self.rows.where(hit))
        return self._with(self.rows.where(~hit)), self._run("after", "delete", gone)


def auto_timestamp(column: str, at: Column) -> Trigger:
    return lambda df: df.withColumn(column, at)


def validate_data(condition: Column) -> Trigger:
    """Keep the rows that satisfy the condition."""
    return lambda df: df.where(F.coalesce(condition, F.lit(False)))


def audit_log(event: str, key: str) -> Trigger:
    return lambda df: df.select(F.lit(event).alias("event"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("image"))


def hash_route(key: Column, n: int) -> Column:
    """Partition number of an integer key, never negative."""
    return F.pmod(key, F.lit(n))


def range_route(key: Column, bounds: list) -> Column:
    """Number of the half-open range that holds the key: below bounds[0] is 0, from the last on len(bounds)."""
    return reduce(lambda c, b: c + F.when(key >= b, 1).otherwise(0), bounds, F.lit(0))


def list_route(key: Column, lists: list[list]) -> Column:
    """Number of the first list that holds the key, -1 if none does."""
    out = F
    for i, values in enumerate(lists):
        out = out.when(key.isin(values), i)
    return out.otherwise(-1)


def change_feed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(keys, op, before, after) between two snapshots with unique keys; images are JSON, equal rows are left out."""
    image = lambda df, n: df.select(*key, F.to_json(F.struct(*[c for c in df.columns if c not in key])).alias(n))
    both = image(before, "before").join(image(after, "after"), key, "full")
    op = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").when(F.col("before") != F.col("after"), "UPDATE")
    return both.withColumn("op", op).where("op is not null")


def violations(df: DataFrame, not_null: list[str] = (), unique: list[str] = (), foreign: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """(constraint, violations) for each constraint."""
    parts = [df.where(F.col(c).isNull()).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"not_null({c})").alias("constraint"), "violations") for c in not_null]
    parts += [df.where(F.col(c).isNotNull()).groupBy(c).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"unique({c})").alias("constraint"), "violations") for c in unique]
    parts += [df.where(F.col(c).isNotNull()).join(other.select(F.col(k).alias(c)), c, "left_anti").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"foreign({c})").alias("constraint"), "violations") for c, other, k in foreign]
    return reduce(DataFrame.union, parts)


def ledger_problems(entries: DataFrame, order: str, account: str) -> DataFrame:
    """Entries (id order, prev_hash, hash, payload) whose hash isn't sha256(prev_hash || payload) or whose prev_hash isn't
    the hash of the account's entry before."""
    before = F.lag("hash").over(Window.partitionBy(account).orderBy(order))
    bad = F.when(F.col("hash") != F.sha2(F.concat(F.coalesce("prev_hash", F.lit("")), "payload"), 256), "hash").when(~F.col("prev_hash").eqNullSafe(before), "chain")
    return entries.withColumn("problem", bad).where("problem is not null")
