"""Key-value rows (key, value, expire_at) and sorted sets (set, member, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get(df: DataFrame, key) -> DataFrame:
    return df.where(F.col("key") == F.lit(key))


def batch_get(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("key").distinct(), "key", "left_semi")


def scan(df: DataFrame, start=None, end=None, backward: bool = False) -> DataFrame:
    """Keys from start to before end in order; a missing bound is open."""
    if start is not None:
        df = df.where(F.col("key") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("key") < F.lit(end))
    return df.orderBy(F.col("key").desc() if backward else F.col("key"))


def put(df: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key."""
    return df.join(new.select("key"), "key", "left_anti").unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("key"), "key", "left_anti")


def latest(log: DataFrame, version: str = "version") -> DataFrame:
    """The last write of each key; deletions (null value) leave none."""
    last = log.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "key"]), version).alias("r"))
    return last.select("key", "r.*").where("value is not null")


def alive(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def expire(df: DataFrame, condition: Column, at: Column) -> DataFrame:
    return df.withColumn("expire_at", F.when(condition, at).otherwise(F.col("expire_at")))


def persist(df: DataFrame, condition: Column) -> DataFrame:
    return df.withColumn("expire_at", F.when(~condition, F.col("expire_at")))


def remaining(now: Column) -> Column:
    """Seconds left; null for rows that don't expire."""
    return F.greatest(F.unix_seconds(F.col("expire_at").cast("timestamp")) - F.unix_seconds(now.cast("timestamp")), F.lit(0))


def zadd(df: DataFrame, new: DataFrame) -> DataFrame:
    """Set scores of (set, member); new members are added."""
    return df.join(new.select("set", "member"), ["set", "member"], "left_anti").unionByName(new)


def zrem(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("set", "member"), ["set", "member"], "left_anti")


def zincrby(df: DataFrame, new: DataFrame) -> DataFrame:
    return df.unionByName(new).groupBy("set", "member").agg(F.sum("score").alias("score"))


def zscore(df: DataFrame, name: str, member) -> DataFrame:
    return df.where((F.col("set") == name) & (F.col("member") == F.lit(member))).select("score")


def zcard(df: DataFrame) -> DataFrame:
    return df.groupBy("set").agg(F.count(F.lit(1)).alias("card"))


def zcount(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.groupBy("set").agg(F.count_if(F.col("score").between(low, high)).alias("count"))


def _ranked(df: DataFrame, reverse: bool) -> DataFrame:
    order = [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("set").orderBy(*order)) - 1)


def zrange(df: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members of ranks start to stop, by score then member; negative ranks count from the end."""
    n = F.count(F.lit(1)).over(Window.partitionBy("set"))
    at = lambda i: F.lit(i) if i >= 0 else n + i
    ranked = _ranked(df, reverse).withColumns({"_a": at(start), "_z": at(stop)})
    return ranked.where((F.col("rank") >= F.col("_a")) & (F.col("rank") <= F.col("_z"))).drop("_a", "_z")


def zrank(df: DataFrame, member, reverse: bool = False) -> DataFrame:
    return _ranked(df, reverse).where(F.col("member") == F.lit(member)).select("set", "rank")


def zrangebyscore(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("score").between(low, high))
