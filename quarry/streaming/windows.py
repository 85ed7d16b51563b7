"""Window operators over (ms, value) rows, for tables and, where named so, for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[str], Column]] = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}


def after(df: DataFrame, watermark_ms: int, ms: str = "ms") -> DataFrame:
    """Records later than a watermark used as a read filter."""
    return df.where(F.col(ms) > watermark_ms)


def tumbling(df: DataFrame, size: int, ms: str = "ms", fill_empty: bool = True) -> DataFrame:
    """(window_start, window_end, value_count) of [start, start + size), aligned to the epoch; empty windows between
    occupied ones count 0 if asked for."""
    start = (F.col(ms) - F.pmod(F.col(ms), F.lit(size))).cast("long")
    counts = df.groupBy(start.alias("window_start")).agg(F.count(F.lit(1)).alias("value_count"))
    if fill_empty:
        ends = counts.agg(F.min("window_start").alias("a"), F.max("window_start").alias("z")).where("a is not null")
        spine = ends.select(F.explode(F.sequence("a", "z", F.lit(size).cast("long"))).alias("window_start"))
        counts = spine.join(counts, "window_start", "left").fillna(0, ["value_count"])
    return counts.select("window_start", (F.col("window_start") + size).alias("window_end"), "value_count")


def sliding(df: DataFrame, size: int, slide: int | None = None, ms: str = "ms") -> DataFrame:
    """Windows anchored at the first record that advance by slide while they start before the last record, empty ones
    too. Each record goes to its own windows by arithmetic; no range join."""
    slide = slide or size
    low, high = df.agg(F.min(ms), F.max(ms)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "window_start long, window_end long, value_count long")
    n = max(-(-(high - low) // slide), 1)
    back = F.col(ms) - low
    first, last = F.greatest(F.floor((back - size) / slide) + 1, F.lit(0)).cast("long"), F.least(F.floor(back / slide), F.lit(n - 1)).cast("long")
    counts = df.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)))).groupBy("_k").agg(F.count(F.lit(1)).alias("value_count"))
    spine = df.sparkSession.range(n).withColumnRenamed("id", "_k")
    start = F.col("_k") * slide + low
    return spine.join(counts, "_k", "left").select(start.alias("window_start"), (start + size).alias("window_end"), F.coalesce("value_count", F.lit(0)).alias("value_count"))


def session(df: DataFrame, gap: int, ms: str = "ms", by: list[str] | None = None) -> DataFrame:
    """(by, window_start, window_end, value_count): a record joins while at most gap after the one before; the end is
    the last record's time."""
    ts = F.timestamp_millis(F.col(ms))
    grouped = df.groupBy(*(by or []), F.session_window(ts, f"{gap} milliseconds").alias("w")).agg(F.min(ms).alias("window_start"), F.max(ms).alias("window_end"), F.count(F.lit(1)).alias("value_count"))
    return grouped.select(*(by or []), "window_start", "window_end", "value_count")


def windowed(df: DataFrame, kind: str, size: int, slide: int | None = None, gap: int | None = None, ms: str = "ms") -> DataFrame:
    """Dispatch by kind; the gap defaults to the size."""
    return {"tumbling": lambda: tumbling(df, size, ms), "sliding": lambda: sliding(df, size, slide, ms), "session": lambda: session(df, gap or size, ms)}[kind]()


def aggregated(df: DataFrame, size: int, how: str, ms: str = "ms", value: str = "value") -> DataFrame:
    """(window_end, agg_result) of epoch-aligned windows; empty ones are left out."""
    start = (F.col(ms) - F.pmod(F.col(ms), F.lit(size))).cast("long")
    return df.groupBy((start + size).alias("window_end")).agg(AGGREGATES[how](value).cast("double").alias("agg_result"))


def stream_windows(stream: DataFrame, ts: str, size: str, slide: str | None = None, delay: str = "0 seconds", by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Counts, sums and averages per window of a stream, late rows beyond the delay dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = timed.groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("value_count"), F.sum(value).alias("value_sum"), F.avg(value).alias("value_avg"))
    return out.select(F.unix_millis("w.start").alias("window_start"), F.unix_millis("w.end").alias("window_end"), *(by or []), "value_count", "value_sum", "value_avg")


def stream_sessions(stream: DataFrame, ts: str, gap: str, delay: str = "0 seconds", by: list[str] | None = None) -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = timed.groupBy(F.session_window(ts, gap).alias("w"), *(by or [])).agg(F.min(ts).alias("a"), F.max(ts).alias("z"), F.count(F.lit(1)).alias("value_count"))
    return out.select(F.unix_millis("a").alias("window_start"), F.unix_millis("z").alias("window_end"), *(by or []), "value_count")


def stream_interval_join(left: DataFrame, right: DataFrame, lts: str, rts: str, seconds: int, delay: str = "10 seconds") -> DataFrame:
    """Pairs of two streams at most so many seconds apart, equated by time buckets; watermarks bound the state."""
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c)) / max(seconds, 1)).cast("long")
    a = left.withColumn(lts, F.col(lts).cast("timestamp")).withWatermark(lts, delay).withColumn("_lb", bucket(lts))
    b = right.withColumn(rts, F.col(rts).cast("timestamp")).withWatermark(rts, delay).withColumn("_rb", F.explode(F.array(*(bucket(rts) + d for d in (-1, 0, 1)))))
    near = F.expr(f"{rts} between {lts} - interval {seconds} seconds and {lts} + interval {seconds} seconds")
    return a.join(b, (F.col("_lb") == F.col("_rb")) & near).drop("_lb", "_rb")


def late(df: DataFrame, watermark_ms: int, ms: str = "ms") -> DataFrame:
    """What a watermark leaves out, for a side output."""
    return df.where(F.col(ms) <= watermark_ms)


def refresh_rollup(spark, path: str, width: int, by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps rollup states (sum, count, min, max, first, last) under a path: each batch
    adds its partial states as a folder of its own number, so a repeated batch writes the same rows again."""
    from quarry.operators import timeseries

    def add(batch: DataFrame, number: int) -> None:
        timeseries.rollup_state(batch, width, by=by).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def first_seen(df: DataFrame, key: str, ms: str = "ms") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ms))).where("_n = 1").drop("_n")
