"""Time series over (ts, value) rows; times are epoch milliseconds, buckets floored from the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Widths of the fixed granularities in milliseconds. Months and years follow the calendar.
WIDTHS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "quarter": 7_776_000_000}
# How long rollups of each width are kept, in days (None: forever).
RETENTION = {"1 minute": 7, "5 minutes": 30, "1 hour": 365, "1 day": None}
_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp in the session's zone."""
    return F.unix_millis(ts.cast("timestamp"))


def granularity(name: str) -> str:
    """The granularity that a name in any case, singular or plural, stands for."""
    short = name.strip().lower().rstrip("s")
    if short not in (*WIDTHS, "month", "year"):
        raise ValueError(f"unknown granularity {name!r}")
    return short


def date_trunc(ms: Column, unit: str) -> Column:
    unit = granularity(unit)
    if unit in WIDTHS:
        return bucket(ms, WIDTHS[unit])
    return F.unix_millis(F.date_trunc(unit, F.timestamp_millis(ms)))


def bucket(ms: Column, width: int, origin: int = 0) -> Column:
    """Start of the bucket, a true floor before the origin too."""
    return (ms - F.pmod(ms - origin, F.lit(width))).cast("long")


def extract(field: str, ts: Column) -> Column:
    """year, month, day, hour, minute, second, dow (Sunday is 0), doy or epoch (whole seconds)."""
    f = field.lower()
    if f == "dow":
        return F.dayofweek(ts) - 1
    if f == "epoch":
        return F.floor(millis(ts) / 1000).cast("long")
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "doy": F.dayofyear}[f](ts)


def bucket_id(value: Column, width: float, start: float) -> Column:
    return F.greatest(F.floor((value - start) / width).cast("int"), F.lit(0))


def aggregate(df: DataFrame, unit: str | int, how: str, ms: str = "ms", value: str = "value", by: list[str] | None = None, place: str | None = None) -> DataFrame:
    """(by, bucket, value) per granularity or width in milliseconds; empty buckets are left out.

    Of rows of one time, 'first' and 'last' take the row of the least ``place``, a number that tells rows apart, or
    the least value where none is given. Null values don't count.
    """
    start = bucket(F.col(ms), unit) if isinstance(unit, int) else date_trunc(F.col(ms), unit)
    at = lambda sign: F.when(F.col(value).isNotNull(), F.struct(F.col(ms), sign * F.col(place or value)))
    agg = {"first": F.min_by(value, at(1)), "last": F.max_by(value, at(-1))}.get(how)
    return df.groupBy(*(by or []), start.alias("bucket")).agg((agg if agg is not None else _AGGREGATES[how](value)).alias("value"))


def range_scan(df: DataFrame, start: int, stop: int, how: str | None = None, unit: str | None = None, ms: str = "ms", value: str = "value") -> DataFrame:
    """Aggregate over start <= ms < stop. Without a unit the window's width picks one; without a function a range
    over an hour averages, others sum."""
    width = stop - start
    unit = unit or next((u for u in ("second", "minute", "hour") if width <= WIDTHS[u]), "day")
    return aggregate(df.where((F.col(ms) >= start) & (F.col(ms) < stop)), unit, how or ("avg" if width > WIDTHS["hour"] else "sum"), ms, value)


def first_n(df: DataFrame, n: int, ms: str = "ms", by: list[str] | None = None, last: bool = False) -> DataFrame:
    """The n earliest (or latest) rows, of each group if given."""
    order = [F.col(ms).desc() if last else F.col(ms), *(F.col(c) for c in df.columns if c != ms and c not in (by or []))]
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def last_n(df: DataFrame, n: int, ms: str = "ms", by: list[str] | None = None) -> DataFrame:
    return first_n(df, n, ms, by, True)


def derivative(df: DataFrame, ms: str = "ms", value: str = "value", by: list[str] | None = None, into: str = "derivative") -> DataFrame:
    """Change per millisecond from the row before; 0 where no time has passed, null for a series' first row."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(ms, value)
    dt = F.col(ms) - F.lag(ms).over(w)
    return df.withColumn(into, F.when(dt == 0, 0.0).when(dt.isNotNull(), (F.col(value) - F.lag(value).over(w)) / F.nullif(dt, F.lit(0))))


def rate(df: DataFrame, ms: str = "ms", value: str = "value", by: list[str] | None = None, into: str = "rate") -> DataFrame:
    """As derivative, but never negative."""
    return derivative(df, ms, value, by, into).withColumn(into, F.greatest(F.col(into), F.when(F.col(into).isNotNull(), 0.0)))


def histogram(df: DataFrame, width: float = 1.0, low: float | None = None, high: float | None = None, value: str = "value", cumulative: bool = False) -> DataFrame:
    """(bucket, low, high, count) with empty buckets; values beyond the last bucket count in it."""
    if low is None or high is None:
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is None:
            return df.sparkSession.createDataFrame([], "bucket int, low double, high double, count bigint")
    n = max(int(-(-(high - low) // width)), 1)
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    counts = df.where(F.col(value) >= low).groupBy(F.least(F.floor((F.col(value) - low) / width), F.lit(n - 1)).cast("int").alias("bucket")).count()
    out = spine.join(counts, "bucket", "left").select("bucket", (low + F.col("bucket") * width).alias("low"), (low + (F.col("bucket") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))
    if cumulative:
        out = out.withColumn("count", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("bucket")))
    return out


def buckets(df: DataFrame, n: int = 10, ms: str = "ms", value: str = "value") -> DataFrame:
    """n equal-width buckets of the values: (bucket, midpoint, count, first_ms); empty ones are left out."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = ((high - low) / n or 1.0) if low is not None else 1.0
    i = F.least(F.floor((F.col(value) - (low or 0.0)) / width), F.lit(n - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(i.alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.min(ms).alias("first_ms")).withColumn("midpoint", (low or 0.0) + (F.col("bucket") + 0.5) * width)


def percentile(value: str, p: float) -> Column:
    """Linear interpolation at p / 100 * (n - 1)."""
    return F.percentile(value, p / 100)


def rollup_state(df: DataFrame, width: int, ms: str = "ms", value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Mergeable partial aggregates of each bucket: sum, count, min, max, first and last."""
    return df.groupBy(*(by or []), bucket(F.col(ms), width).alias("bucket")).agg(F.sum(value).alias("sum"), F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.min(F.struct(F.col(ms).alias("ms"), F.col(value).alias("value"))).alias("first"), F.max(F.struct(F.col(ms).alias("ms"), F.col(value).alias("value"))).alias("last"))


def merge_states(states: DataFrame, width: int, by: list[str] | None = None) -> DataFrame:
    """Coarser (or equal) buckets from partial aggregates; the average comes from sum and count."""
    out = states.groupBy(*(by or []), bucket(F.col("bucket"), width).alias("bucket")).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.min("first").alias("first"), F.max("last").alias("last"))
    return out.withColumn("avg", F.try_divide(F.col("sum"), F.col("count")))


def retained(df: DataFrame, now_ms: int, ttl_ms: int, ms: str = "ms") -> DataFrame:
    """Rows that are younger than the ttl; a ttl of 0 or less keeps all."""
    return df if ttl_ms <= 0 else df.where(F.col(ms) >= now_ms - ttl_ms)


def tier(ms: Column, now_ms: int, hot_ms: int, warm_ms: int) -> Column:
    age = F.lit(now_ms) - ms
    return F.when(age <= hot_ms, "hot").when(age <= warm_ms, "warm").otherwise("cold")


def tag_condition(tags: Column, key: str, op: str, value: object = None) -> Column:
    """EQ, NE, IN, REGEX, EXISTS or NOT_EXISTS on a map of tags; a missing tag satisfies NE and NOT_EXISTS."""
    v = tags[key]
    if op == "EXISTS":
        return v.isNotNull()
    if op == "NOT_EXISTS":
        return v.isNull()
    if op == "NE":
        return v.isNull() | (v != F.lit(value))
    found = {"EQ": lambda: v == F.lit(value), "IN": lambda: v.isin(list(value)), "REGEX": lambda: v.rlike(value)}[op]()
    return F.coalesce(found, F.lit(False))


def top_tags(df: DataFrame, tags: str, key: str, n: int) -> DataFrame:
    return df.where(F.col(tags)[key].isNotNull()).groupBy(F.col(tags)[key].alias("tag")).count().orderBy(F.col("count").desc(), "tag").limit(n)
