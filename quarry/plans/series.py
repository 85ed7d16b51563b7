"""Time series and window queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import relational as rel
from quarry.operators import timeseries as ts
from quarry.plans.base import Suite
from quarry.streaming import windows as win

S = Suite()
HOUR, DAY = 3_600_000, 86_400_000


def points(t):
    return t.events.select("event_id", "user_id", "event_type", ts.millis(F.col("ts")).alias("ms"), "value")


E = "(SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, value FROM events)"
R = lambda df, *cols: df.withColumns({c: F.round(c, 8) for c in cols})

S.op("ts_date_trunc", lambda t: points(t).select("event_id", ts.date_trunc(F.col("ms"), "hour").alias("h"), ts.date_trunc(F.col("ms"), "week").alias("w"), ts.date_trunc(F.col("ms"), "month").alias("m")), f"SELECT event_id, ms - ms % {HOUR} AS h, ms - ms % 604800000 AS w, epoch_ms(date_trunc('month', make_timestamp(ms * 1000))) AS m FROM {E}")
S.op("ts_extract", lambda t: t.events.select("event_id", *(ts.extract(f, F.col("ts")).cast("long").alias(f) for f in ("year", "month", "day", "hour", "minute", "dow", "doy", "epoch"))), "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, dayofweek(ts) AS dow, dayofyear(ts) AS doy, epoch_us(ts) // 1000000 AS epoch FROM events")
S.op("ts_date_bucket", lambda t: points(t).select("event_id", ts.bucket(F.col("ms"), 7_000_000, 1_704_100_000_000).alias("b")), f"SELECT event_id, 1704100000000 + CAST(floor((ms - 1704100000000) / 7000000.0) AS BIGINT) * 7000000 AS b FROM {E}")
S.op("ts_bucket_id", lambda t: points(t).select("event_id", ts.bucket_id(F.col("value"), 10.0, 5.0).alias("b")), f"SELECT event_id, CAST(greatest(floor((value - 5.0) / 10.0), 0) AS INTEGER) AS b FROM {E}")
S.op("ts_aggregate", lambda t: R(ts.aggregate(points(t), "day", "avg", by=["event_type"]), "value"), f"SELECT event_type, ms - ms % {DAY} AS bucket, round(avg(value), 8) AS value FROM {E} GROUP BY ALL")
S.op("ts_range_scan", lambda t: R(ts.range_scan(points(t), 1_704_200_000_000, 1_705_000_000_000), "value"), f"SELECT ms - ms % {DAY} AS bucket, round(avg(value), 8) AS value FROM {E} WHERE ms >= 1704200000000 AND ms < 1705000000000 GROUP BY ALL")
S.op("ts_first_n", lambda t: ts.first_n(points(t).select("event_id", "ms", "event_type"), 3, by=["event_type"]), f"SELECT event_id, ms, event_type FROM {E} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ms, event_id) <= 3")
S.op("ts_last_n", lambda t: ts.last_n(points(t).select("event_id", "ms"), 5), f"SELECT event_id, ms FROM {E} ORDER BY ms DESC, event_id LIMIT 5")
S.op("ts_derivative", lambda t: ts.derivative(points(t), by=["user_id"]).select("event_id", (F.round(F.col("derivative") * 1e6, 3) + 0.0).alias("d")), f"SELECT event_id, round(CASE WHEN dt = 0 THEN 0 ELSE dv / dt END * 1e6, 3) + 0.0 AS d FROM (SELECT event_id, ms - lag(ms) OVER w AS dt, value - lag(value) OVER w AS dv FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY ms, value))")
S.op("ts_rate", lambda t: ts.rate(points(t), by=["user_id"]).select("event_id", F.round(F.col("rate") * 1e6, 3).alias("r")), f"SELECT event_id, round(CASE WHEN dt = 0 THEN 0 WHEN dt IS NULL THEN NULL ELSE greatest(dv / dt, 0) END * 1e6, 3) AS r FROM (SELECT event_id, ms - lag(ms) OVER w AS dt, value - lag(value) OVER w AS dv FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY ms, value))")
S.op("ts_histogram", lambda t: ts.histogram(points(t), 25.0, 0.0, 500.0, cumulative=True), f"SELECT CAST(b AS INTEGER) AS bucket, b * 25.0::DOUBLE AS low, (b + 1) * 25.0::DOUBLE AS high, CAST(sum(coalesce(n, 0)) OVER (ORDER BY b) AS BIGINT) AS count FROM range(20) r(b) LEFT JOIN (SELECT least(floor(value / 25.0), 19) AS k, count(*) AS n FROM {E} WHERE value >= 0 GROUP BY 1) ON k = b")
S.op("ts_buckets", lambda t: ts.buckets(points(t), 8).select("bucket", "count", "first_ms", F.round("midpoint", 8).alias("midpoint")), f"WITH m AS (SELECT min(value) AS a, (max(value) - min(value)) / 8 AS w FROM events) SELECT CAST(least(floor((value - a) / w), 7) AS INTEGER) AS bucket, count(*) AS count, min(ms) AS first_ms, round(any_value(a) + (bucket + 0.5) * any_value(w), 8) AS midpoint FROM {E}, m GROUP BY bucket")
for how in ("sum", "min", "max", "count", "first", "last"):
    duck = {"first": "arg_min(value, ms)", "last": "arg_max(value, ms)"}.get(how, f"{how}(value)")
    S.op(f"ts_downsample_{how}", lambda t, how=how: ts.aggregate(points(t), HOUR, how, place="event_id").withColumn("value", F.round("value", 2)), f"SELECT ms - ms % {HOUR} AS bucket, round({duck}, 2) AS value FROM {E} GROUP BY ALL")
S.op("ts_rollup_reaggregate", lambda t: R(ts.merge_states(ts.rollup_state(points(t), HOUR, by=["event_type"]), DAY, ["event_type"]), "sum", "avg").select("event_type", "bucket", "count", "min", "max", "avg"), f"SELECT event_type, ms - ms % {DAY} AS bucket, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 8) AS avg FROM {E} GROUP BY ALL")
S.op("ts_retention", lambda t: ts.retained(points(t), 1_706_000_000_000, 7 * DAY).select("event_id", ts.tier(F.col("ms"), 1_706_000_000_000, DAY, 3 * DAY).alias("tier")), f"SELECT event_id, CASE WHEN 1706000000000 - ms <= {DAY} THEN 'hot' WHEN 1706000000000 - ms <= {3 * DAY} THEN 'warm' ELSE 'cold' END AS tier FROM {E} WHERE ms >= {1_706_000_000_000 - 7 * DAY}")
_TAGS = lambda t: points(t).withColumn("tags", F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string")))
S.op("ts_tag_filter", lambda t: _TAGS(t).where((ts.tag_condition(F.col("tags"), "type", "IN", ["click", "view"]) | ts.tag_condition(F.col("tags"), "user", "REGEX", "^1[0-9]$")) & ts.tag_condition(F.col("tags"), "host", "NOT_EXISTS")).select("event_id"), f"SELECT event_id FROM {E} WHERE event_type IN ('click', 'view') OR regexp_matches(CAST(user_id AS VARCHAR), '^1[0-9]$')")
S.op("ts_top_tags", lambda t: ts.top_tags(_TAGS(t), "tags", "type", 3), f"SELECT event_type AS tag, count(*) AS count FROM {E} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
# Windows
S.op("window_tumbling_filled", lambda t: win.tumbling(points(t), HOUR), f"WITH e AS (SELECT ms - ms % {HOUR} AS w FROM {E}) SELECT s.w AS window_start, s.w + {HOUR} AS window_end, count(e.w) AS value_count FROM (SELECT unnest(generate_series((SELECT min(w) FROM e), (SELECT max(w) FROM e), {HOUR})) AS w) s LEFT JOIN e ON e.w = s.w GROUP BY s.w")
S.op("window_sliding", lambda t: win.sliding(points(t), 6 * HOUR, 2 * HOUR), f"WITH b AS (SELECT min(ms) AS a, max(ms) AS z FROM {E}), s AS (SELECT a + k * {2 * HOUR} AS w FROM b, range(100000) r(k) WHERE k = 0 OR a + k * {2 * HOUR} < z) SELECT w AS window_start, w + {6 * HOUR} AS window_end, (SELECT count(*) FROM {E} e WHERE e.ms >= w AND e.ms < w + {6 * HOUR}) AS value_count FROM s")
S.op("window_session", lambda t: win.session(points(t), HOUR, by=["user_id"]), f"WITH g AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= {HOUR} THEN 0 ELSE 1 END AS n FROM {E}), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ms) AS window_start, max(ms) AS window_end, count(*) AS value_count FROM s GROUP BY user_id, k")
for how in ("avg", "max", "min", "sum", "count"):
    S.op(f"window_aggregate_{how}", lambda t, how=how: R(win.aggregated(points(t), DAY, how), "agg_result"), f"SELECT ms - ms % {DAY} + {DAY} AS window_end, CAST(round({how}(value), 8) AS DOUBLE) AS agg_result FROM {E} GROUP BY ALL")
S.op("window_late_rows", lambda t: win.late(points(t), 1_704_300_000_000).select("event_id"), f"SELECT event_id FROM {E} WHERE ms <= 1704300000000")
S.op("stream_scan_watermark", lambda t: win.after(points(t), 1_704_300_000_000).select("event_id"), f"SELECT event_id FROM {E} WHERE ms > 1704300000000")
S.op("interval_join", lambda t: rel.interval_join(points(t).where("event_type = 'click'").select(F.col("event_id").alias("l"), F.col("ms").alias("lms"), F.col("value").alias("lv")), points(t).where("event_type = 'purchase'").select(F.col("event_id").alias("r"), F.col("ms").alias("rms"), F.col("value").alias("rv")), 60_000, "lms", "rms"), f"SELECT a.event_id AS l, a.ms AS lms, a.value AS lv, b.event_id AS r, b.ms AS rms, b.value AS rv FROM {E} a JOIN {E} b ON a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.ms - b.ms) <= 60000")

QUERIES, ORACLES = S.queries, S.oracles
