"""Streaming / stateful queries (R1-R10): batch forms with oracles, live forms rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import activity as AC
from tidewater.operators.windows import trailing_counts
from tidewater.sources.io import scratch_path
from tidewater.sources.tables import table
from tidewater.streaming import events as ST
from tidewater.streaming import rooms as RM
from tidewater.suite import register
from tidewater.suite.joins_q import _SESS, sessions



@register("stream_event_metrics", """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
  CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users FROM events GROUP BY 1, 2""")
def stream_event_metrics(spark, d):
    out = AC.hourly_windows(table(spark, d, "events"))
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def _landed(spark, d):
    ev = table(spark, d, "events")
    return ST.event_stream(spark, ST.land_events(ev, scratch_path(spark, "events-landing")), ev.schema)


def _closed_windows(spark, d, build):
    """Run a windowed streaming query to its end: the windows that the watermark has closed."""
    out = scratch_path(spark, "stream-out")
    query = build(_landed(spark, d))
    ST.run_to_files(query, out, scratch_path(spark, "stream-ckpt"))
    return spark.read.schema(query.schema).parquet(out)


# windows that end an hour or more before the last event, the watermark's delay
_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@register("stream_event_metrics_live", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, CAST(count(*) AS BIGINT) AS n_events
FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM events) WHERE w + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY 1, 2""")
def stream_event_metrics_live(spark, d):
    """R1 as a real streaming query (watermark + window)."""
    out = _closed_windows(spark, d, ST.live_event_metrics)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n_events")


@register("stream_quota", f"""
SELECT event_id, n_minute, CAST(greatest(0, 30 - n_minute) AS BIGINT) AS remaining_minute,
  CAST(greatest(0, 500 - n_hour) AS BIGINT) AS remaining_hour, CAST(greatest(0, 5000 - n_day) AS BIGINT) AS remaining_day FROM (
  SELECT event_id,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n_minute,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_hour,
    count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n_day
  FROM events)""")
def stream_quota(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = AC.remaining_quota(trailing_counts(ev, ["user_id"], "ts", "event_id"))
    return out.select("event_id", "n_minute", F.col("remaining_minute").cast("long"),
                      F.col("remaining_hour").cast("long"), F.col("remaining_day").cast("long"))


@register("stream_quota_live", f"""
SELECT strftime(w_end, '%Y-%m-%d %H:%M:%S') AS window_end, user_id, CAST(count(*) AS BIGINT) AS n_hour,
  CAST(greatest(0, 500 - count(*)) AS BIGINT) AS remaining_hour
FROM (SELECT user_id, time_bucket(INTERVAL 10 MINUTES, ts) + unnest([10, 20, 30, 40, 50, 60]) * INTERVAL 1 MINUTE AS w_end FROM events)
WHERE w_end <= {_CLOSED} GROUP BY 1, 2""")
def stream_quota_live(spark, d):
    """R2 as a real streaming query: sliding hour windows (every 10 minutes here)."""
    out = _closed_windows(spark, d, lambda s: ST.live_quota(s, slide="10 minutes"))
    return out.select(F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), "user_id", "n_hour", F.col("remaining_hour").cast("long"))


def _limited(per_minute: int, per_hour: int, per_day: int) -> str:
    return f"""
SELECT reason, CAST(count(*) AS BIGINT) AS n, any_value(CASE reason WHEN 'minute_limit' THEN 60 WHEN 'hour_limit' THEN 300 WHEN 'day_limit' THEN 3600 ELSE 0 END) AS wait_seconds FROM (
  SELECT CASE WHEN n_minute > {per_minute} THEN 'minute_limit' WHEN n_hour > {per_hour} THEN 'hour_limit' WHEN n_day > {per_day} THEN 'day_limit' ELSE 'allowed' END AS reason FROM (
    SELECT
      count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n_minute,
      count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n_hour,
      count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS n_day
    FROM events)) GROUP BY reason"""


def _verdicts(spark, d, limits: dict[str, int]):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = AC.limited(trailing_counts(ev, ["user_id"], "ts", "event_id"), limits)
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.first("wait_seconds").alias("wait_seconds"))


@register("stream_rate_limit", _limited(30, 500, 5000))
def stream_rate_limit(spark, d):
    """R3 / R4 by trailing counts: verdicts and cool-downs under the general limits."""
    return _verdicts(spark, d, AC.GENERAL_LIMITS)


@register("stream_rate_limit_strict", _limited(1, 15, 150))
def stream_rate_limit_strict(spark, d):
    """R3 / R4 under the limits of the model calls: many denials."""
    return _verdicts(spark, d, {"minute": 1, "hour": 15, "day": 150})


@register("stream_session_state", """
SELECT conv_id, turn, role, CAST(sum(1) OVER w AS BIGINT) AS version,
  CAST(sum(CASE WHEN turn = first_turn THEN 1 ELSE 0 END) OVER w AS BIGINT) AS participants,
  sum(CASE WHEN turn = first_turn THEN 1 ELSE 0 END) OVER w <= 10 AS within_capacity, 'active' AS status
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS first_turn FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def stream_session_state(spark, d):
    return ST.session_state(table(spark, d, "conversations"))


@register("stream_session_state_live", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS version, CAST(count(DISTINCT role) AS BIGINT) AS participants, count(DISTINCT role) <= 10 AS within_capacity
FROM conversations GROUP BY conv_id""")
def stream_session_state_live(spark, d):
    """R5 as a streaming query over landed conversation files: each room's latest state."""
    conv = table(spark, d, "conversations")
    path, out = scratch_path(spark, "conversations-landing"), scratch_path(spark, "stream-out")
    conv.repartitionByRange(4, "conv_id", "turn").write.mode("overwrite").parquet(path)
    query = ST.room_totals(spark.readStream.schema(conv.schema).option("maxFilesPerTrigger", 2).parquet(path))
    ST.run_to_batches(query, out, scratch_path(spark, "stream-ckpt"))
    changes = spark.read.parquet(out)
    state = F.struct("version", "participants", "within_capacity")
    return changes.groupBy("conv_id").agg(F.max_by(state, "batch").alias("s")).select("conv_id", "s.*")


@register("stream_rooms_live", f"""WITH g AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 86400000000 THEN 1 ELSE 0 END AS cut
  FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS room FROM g),
f AS (SELECT user_id, room, event_type, count(*) AS n, min((ts, event_id)) AS first_seen FROM s GROUP BY user_id, room, event_type),
m AS (SELECT *, row_number() OVER (PARTITION BY user_id, room ORDER BY first_seen) AS place FROM f),
r AS (SELECT user_id, room, least(count(*), 3) AS participants, sum(CASE WHEN place > 3 THEN n ELSE 0 END) AS refused FROM m GROUP BY user_id, room)
SELECT s.user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS opened, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_event,
  CAST(count(*) AS BIGINT) AS version, CAST(any_value(participants) AS BIGINT) AS participants,
  CAST(any_value(refused) AS BIGINT) AS refused, 'active' AS status
FROM s JOIN r ON s.user_id = r.user_id AND s.room = r.room GROUP BY s.user_id, s.room
HAVING max(ts) + INTERVAL 24 HOUR <= {_CLOSED}""")
def stream_rooms_live(spark, d):
    """R5 / R6 live: a room a user with places for three kinds of events, closed after 24 idle hours."""
    ev = table(spark, d, "events")
    path, out = ST.land_events(ev, scratch_path(spark, "events-landing")), scratch_path(spark, "stream-out")
    query = RM.live_rooms(ST.event_stream(spark, path, ev.schema, max_files=1), "user_id", "event_type", "ts", "event_id",
                          capacity=3)
    ST.run_to_files(query, out, scratch_path(spark, "stream-ckpt"))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("opened", "last_event")]
    return spark.read.schema(query.schema).parquet(out).select(
        "user_id", *shown, "version", "participants", "refused", "status")


@register("stream_expiry", f"""WITH {_SESS}
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_event,
  epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) >= 86400000000 AS expired
FROM sess GROUP BY user_id, session_id""")
def stream_expiry(spark, d):
    s = sessions(spark, d)
    last = s.groupBy("user_id", "session_id").agg(F.max("ts").alias("last_ts"))
    as_of = table(spark, d, "events").agg(F.max("ts")).collect()[0][0]
    out = AC.expired_sessions(last, "last_ts", F.lit(as_of))
    return out.select("user_id", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_event"), "expired")


_ROUTES = {"purchase": "billing", "error": "alerts", "signup": "accounts"}


@register("stream_route", """
SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'billing' WHEN event_type = 'error' THEN 'alerts'
  WHEN event_type = 'signup' THEN 'accounts' ELSE 'activity' END AS sink FROM events""")
def stream_route(spark, d):
    return AC.route(table(spark, d, "events"), "event_type", _ROUTES, "activity").select("event_id", "sink")


@register("stream_batches", """
SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 5) AS BIGINT) AS batch_id FROM events""")
def stream_batches(spark, d):
    out = AC.micro_batches(table(spark, d, "events").select("event_id"), "event_id", 5)
    return out.select("event_id", F.col("batch_id").cast("long"))



