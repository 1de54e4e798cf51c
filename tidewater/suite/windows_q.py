"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import windows as W
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import r6, with_dirty

def events_positioned(spark, d):
    from tidewater.plans.ordered import time_blocks
    ev = time_blocks(table(spark, d, "events").select("event_id", "ts", "user_id", "value"), ["user_id"], "ts")
    return W.with_positions(ev, ["user_id"], ["ts", "event_id"], F.col("_tblk")).drop("_tblk")


def dirty_positioned(spark, d):
    from tidewater.plans.ordered import value_blocks
    dv = value_blocks(dirty(spark, d).select("event_id", "value"), [], F.col("event_id"))
    return W.with_positions(dv, [], ["event_id"], F.col("_tblk")).drop("_tblk")


@register("win_group_mean", f"""
SELECT o_orderkey, {r6('avg(o_totalprice) OVER (PARTITION BY o_orderpriority)')} AS group_mean FROM orders""")
def win_group_mean(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return W.group_mean(o, "o_orderpriority", "o_totalprice", "group_mean").select("o_orderkey", "group_mean")


_MOV = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@register("win_moving_avg", f"""
SELECT event_id, {r6(f'CASE WHEN count(value) OVER {_MOV} = 20 THEN avg(value) OVER {_MOV} END')} AS moving_avg
FROM events""")
def win_moving_avg(spark, d):
    return W.moving_stats(events_positioned(spark, d), ["user_id"], "value", 20).select("event_id", "moving_avg")


@register("win_moving_std", f"""
SELECT event_id, {r6(f'CASE WHEN count(value) OVER {_MOV} = 20 THEN stddev_samp(value) OVER {_MOV} END')} AS moving_std
FROM events""")
def win_moving_std(spark, d):
    return W.moving_stats(events_positioned(spark, d), ["user_id"], "value", 20).select("event_id", "moving_std")


_UP = "(ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DOWN = "(ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("win_ffill", with_dirty(f"""
SELECT event_id, {r6(f'last_value(value IGNORE NULLS) OVER {_UP}')} AS value_ffill FROM dirty"""))
def win_ffill(spark, d):
    return W.ffill(dirty_positioned(spark, d), [], "value").select("event_id", "value_ffill")


@register("win_bfill", with_dirty(f"""
SELECT event_id, {r6(f'first_value(value IGNORE NULLS) OVER {_DOWN}')} AS value_bfill FROM dirty"""))
def win_bfill(spark, d):
    return W.bfill(dirty_positioned(spark, d), [], "value").select("event_id", "value_bfill")


_P_UP = "(ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_P_DOWN = "(ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("win_interpolate", with_dirty(f"""
SELECT event_id, {r6('''CASE WHEN value IS NOT NULL THEN value
  WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (p - pp) / (np - pp)
  WHEN pp IS NOT NULL THEN pv END''')} AS value_interp
FROM (SELECT event_id, value, p,
  last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER {_P_UP} AS pp,
  last_value(value IGNORE NULLS) OVER {_P_UP} AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER {_P_DOWN} AS np,
  first_value(value IGNORE NULLS) OVER {_P_DOWN} AS nv
  FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM dirty))"""))
def win_interpolate(spark, d):
    return W.interpolate(dirty_positioned(spark, d), [], "value").select("event_id", "value_interp")


@register("win_null_blocks", with_dirty("""
SELECT CAST(min(p) AS BIGINT) AS start, CAST(max(p) AS BIGINT) AS "end", CAST(count(*) AS BIGINT) AS length
FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS island FROM
  (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS p FROM dirty) WHERE value IS NULL)
GROUP BY island"""))
def win_null_blocks(spark, d):
    return W.null_blocks(dirty_positioned(spark, d), [], "value")


_LAG = "(PARTITION BY user_id ORDER BY ts, event_id)"


@register("win_lag_sequences", f"""
SELECT event_id, {r6('lag_1')} AS lag_1, {r6('lag_2')} AS lag_2, {r6('lag_3')} AS lag_3, {r6('value')} AS value FROM (
  SELECT event_id, value, lag(value, 1) OVER {_LAG} AS lag_1, lag(value, 2) OVER {_LAG} AS lag_2,
    lag(value, 3) OVER {_LAG} AS lag_3 FROM events)
WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL AND value IS NOT NULL""")
def win_lag_sequences(spark, d):
    out = W.lag_sequences(events_positioned(spark, d), ["user_id"], "value", 3)
    return out.select("event_id", "lag_1", "lag_2", "lag_3", "value")


def conversations_positioned(spark, d):
    c = table(spark, d, "conversations")
    return W.with_positions(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024))


@register("win_parent_version", """
SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_turn FROM conversations""")
def win_parent_version(spark, d):
    out = W.previous_value(conversations_positioned(spark, d), ["conv_id"], "turn", "parent_turn")
    return out.select("conv_id", "turn", "parent_turn")


@register("win_version_number", """
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS version FROM conversations""")
def win_version_number(spark, d):
    out = conversations_positioned(spark, d)
    return out.select("conv_id", "turn", (F.col("_pos") + 1).alias("version"))


@register("win_latest", """
SELECT conv_id, turn, role, CAST(length(text) AS INT) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def win_latest(spark, d):
    c = table(spark, d, "conversations").withColumn("n_chars", F.length("text"))
    return W.latest_per_key(c, ["conv_id"], "turn", ["role", "n_chars"])


def _rate(sec: int) -> str:
    return (f"CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {sec} SECONDS PRECEDING "
            f"AND CURRENT ROW) AS BIGINT)")


@register("win_rate_counts", f"""
SELECT event_id, {_rate(60)} AS n_minute, {_rate(3600)} AS n_hour, {_rate(86400)} AS n_day FROM events""")
def win_rate_counts(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    return W.trailing_counts(ev, ["user_id"], "ts", "event_id").select("event_id", "n_minute", "n_hour", "n_day")
