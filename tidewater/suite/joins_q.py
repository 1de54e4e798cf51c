"""Join, set-operation and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import activity as AC
from tidewater.operators import joins as J
from tidewater.operators.profile import missing_summary
from tidewater.sources.tables import dirty, table
from tidewater.suite import register
from tidewater.suite.sqlgen import q, r6, with_dirty


@register("join_semi", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def join_semi(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi_join(o, c, "o_custkey")


@register("join_outer_compare", with_dirty(f"""
SELECT coalesce(b.c, a.c) AS {q('column')}, CAST(coalesce(b.m, 0) AS BIGINT) AS before, CAST(coalesce(a.m, 0) AS BIGINT) AS after
FROM (SELECT 'event_id' AS c, count(*) - count(event_id) AS m FROM dirty UNION ALL SELECT 'ts', count(*) - count(ts) FROM dirty
      UNION ALL SELECT 'user_id', count(*) - count(user_id) FROM dirty UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM dirty
      UNION ALL SELECT 'value', count(*) - count(value) FROM dirty UNION ALL SELECT 'value_sq', count(*) - count(value_sq) FROM dirty
      UNION ALL SELECT 'pos_n', count(*) - count(pos_n) FROM dirty UNION ALL SELECT 'value_sparse', count(*) - count(value_sparse) FROM dirty) b
FULL OUTER JOIN
     (SELECT 'event_id' AS c, count(*) - count(event_id) AS m FROM events UNION ALL SELECT 'ts', count(*) - count(ts) FROM events
      UNION ALL SELECT 'user_id', count(*) - count(user_id) FROM events UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM events
      UNION ALL SELECT 'value', count(*) - count(value) FROM events UNION ALL SELECT 'props', count(*) - count(props) FROM events) a
ON b.c = a.c"""))
def join_outer_compare(spark, d):
    b = missing_summary(dirty(spark, d))
    a = missing_summary(table(spark, d, "events"))
    return J.outer_compare(b, a, "column", "missing")


@register("join_fanout", """
SELECT m.conv_id, m.turn, m.role AS sender, r.role AS recipient FROM conversations m
JOIN (SELECT DISTINCT conv_id, role FROM conversations) r ON m.conv_id = r.conv_id AND r.role <> m.role""")
def join_fanout(spark, d):
    c = table(spark, d, "conversations")
    out = J.fan_out(c.select("conv_id", "turn", F.col("role").alias("sender")), c, "conv_id", "sender", "role")
    return out.select("conv_id", "turn", "sender", "recipient")


@register("join_anti", """
SELECT 'part_never_sold' AS kind, p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'unknown_part', l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""")
def join_anti(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    return (J.anti_join(p, li, "key").select(F.lit("part_never_sold").alias("kind"), "key")
            .unionByName(J.anti_join(li, p, "key").select(F.lit("unknown_part").alias("kind"), "key")))


@register("join_fk", f"""
SELECT o_orderkey, c_name, n_name, {r6('o_totalprice')} AS o_totalprice FROM orders
JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def join_fk(spark, d):
    out = J.fk_chain(table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation"))
    return out.select("o_orderkey", "c_name", "n_name", "o_totalprice")


def _populated_sql(cols, tbl):
    return " UNION ALL ".join(f"SELECT '{c}' AS c FROM {tbl} HAVING count({c}) > 0" for c in cols)


_D_COLS = ["event_id", "ts", "user_id", "event_type", "value", "value_sq", "pos_n", "value_sparse"]
_E_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@register("set_column_diff", with_dirty(f"""
, a AS ({_populated_sql(_D_COLS, "dirty")}), b AS ({_populated_sql(_E_COLS, "events")})
SELECT c AS {q('column')}, 'only_left' AS kind FROM (SELECT c FROM a EXCEPT SELECT c FROM b)
UNION ALL SELECT c, 'only_right' FROM (SELECT c FROM b EXCEPT SELECT c FROM a)
UNION ALL SELECT c, 'both' FROM (SELECT c FROM a INTERSECT SELECT c FROM b)""").replace("\n, a AS", ",\na AS", 1))
def set_column_diff(spark, d):
    return J.column_set_diff(dirty(spark, d), table(spark, d, "events"))


@register("set_branch_merge", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS branch,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) - 1 AS BIGINT) AS merged_pos
FROM conversations""")
def set_branch_merge(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    out = J.branch_merge(c.where(F.col("role") == "user"), c.where(F.col("role") != "user"), "conv_id", "turn")
    return out.select("conv_id", "turn", F.col("branch").cast("int").alias("branch"), "merged_pos")


# --- activity ---------------------------------------------------------------
_SESS = """sess AS (
  SELECT *, user_id || '@' || strftime(session_start, '%Y-%m-%dT%H:%M:%S.%f') AS session_id FROM (
    SELECT *, max(CASE WHEN is_start THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start FROM (
      SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
        OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 86400000000) AS is_start
      FROM events)))"""


def sessions(spark, d):
    ev = table(spark, d, "events")
    return AC.sessionize(ev, "user_id", "ts", tiebreak=["event_id"])


@register("stream_session_window", f"""WITH {_SESS}
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_event,
  CAST(count(*) AS BIGINT) AS n_events FROM sess GROUP BY user_id, session_id""")
def stream_session_window(spark, d):
    s = sessions(spark, d)
    return s.groupBy("user_id", "session_id").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_event"),
        F.count(F.lit(1)).alias("n_events")).drop("session_id")


@register("event_type_metrics", f"""WITH {_SESS}
SELECT event_type, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT session_id) AS BIGINT) AS n_sessions,
  CAST(count(DISTINCT user_id) AS BIGINT) AS n_users FROM sess GROUP BY event_type""")
def event_type_metrics(spark, d):
    return AC.event_type_metrics(sessions(spark, d))


@register("event_hourly", """
SELECT event_type, CAST(hour(ts) AS INT) AS hour, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY 1, 2""")
def event_hourly(spark, d):
    return AC.hourly_distribution(table(spark, d, "events"))


@register("session_analytics", f"""WITH {_SESS},
bt AS (SELECT session_id, CAST(to_json(map_from_entries(list_sort(list(struct_pack(k := event_type, v := c))))) AS VARCHAR) AS event_types
  FROM (SELECT session_id, event_type, CAST(count(*) AS BIGINT) AS c FROM sess GROUP BY 1, 2) GROUP BY 1)
SELECT s.session_id, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users,
  {r6('(max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6')} AS duration_seconds, bt.event_types,
  {r6('count(*) / count(DISTINCT user_id)')} AS events_per_user
FROM sess s JOIN bt ON s.session_id = bt.session_id GROUP BY s.session_id, bt.event_types""")
def session_analytics(spark, d):
    return AC.session_analytics(sessions(spark, d))


@register("user_analytics", f"""WITH {_SESS}
SELECT user_id, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT session_id) AS BIGINT) AS n_sessions,
  {r6('count(*) / count(DISTINCT session_id)')} AS events_per_session FROM sess GROUP BY user_id""")
def user_analytics(spark, d):
    return AC.user_analytics(sessions(spark, d))


@register("room_status", """
SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS members, CAST(count(DISTINCT role) AS BIGINT) AS n_members
FROM conversations GROUP BY conv_id""")
def room_status(spark, d):
    return AC.room_status(table(spark, d, "conversations"), "conv_id", "role")
