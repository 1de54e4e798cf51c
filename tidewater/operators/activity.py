"""Activity-event metrics and sessions (A35-A39; batch forms of R1, R2, R6, R7, R9, R10).

Sessions follow the state expiry rule: a user's session ends after 24 h of
inactivity, so a gap of >= 24 h starts a new session. Session starts are found
with the skew-safe ordered helpers (positions -> previous timestamp -> carried
session start), so one very active user is still processed in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.ordered import POS, add_positions, carry_last, rows_frame

SESSION_GAP_SECONDS = 24 * 3600


def sessionize(df: DataFrame, user: str, ts: str, gap_seconds: int = SESSION_GAP_SECONDS,
               tiebreak: Sequence[str] = (), target_rows: int = 1_000_000) -> DataFrame:
    """Adds ``session_start`` (timestamp of the session's first event) and
    ``session_id`` = user + start. A gap >= ``gap_seconds`` opens a new session."""
    from tidewater.plans.ordered import time_blocks
    t = F.col(ts).cast("timestamp")
    blocked = time_blocks(df, [user], ts, target_rows)
    pos = add_positions(blocked, [user], [ts, *tiebreak], F.col("_tblk")).drop("_tblk")
    prev = rows_frame(pos, [user], 2, lambda _f, o: {"_prev_ts": F.lag(ts, 1).over(o)})
    gap = F.unix_micros(t) - F.unix_micros(F.col("_prev_ts").cast("timestamp"))
    flagged = prev.withColumn("_start", F.when(F.col("_prev_ts").isNull() | (gap >= gap_seconds * 1_000_000),
                                               F.col(ts)))
    out = carry_last(flagged, [user], "_start", "session_start")
    return (out.withColumn("session_id", F.concat_ws("@", F.col(user).cast("string"),
                                                     F.date_format("session_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
            .drop("_prev_ts", "_start", POS))


def event_type_metrics(events: DataFrame, type_col: str = "event_type", user: str = "user_id",
                       session: str = "session_id") -> DataFrame:
    """Per type: events, distinct sessions, distinct users (exact)."""
    return events.groupBy(type_col).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct(session).alias("n_sessions"),
        F.count_distinct(user).alias("n_users"))


def hourly_distribution(events: DataFrame, ts: str = "ts", type_col: str = "event_type") -> DataFrame:
    """A36."""
    return events.groupBy(type_col, F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n_events"))


def session_analytics(events: DataFrame, session: str = "session_id", user: str = "user_id",
                      ts: str = "ts", type_col: str = "event_type") -> DataFrame:
    """Events, users, per-type counts (JSON map, keys sorted), duration in
    seconds, events per user. Two grouped aggregates, both map-side combined; the
    (sessionised) input is materialised once since both read it."""
    from tidewater.session import cut_lineage
    events = cut_lineage(events.select(session, user, ts, type_col))
    by_type = (events.groupBy(session, type_col).agg(F.count(F.lit(1)).alias("_c"))
               .groupBy(session).agg(F.to_json(F.map_from_entries(F.array_sort(
                   F.collect_list(F.struct(F.col(type_col), F.col("_c")))))).alias("event_types")))
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    base = events.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct(user).alias("n_users"),
        ((F.max(t) - F.min(t)) / 1e6).alias("duration_seconds"))
    return (base.join(by_type, session)
            .withColumn("events_per_user", F.col("n_events") / F.col("n_users")))


def user_analytics(events: DataFrame, user: str = "user_id", session: str = "session_id") -> DataFrame:
    """Events, sessions and average events per session for each user."""
    return events.groupBy(user).agg(F.count(F.lit(1)).alias("n_events"),
                                    F.count_distinct(session).alias("n_sessions")) \
        .withColumn("events_per_session", F.col("n_events") / F.col("n_sessions"))


def room_status(members: DataFrame, room: str, member: str) -> DataFrame:
    """Sorted distinct members and their count per room (distinct first, so
    the per-room list holds each member once)."""
    d = members.select(room, member).distinct()
    return d.groupBy(room).agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("members"),
                               F.count(F.lit(1)).alias("n_members"))


def hourly_windows(events: DataFrame, ts: str = "ts", type_col: str = "event_type",
                   user: str = "user_id") -> DataFrame:
    """R1 batch form: tumbling 1-hour windows per type with event and user counts."""
    w = F.window(F.col(ts).cast("timestamp"), "1 hour")
    return events.groupBy(w.alias("w"), type_col).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct(user).alias("n_users")) \
        .select(F.col("w.start").alias("window_start"), type_col, "n_events", "n_users")


# The general request limits (per minute / hour / day).
GENERAL_LIMITS = {"minute": 30, "hour": 500, "day": 5000}


def remaining_quota(counts: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """remaining = max(0, limit - count) for each trailing window."""
    limits = limits or GENERAL_LIMITS
    return counts.select("*", *[F.greatest(F.lit(0), F.lit(lim) - F.col(f"n_{k}")).alias(f"remaining_{k}")
                                for k, lim in limits.items()])


def micro_batches(df: DataFrame, key: str, size: int = 5, target_rows: int = 1_000_000) -> DataFrame:
    """R9 batch form: batch id = floor(position / size) along ``key`` (global order,
    block-prefix positions with data-sized blocks, so no single-task window)."""
    from tidewater.plans.ordered import value_blocks
    blocked = value_blocks(df, [], F.col(key), target_rows)
    pos = add_positions(blocked, [], [key], F.col("_tblk"), "_p").drop("_tblk")
    return pos.withColumn("batch_id", F.floor(F.col("_p") / size)).drop("_p")


def route(events: DataFrame, type_col: str, routes: dict[str, str], default: str = "other") -> DataFrame:
    """R8 batch form: the sink each message goes to, by type."""
    expr = None
    for t, sink in routes.items():
        expr = (F.when(F.col(type_col) == t, sink) if expr is None else expr.when(F.col(type_col) == t, sink))
    return events.withColumn("sink", expr.otherwise(default) if expr is not None else F.lit(default))


def expired_sessions(sessions: DataFrame, last_ts: str, as_of: F.Column, ttl_seconds: int = SESSION_GAP_SECONDS):
    """R6 batch form: sessions whose last activity is at least ``ttl`` before ``as_of``."""
    gap = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(last_ts).cast("timestamp"))
    return sessions.withColumn("expired", gap >= ttl_seconds * 1_000_000)


#: Seconds to wait after a limit is hit.
COOL_DOWN = {"minute": 60, "hour": 300, "day": 3600}


def limited(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """A request is denied when it exceeds a limit on the requests of the
    trailing minute, hour or day (denied ones count, too); ``wait_seconds`` is the
    cool-down of the first limit that it exceeds. Window counts in, expressions only."""
    reason, wait = F, F
    for span in ("minute", "hour", "day"):
        over = F.col(f"n_{span}") > limits[span]
        reason, wait = reason.when(over, f"{span}_limit"), wait.when(over, COOL_DOWN[span])
    return counts.select("*", reason.otherwise("allowed").alias("reason"), wait.otherwise(0).alias("wait_seconds"))
