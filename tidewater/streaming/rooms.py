"""Live rooms with expiry (R5, R6), closed by an event-time timer.

Rooms are dealt to buckets by their hash, and a bucket is one state: a call for each room of a
micro-batch took far longer than the rows. Rows are held in their room's state until the watermark has passed
them and are then folded in event-time order, so that rows which arrive out of order, by no more than
the watermark's delay, give what a batch job over sorted rows gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The rooms of a bucket side by side, and the rows they hold, each with its room's place.
STATE = ("room array<string>, opened array<long>, last array<long>, version array<long>, refused array<long>, members array<array<string>>, "
         "place array<int>, at array<long>, tie array<long>, member array<string>, leaves array<boolean>")
CLOSED = "opened timestamp, last_event timestamp, version long, participants long, refused long, status string"


def _as_text(room: str, kind: str) -> Column:
    """A room as text: in pandas, whole numbers with a null among them become floats."""
    c = F.col(room)
    if kind in ("float", "double"):
        c = F.when(c == 0, F.lit(0).cast(kind)).otherwise(c)  # as a key, -0.0 is 0.0
    if kind == "timestamp":
        return F.unix_micros(c).cast("string")
    return F.hex(c) if kind == "binary" else F.to_json(F.struct(c.alias("v"))) if "<" in kind else c.cast("string")


def _from_text(c: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.timestamp_micros(c.cast("long"))
    return F.unhex(c) if kind == "binary" else F.from_json(c, f"v {kind}")["v"] if "<" in kind else c.cast(kind)


def fold(room: list | None, rows, capacity: int, idle: int) -> tuple[list | None, list[list]]:
    """Fold ordered (at, tie, member, leaves) rows, in microseconds, into a room
    [opened, last, version, refused, members]. Returns the room and those closed on the way."""
    closed = []
    for at, _, member, leaves in rows:
        if room is not None and at - room[1] >= idle:
            closed.append(room)
            room = None
        if room is None:
            room = [at, at, 0, 0, []]
        room[1] = at
        room[2] += 1
        members = room[4]
        if leaves:
            if member in members:
                members.remove(member)
        elif member not in members:
            if len(members) < capacity:
                members.append(member)
            else:
                room[3] += 1
    return room, closed


def _frame(closed: list[tuple], names: list[str]) -> pd.DataFrame:
    opened, last = (pd.to_datetime([c[i] for _, c in closed], unit="us") for i in (0, 1))
    rest = [(c[2], len(c[4]), c[3], "active" if c[4] else "inactive") for _, c in closed]
    return pd.DataFrame(dict(zip(names, [[r for r, _ in closed], opened, last, *zip(*rest)])))


def live_rooms(stream: DataFrame, room: str, member: str, at: str, tie: str, leaves: str | None = None,
               capacity: int = 10, idle_hours: float = 24, delay: str = "1 hour", buckets: int = 128) -> DataFrame:
    """The life of each room, one row once it has been idle for ``idle_hours``.

    ``version`` counts the room's changes, ``participants`` those inside at the end (at
    most ``capacity``), ``refused`` the changes by members who found it full; ``status``
    is inactive if all have left. ``leaves`` names a boolean column (null: stays).
    A later row of the same key opens a new room. Ties of ``at`` go by ``tie`` (an
    integer, null as -1). Rows without a time belong to no room; rows without room or member
    are those of the null room and the null member. Rows that come later than
    ``delay`` are left out, as Spark's watermark has it. The state of a room is its
    members, ``capacity`` at most, and its rows of the last ``delay``. A bucket of rooms is
    one state, read and written in each micro-batch: limit the rows of one (``maxFilesPerTrigger``)
    in a replay, and take more ``buckets`` for more cores or many millions of open rooms.
    """
    idle = int(idle_hours * 3_600_000_000)
    key_type = dict(stream.dtypes)[room]
    rows = (stream.withWatermark(at, delay).where(F.col(at).isNotNull())
            .select(_as_text(room, key_type).alias("__room"), F.col(at), F.unix_micros(at).alias("__at"), F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("__tie"),
                    F.col(member).cast("string").alias("__member"),
                    (F.coalesce(F.col(leaves), F.lit(False)) if leaves else F.lit(False)).alias("__leaves"))
            .withColumn("__bucket", F.pmod(F.xxhash64("__room"), F.lit(buckets)).cast("int")))
    names = [room, "opened", "last_event", "version", "participants", "refused", "status"]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rooms: dict = {}  # name -> [room or None, rows held]
        if state.exists:
            ids, opened, last, version, refused, members, place, *kept = state.get
            for r, *now, inside in zip(ids, opened, last, version, refused, members):
                rooms[r] = [[*now, list(inside)] if now[2] else None, []]
            for p, *row in zip(place, *kept):
                rooms[ids[p]][1].append(tuple(row))
        if not state.hasTimedOut:
            for f in frames:
                texts = ([None if pd.isna(x) else x for x in f[c]] for c in ("__room", "__member"))
                for r, m, a, t, out in zip(*texts, f["__at"].tolist(), f["__tie"].tolist(), f["__leaves"].tolist()):
                    rooms.setdefault(r, [None, []])[1].append((a, t, m, out))
        passed, done, wake, left, held_rows = state.getCurrentWatermarkMs() * 1000, [], [], [], []
        for r, (now, held) in rooms.items():
            held.sort(key=lambda x: x[:2])
            cut = sum(1 for x in held if x[0] <= passed)
            now, closed = fold(now, held[:cut], capacity, idle)
            held = held[cut:]
            if now is not None and now[1] + idle <= passed:
                closed.append(now)
                now = None
            done += [(r, c) for c in closed]
            if now is not None or held:
                wake += ([held[0][0]] if held else []) + ([now[1] + idle] if now else [])
                held_rows += [(len(left), *x) for x in held]
                left.append((r, *(now or [0, 0, 0, 0, []])))
        if left:
            state.update((*map(list, zip(*left)), *(map(list, zip(*held_rows)) if held_rows else [[]] * 5)))
            state.setTimeoutTimestamp(max(-(-min(wake) // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if done:
            yield _frame(done, names)

    out = rows.groupBy("__bucket").applyInPandasWithState(
        step, f"`{room}` string, {CLOSED}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(_from_text(F.col(f"`{room}`"), key_type).alias(room), *names[1:])
