"""Streaming forms vs batch forms."""

from pyspark.sql import functions as F

from tidewater.streaming import events as ST


def test_live_metrics_equal_batch_for_closed_windows(spark, tmp_path):
    from tidewater.operators.activity import hourly_windows
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = ST.land_events(ev, str(tmp_path / "landing"), files=3)
    out = str(tmp_path / "out")
    ST.run_to_files(ST.live_event_metrics(ST.event_stream(spark, path, ev.schema, max_files=1)), out, str(tmp_path / "ckpt"))
    live = spark.read.parquet(out).select("window_start", "event_type", "n_events").toPandas()
    batch = hourly_windows(ev).select("window_start", "event_type", "n_events").toPandas()
    last = ev.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    batch = batch[batch.window_start <= last - __import__("datetime").timedelta(hours=2)]
    key = ["window_start", "event_type"]
    assert len(batch) and live.sort_values(key).reset_index(drop=True).equals(batch.sort_values(key).reset_index(drop=True))


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = ST.land_events(ev, str(tmp_path / "landing"), files=2)
    for attempt in range(2):  # the second run knows nothing of the first one
        ST.route_stream(ST.event_stream(spark, path, ev.schema), {"purchase": "billing"}, str(tmp_path / "out"),
                        str(tmp_path / f"ckpt{attempt}")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == ev.count()


def _rooms(spark, tmp_path, batches, **kw):
    from tidewater.streaming.rooms import live_rooms
    schema = "room string, who string, at timestamp, id long, out boolean"
    path = str(tmp_path / "rooms")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "closed")
    q = live_rooms(stream, "room", "who", "at", "id", "out", **kw)
    ST.run_to_files(q, out, str(tmp_path / "ckpt-rooms"))
    return sorted(tuple(r) for r in spark.read.schema(q.schema).parquet(out).collect())


def test_rooms_expire_and_hold_their_capacity(spark, tmp_path):
    from datetime import datetime as D
    day = lambda d, h, m=0: D(2024, 1, d, h, m)
    got = _rooms(spark, tmp_path, [
        [("a", "x", day(1, 9), 1, None), ("a", "z", day(1, 9, 40), 4, False), ("b", "x", day(1, 9), 2, False), ("a", None, None, 9, None)],
        # rows that come late, but not later than the delay, go before z
        [("a", "y", day(1, 9, 20), 3, False), ("b", "x", day(1, 9, 30), 5, True), ("a", "z", day(1, 9, 45), 6, None)],
        [("a", "z", day(3, 9), 7, False), ("c", None, day(3, 9), 8, False)],
        [("c", "late", day(9, 9), 10, False)]], capacity=2)
    assert got == [
        ("a", day(1, 9), day(1, 9, 45), 4, 2, 2, "active"),
        ("a", day(3, 9), day(3, 9), 1, 1, 0, "active"),
        ("b", day(1, 9), day(1, 9, 30), 2, 0, 0, "inactive"),
        ("c", day(3, 9), day(3, 9), 1, 1, 0, "active")]


def test_rooms_of_an_empty_stream(spark, tmp_path):
    assert _rooms(spark, tmp_path, [[]]) == []


def test_rooms_share_the_state_of_a_bucket(spark, tmp_path):
    """A state a room took one call for each room of a micro-batch."""
    from datetime import datetime as D

    from tidewater.streaming.rooms import live_rooms
    schema, path, big = "room long, who string, at timestamp, id long", str(tmp_path / "landing"), 2 ** 60 + 1
    for d, n in ((1, 3), (3, 1), (5, 2), (20, 1)):
        rows = [(r, w, D(2024, 1, d, 9, i), i) for r in (big, big + 1, None) for i, w in enumerate("xyz"[:n])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    q = live_rooms(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "room", "who", "at", "id", capacity=2, buckets=1)
    ST.run_to_files(q, str(tmp_path / "closed"), str(tmp_path / "ckpt"))
    got = {tuple(r) for r in spark.read.schema(q.schema).parquet(str(tmp_path / "closed")).collect()}
    assert got == {(r, *x, "active") for r in (big, big + 1, None) for x in (
        (D(2024, 1, 1, 9), D(2024, 1, 1, 9, 2), 3, 2, 1), (D(2024, 1, 3, 9), D(2024, 1, 3, 9), 1, 1, 0), (D(2024, 1, 5, 9), D(2024, 1, 5, 9, 1), 2, 2, 0))}
