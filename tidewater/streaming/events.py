"""Structured Streaming forms of the activity operators.

The same logic exists as a batch function (for checking against SQL) and as a
streaming query over a directory of event files: watermarked windows for the
metrics and quotas, streaming aggregates for session state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.activity import GENERAL_LIMITS


def land_events(events: DataFrame, path: str, files: int = 8) -> str:
    """Write the events table as time-ranged files (a directory a stream can watch).

    The file source takes files by modification time, so the ranges are written one
    after another. Files that land in another order need a watermark as long as the
    longest delay: rows that come later than that are dropped as late."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = events.withColumn("__at", at.cast("double"))
    cuts = sorted(set(timed.approxQuantile("__at", [i / files for i in range(1, files)], 0.001))) if files > 1 else []
    mode = "overwrite"
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = timed if low is None else timed.where(F.col("__at") > low)
        if high is not None:
            part = part.where((F.col("__at") <= high) | (F.lit(low is None) & F.col("__at").isNull()))
        part.drop("__at").repartition(1).sortWithinPartitions("ts", "event_id").write.mode(mode).parquet(path)
        mode = "append"
    return path


def event_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def live_event_metrics(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Per hour and type, events and (approximate) distinct users, with a watermark."""
    return (stream.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"), F.approx_count_distinct("user_id").alias("n_users"))
            .select(F.col("w.start").alias("window_start"), "event_type", "n_events", "n_users"))


def live_quota(stream: DataFrame, limit_per_hour: int = GENERAL_LIMITS["hour"], slide: str = "1 minute") -> DataFrame:
    """Sliding one-hour windows (every ``slide``) per user with the quota left."""
    return (stream.withWatermark("ts", "1 hour")
            .groupBy(F.window("ts", "1 hour", slide).alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("n_hour"))
            .select(F.col("w.end").alias("window_end"), "user_id", "n_hour",
                    F.greatest(F.lit(0), F.lit(limit_per_hour) - F.col("n_hour")).alias("remaining_hour")))


# --- R5: session state fold (batch form) ---------------------------------------------------

def session_state(turns: DataFrame, room: str = "conv_id", member: str = "role", order: str = "turn",
                  capacity: int = 10) -> DataFrame:
    """R5 batch form: per event, the room's version (running count), participants so
    far (distinct members seen), whether capacity holds, and the comment count.
    Built from first-appearance flags and block prefix sums (no per-room collect)."""
    from tidewater.plans.ordered import prefix_sums
    first = turns.groupBy(room, member).agg(F.min(order).alias("_first"))
    flagged = turns.join(first, [room, member]).withColumn(
        "_new", (F.col(order) == F.col("_first")).cast("long")).withColumn("_one", F.lit(1).cast("long"))
    cum = prefix_sums(flagged, [room], [order], F.floor(F.col(order) / 4096), ["_new", "_one"])
    return cum.select(room, order, member, F.col("_one_cum").alias("version"),
                      F.col("_new_cum").alias("participants"),
                      (F.col("_new_cum") <= capacity).alias("within_capacity"),
                      F.lit("active").alias("status"))


# --- R6 / R8 / R9 batch forms ----------------------------------------------------------------

def route_stream(stream: DataFrame, routes: dict[str, str], base_path: str, checkpoint: str,
                 default: str = "other"):
    """R8 streaming form: each micro-batch is split by sink into a folder of its own
    number, so a batch that runs again replaces what it wrote."""
    from tidewater.operators.activity import route

    def write_batch(batch: DataFrame, number: int) -> None:
        routed = route(batch, "event_type", routes, default)
        routed.write.mode("overwrite").partitionBy("sink").parquet(f"{base_path}/batch={number}")
    return stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)


def room_totals(turns: DataFrame, capacity: int = 10) -> DataFrame:
    """R5 streaming form: per room the number of changes, the members seen and whether
    capacity holds. A plain streaming aggregate: its state is one row per room with
    the room's members (rooms hold ``capacity`` of them)."""
    return (turns.groupBy("conv_id")
            .agg(F.count(F.lit(1)).alias("version"), F.size(F.collect_set("role")).cast("long").alias("participants"))
            .withColumn("within_capacity", F.col("participants") <= capacity))


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a windowed query over all input there is now; closed windows are appended as Parquet."""
    (stream.writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_to_batches(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run an aggregate in update mode; each micro-batch writes a folder of its own
    number, so a batch that runs again replaces what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    (stream.writeStream.outputMode("update").foreachBatch(write)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
