"""Access to the driver-provided Parquet tables and the derived ``dirty`` view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give a table no larger than one split a partition per core.

    A row group is read by a single task, which then also runs everything fused
    with the scan; Spark may plan more splits than there are row groups, and those are
    empty. So the size of the files decides: up to ``spark.sql.files.maxPartitionBytes`` (128 MB),
    which bounds this shuffle. Any larger table is read as it is, and so is one of more files than there are cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size <= most else df


def sliced(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """A table dealt so that a task gets about ``most`` bytes of its files, for work that takes much longer than reading. As it is
    read, a task gets up to 128 MB, or a whole row group; its time then grows with the table, and a few tasks end long after the others."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = -(-size // most)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


# The null / duplicate injection rule for the `dirty` view, shared
# with the DuckDB oracle (valid in both engines). It keeps every events row and
# repeats one in ten, so null- and duplicate-handling operators have work.
DIRTY_SELECT = """
WITH base AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7  = 0 THEN NULL ELSE value END AS value,
         CASE WHEN event_id % 3  = 0 THEN NULL ELSE value * value END AS value_sq,
         CASE WHEN event_id % 4  = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS pos_n,
         CASE WHEN event_id % 5 <> 0 THEN NULL ELSE value END AS value_sparse
  FROM events)
SELECT * FROM base
UNION ALL
SELECT * FROM base WHERE event_id % 10 = 0
"""

def dirty_cte() -> str:
    """`WITH base AS (...), dirty AS (...)` prefix for oracle SQL."""
    body = DIRTY_SELECT.strip()
    assert body.startswith("WITH base AS (")
    base_end = body.index("\nSELECT * FROM base\nUNION ALL")
    base = body[:base_end]
    rest = body[base_end:]
    return base + ",\ndirty AS (" + rest + ")\n"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # expressed with the DataFrame API over the events scan so pruning reaches Parquet
    from pyspark.sql import functions as F
    eid = F.col("event_id")
    base = events.select(
        "event_id", "ts", "user_id",
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(eid % 3 == 0, F.lit(None)).otherwise(F.col("value") * F.col("value")).alias("value_sq"),
        F.when(eid % 4 == 0, F.lit(None)).otherwise(eid.cast("double")).alias("pos_n"),
        F.when(eid % 5 != 0, F.lit(None)).otherwise(F.col("value")).alias("value_sparse"),
    )
    return base.unionAll(base.where(eid % 10 == 0))
