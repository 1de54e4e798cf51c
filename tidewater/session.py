"""Session construction and cluster-safe helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every operator relies on: UTC so timestamp arithmetic matches the
# oracle, AQE for runtime coalescing / skew-join splitting, LAST_WIN so map
# merges behave like a dict update.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # wide fused profiling aggregates (dozens of moments / correlations in one
    # pass) keep whole-stage codegen instead of falling back to interpretation
    "spark.sql.codegen.maxFields": "1000",
}

#: Spark's setting to remove a query's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tidewater", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, conf[k])
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share.

    It is read from ``spark.checkpoint.dir``. Where that is unset, a local-mode
    session (tests) gets a private folder of its own; on a cluster the executors
    could not see such a folder, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and current.isDefined():
        configured = current.get()
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not current.isDefined():
        sc.setCheckpointDir(configured)
    return configured


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable; see ``shared_dir``."""
    shared_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str, compression: str = "snappy", rows: int | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The copy survives lost executors, is columnar and compressed, and every
    later reader sees the same rows. Each call writes to a new path. Where a
    bound of its rows is known, ``rows`` keeps small tables from being written
    as one tiny file for each shuffle partition. ``tidy`` has the shuffle files of this write removed when
    it has ended, for rounds that would otherwise leave theirs until the driver collects garbage; ``drop_staged``
    removes the copy itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidewater/{uuid.uuid4().hex}/{label}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // 100_000))
    before = spark.conf.get(TIDY)
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*copies: DataFrame) -> None:
    """Remove copies made by ``staged`` that nothing reads any more."""
    for df in copies:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def ship_package(spark: SparkSession) -> None:
    """Give every executor this package, once per Spark application, so that
    functions run in Python workers can import it whatever their path is."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewater_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidewater-zip-")  # read by the driver only, which serves it to executors
    path = os.path.join(folder, "tidewater.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("tidewater", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tidewater_shipped = True
