"""Sources and sinks.

Readers are ``spark.read`` with the options the reference relies on (header,
schema inference, quote escaping); writers are ``DataFrame.write``. Scratch
and catalog output goes under the cluster's shared folder: the value of
``spark.checkpoint.dir`` (set by the platform; tests fall back to a private
folder).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import ensure_checkpoint_dir

# File types accepted by the loader (extension -> reader format).
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".parquet": "parquet"}


def shared_path(spark: SparkSession, *parts: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "tidewater", *parts])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder per call under the shared folder."""
    return shared_path(spark, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def detect_format(path: str) -> str:
    """Format from the extension; anything else is refused."""
    low = path.lower().rstrip("/")
    for ext, fmt in FORMATS.items():
        if low.endswith(ext):
            return fmt
    raise ValueError(f"unsupported file type: {path!r} (allowed: {', '.join(FORMATS)})")


def read(spark: SparkSession, path: str, fmt: str | None = None, encoding: str = "UTF-8",
         schema=None, infer: bool = True) -> DataFrame:
    """Csv / tsv (header, inferred types, '"' escaping), json lines, parquet."""
    fmt = fmt or detect_format(path)
    if fmt in ("csv", "tsv"):
        r = (spark.read.option("header", True).option("escape", '"').option("encoding", encoding)
             .option("sep", "\t" if fmt == "tsv" else ","))
        r = r.schema(schema) if schema is not None else r.option("inferSchema", infer)
        return r.csv(path)
    if fmt == "json":
        return spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def load(spark: SparkSession, source, fmt: str | None = None, **kw) -> DataFrame:
    """An existing DataFrame is returned as is; a path is read by format."""
    if isinstance(source, DataFrame):
        return source
    return read(spark, source, fmt, **kw)


def write(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite",
          encoding: str = "UTF-8") -> str:
    """K1-K4: csv / tsv (header, no index), json lines (ISO timestamps), parquet."""
    fmt = fmt or detect_format(path)
    w = df.write.mode(mode)
    if fmt in ("csv", "tsv"):
        w.option("header", True).option("escape", '"').option("encoding", encoding) \
            .option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    elif fmt == "json":
        w.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def sql(spark: SparkSession, query: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Parameterised SQL; DataFrames are passed by name (``{orders}`` in the text)."""
    return spark.sql(query, args=args or {}, **frames)


# --- K5: workbook content as three tables --------------------------------------------

def export_summary(df: DataFrame) -> dict[str, DataFrame]:
    """'data' (the table), 'summary' (rows, columns, missing cells) and 'types'
    (per column dtype, non-null and null counts)."""
    n_cols = len(df.columns)
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(c).alias(f"{c}__nn") for c in df.columns]
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    structs = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                        F.col(f"`{c}__nn`").cast("long").alias("non_null"),
                        (F.col("__rows") - F.col(f"`{c}__nn`")).cast("long").alias("nulls")) for c in df.columns]
    per_col = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    missing = sum((F.col(f"`{c}__nn`") for c in df.columns), F.lit(0))
    summary = wide.select(F.col("__rows").cast("long").alias("rows"), F.lit(n_cols).cast("long").alias("columns"),
                          (F.col("__rows") * n_cols - missing).cast("long").alias("missing_cells"))
    return {"data": df, "summary": summary, "types": per_col}


# --- K6 / K7 / K11: export log, batch export, retention ----------------------------------

LOG_SCHEMA = "exported_at timestamp, export_type string, path string, format string, n_rows long"


def log_export(spark: SparkSession, log_path: str, export_type: str, path: str, fmt: str, n_rows: int) -> None:
    """K6: append one row to the export log table."""
    row = [(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), export_type, path, fmt, int(n_rows))]
    spark.createDataFrame(row, LOG_SCHEMA).write.mode("append").parquet(log_path)


def batch_export(spark: SparkSession, items: Iterable[tuple[str, DataFrame]], fmt: str = "parquet",
                 base: str | None = None) -> DataFrame:
    """K7: write each named DataFrame; a failure is reported and the batch goes on."""
    base = base or scratch_path(spark, "batch")
    rows = []
    for name, df in items:
        path = f"{base}/{name}.{fmt}"
        try:
            write(df, path, fmt)
            rows.append((name, True, path, None))
        except Exception as e:  # noqa: BLE001 - reported as a row
            rows.append((name, False, path, f"{type(e).__name__}: {e}"[:200]))
    return spark.createDataFrame(rows, "name string, ok boolean, path string, error string")


def expired_exports(log: DataFrame, as_of, days: int = 7, ts: str = "exported_at") -> DataFrame:
    """Rows of the export log older than ``days`` before ``as_of`` (no deletion)."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return log.where(F.col(ts).cast("timestamp") < cutoff)


# --- K9 / K10 / S8: catalog ----------------------------------------------------------------

def insert_new(table: DataFrame, rows: DataFrame, key: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is not yet in the table are inserted; the others are
    refused. Returns (new table, refused rows)."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = rows.join(table.select(*keys), keys, "left_anti")
    refused = rows.join(table.select(*keys), keys, "left_semi")
    return table.unionByName(fresh), refused


def save_dataset(spark: SparkSession, df: DataFrame, name: str, project_id: str) -> str:
    """K9: save the dataset as a table of the session's catalog, with its project as a table property. Returns the table's name."""
    ident = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").saveAsTable(ident)
    spark.sql(f"ALTER TABLE {ident} SET TBLPROPERTIES ('project_id' = '{project_id}', 'dataset' = '{name}')")
    return ident


def dataset_row(spark: SparkSession, ident: str) -> DataFrame:
    """K9: what the catalog tells of a dataset: name, project, rows, columns."""
    t = spark.table(ident)
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {ident}").collect()}
    return t.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(props["dataset"]).alias("name"), F.lit(props["project_id"]).alias("project_id"), "rows", F.lit(len(t.columns)).alias("columns"))


def load_dataset(spark: SparkSession, ident: str) -> DataFrame:
    """A dataset by its id, from the session's catalog."""
    return spark.table(ident)


# --- K12: report by template ------------------------------------------------------------------

REPORT_TEMPLATE = ["overview", "quality", "missing_values", "correlations", "recommendations"]
DEFAULT_TEXT = "No data available for this section."


def report_sections(spark: SparkSession, available: DataFrame, template: Sequence[str] = tuple(REPORT_TEMPLATE),
                    default: str = DEFAULT_TEXT) -> DataFrame:
    """Ordered template sections left-joined to the available (section, content)
    results; empty sections get the default text."""
    tmpl = spark.createDataFrame([(i + 1, s) for i, s in enumerate(template)], "position int, section string")
    return tmpl.join(available, "section", "left").select(
        "position", "section", F.coalesce("content", F.lit(default)).alias("content"))
