"""Window operators (W1-W12) built on the skew-safe helpers in ``plans.ordered``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.ordered import POS, add_positions, carry_last, carry_next, rows_frame


def group_mean(df: DataFrame, by: str, col: str, out: str | None = None) -> DataFrame:
    """``transform('mean')`` - grouped aggregate (map-side combined, so a hot
    group costs nothing extra) joined back on the group key; the aggregate has
    one row per group, so the join is broadcast when AQE sees it is small."""
    out = out or f"{by}_{col}_mean"
    means = df.groupBy(by).agg(F.avg(col).alias(out))
    return df.join(means, by, "left")


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    return add_positions(df, keys, order, block)


def moving_stats(df: DataFrame, keys: Sequence[str], value: str, window: int,
                 pos_col: str = POS, block_rows: int = 262_144) -> DataFrame:
    """Trailing mean and sample std over ``window`` rows; null until the
    window is full (pandas ``rolling(window)``)."""
    def aggs(framed, _ordered):
        full = F.count(F.col(value)).over(framed) == window
        return {"moving_avg": F.when(full, F.avg(value).over(framed)),
                "moving_std": F.when(full, F.stddev_samp(value).over(framed))}
    return rows_frame(df, keys, window, aggs, pos_col, block_rows)


def ffill(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None,
          pos_col: str = POS, block_rows: int = 262_144) -> DataFrame:
    """W4."""
    return carry_last(df, keys, value, out or f"{value}_ffill", pos_col, block_rows)


def bfill(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None,
          pos_col: str = POS, block_rows: int = 262_144) -> DataFrame:
    """W5."""
    return carry_next(df, keys, value, out or f"{value}_bfill", pos_col, block_rows)


def interpolate(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None,
                pos_col: str = POS, block_rows: int = 262_144) -> DataFrame:
    """W6 (SEM-8): linear in position between the surrounding non-null values;
    leading nulls stay null, trailing nulls repeat the last value."""
    out = out or f"{value}_interp"
    v = F.col(value)
    marked = df.withColumn("_pv", F.when(v.isNotNull(), F.struct(F.col(pos_col).alias("p"), v.alias("v"))))
    a = carry_last(marked, keys, "_pv", "_prev", pos_col, block_rows)
    b = carry_next(a, keys, "_pv", "_next", pos_col, block_rows)
    prev_p, prev_v = F.col("_prev.p"), F.col("_prev.v")
    next_p, next_v = F.col("_next.p"), F.col("_next.v")
    est = prev_v + (next_v - prev_v) * (F.col(pos_col) - prev_p) / (next_p - prev_p)
    filled = (F.when(v.isNotNull(), v)
              .when(F.col("_prev").isNotNull() & F.col("_next").isNotNull(), est)
              .when(F.col("_prev").isNotNull(), prev_v))
    return b.withColumn(out, filled).drop("_pv", "_prev", "_next")


def null_blocks(df: DataFrame, keys: Sequence[str], value: str, pos_col: str = POS,
                block_rows: int = 262_144) -> DataFrame:
    """Runs of consecutive nulls (gaps and islands). The rank of each null row
    among nulls comes from the same block-prefix positions, so island id =
    position - null rank is computed without a single-task window."""
    nulls = df.where(F.col(value).isNull()).select(*keys, pos_col)
    ranked = add_positions(nulls, keys, [pos_col], F.floor(F.col(pos_col) / block_rows), "_nrank")
    return (ranked.groupBy(*keys, (F.col(pos_col) - F.col("_nrank")).alias("_island"))
            .agg(F.min(pos_col).alias("start"), F.max(pos_col).alias("end"),
                 F.count(F.lit(1)).alias("length")).drop("_island"))


def lag_sequences(df: DataFrame, keys: Sequence[str], value: str, n: int,
                  pos_col: str = POS, block_rows: int = 262_144, full_only: bool = True) -> DataFrame:
    """Previous ``n`` values as lag_1..lag_n (lag_1 = the row before), target = value."""
    def aggs(_framed, ordered):
        return {f"lag_{k}": F.lag(value, k).over(ordered) for k in range(1, n + 1)}
    out = rows_frame(df, keys, n + 1, aggs, pos_col, block_rows)
    if full_only:
        cond = F.lit(True)
        for k in range(1, n + 1):
            cond = cond & F.col(f"lag_{k}").isNotNull()
        out = out.where(cond & F.col(value).isNotNull())
    return out


def previous_value(df: DataFrame, keys: Sequence[str], value: str, out: str,
                   pos_col: str = POS, block_rows: int = 262_144) -> DataFrame:
    """Value of the previous row of the key (parent version)."""
    return rows_frame(df, keys, 2, lambda _f, o: {out: F.lag(value, 1).over(o)}, pos_col, block_rows)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as an aggregate (max_by):
    partial aggregation on every partition, so hot keys are harmless."""
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys).agg(F.max_by(packed, order).alias("_l"), F.max(order).alias(order))
            .select(*keys, order, "_l.*"))


# Trailing windows of the request counter (seconds).
RATE_WINDOWS = {"minute": 60, "hour": 3600, "day": 86400}


def trailing_counts(df: DataFrame, keys: Sequence[str], ts: str, row_id: str,
                    windows: dict[str, int] | None = None, block_seconds: int = 60) -> DataFrame:
    """Number of rows of the key with timestamp in [t - w, t] for each window w.

    Exact and skew-safe without any window partition per key: with C(x) the
    number of the key's rows at or before x (resp. strictly before x),
    count = C_le(t) - C_lt(t - w). Both are running sums over the union of the
    rows and one probe row per (row, bound), ordered by time with probes for
    "strictly before" placed ahead of rows at the same instant and probes for
    "at or before" after them. The running sum is a block prefix sum over short
    time blocks, so a hot key is spread over many tasks. ``row_id`` must be
    unique per row (the probes are matched back on it)."""
    from tidewater.plans.ordered import prefix_sums
    windows = windows or RATE_WINDOWS
    keys = list(keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = df.withColumn("_rid", F.col(row_id)).withColumn("_us", us)
    data = base.select(*keys, "_us", F.lit(1).alias("_ord"), F.lit(1).cast("long").alias("_one"),
                       F.lit(None).cast(dict(base.dtypes)["_rid"]).alias("_rid"), F.lit(None).cast("string").alias("_probe"))
    probes = [base.select(*keys, "_us", F.lit(2).alias("_ord"), F.lit(0).cast("long").alias("_one"), "_rid",
                          F.lit("le").alias("_probe"))]
    for name, sec in windows.items():
        probes.append(base.select(*keys, (F.col("_us") - sec * 1_000_000).alias("_us"), F.lit(0).alias("_ord"),
                                  F.lit(0).cast("long").alias("_one"), "_rid", F.lit(name).alias("_probe")))
    u = data
    for pr in probes:
        u = u.unionByName(pr)
    cum = prefix_sums(u, keys, ["_us", "_ord"], F.floor(F.col("_us") / (block_seconds * 1_000_000)), ["_one"])
    got = cum.where(F.col("_probe").isNotNull()).groupBy("_rid").pivot("_probe", ["le", *windows]).agg(
        F.first("_one_cum"))
    out = base.join(got, "_rid")
    for name in windows:
        out = out.withColumn(f"n_{name}", F.col("le") - F.col(name))
    return out.drop("_rid", "_us", "le", *windows)
