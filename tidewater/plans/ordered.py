"""Order-dependent computations that stay parallel when one key is huge.

A plain ``Window.partitionBy(key).orderBy(t)`` puts every row of a key into
one task; with a hot key holding a third of the data that task is the job.
The helpers here split each key into *blocks* and stitch the blocks back
together through small per-block summary tables:

* ``add_positions`` - global 0-based position inside a key: row_number inside
  (key, block) plus the prefix sum of block sizes (a window over the tiny
  (key, block) count table).
* ``rows_frame`` - sliding ``ROWS BETWEEN w-1 PRECEDING`` aggregates: rows are
  re-blocked by position and the last ``w-1`` rows of each block are copied
  into the next one as a read-only *halo*.
* ``range_frame`` - sliding time-range aggregates with a time-block halo.
* ``carry_last`` / ``carry_next`` - forward / backward fill: in-block fill plus
  the last (first) non-null value carried over from earlier (later) blocks.

Every stage is a normal hash-partitioned shuffle on (key, block); the only
un-split partitions are the per-key summary windows, whose size is the
number of blocks, not rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"
BLK = "_blk"


def add_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                  pos_col: str = POS) -> DataFrame:
    """Adds ``pos_col`` = 0-based position of the row within its key, in ``order``.

    ``block`` must be non-decreasing along ``order`` (e.g. an hour bucket of the
    timestamp the order starts with, or ``floor(id / 4096)``)."""
    keys = list(keys)
    b = df.withColumn(BLK, block.cast("long"))
    counts = b.groupBy(*keys, BLK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, BLK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*keys, BLK).orderBy(*order)
    return (b.withColumn("_rn", F.row_number().over(within))
            .join(offsets, [*keys, BLK])
            .withColumn(pos_col, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_rn", "_off", BLK))


def rows_frame(df: DataFrame, keys: Sequence[str], width: int,
               aggs: Callable[[Window, Window], dict[str, Column]], pos_col: str = POS,
               block_rows: int = 262_144) -> DataFrame:
    """Apply ``aggs(framed, ordered)``: ``framed`` is ``ROWS BETWEEN width-1 PRECEDING AND
    CURRENT ROW`` ordered by ``pos_col`` within each key; ``ordered`` is the same
    window without a frame (for lag/lead up to ``width-1`` rows back)."""
    keys = list(keys)
    size = max(block_rows, width)
    pb = F.floor(F.col(pos_col) / size)
    main = df.withColumn("_pb", pb).withColumn("_halo", F.lit(False))
    halo = (df.where(F.col(pos_col) % size >= size - (width - 1))
            .withColumn("_pb", pb + 1).withColumn("_halo", F.lit(True)))
    both = main.unionByName(halo) if width > 1 else main
    ordered = Window.partitionBy(*keys, "_pb").orderBy(pos_col)
    cols = aggs(ordered.rowsBetween(-(width - 1), 0), ordered)
    return both.select("*", *[v.alias(k) for k, v in cols.items()]).where(~F.col("_halo")).drop("_pb", "_halo")


def range_frame(df: DataFrame, keys: Sequence[str], ts: str, range_seconds: int,
                aggs: Callable[[Callable[[int], Window]], dict[str, Column]],
                block_seconds: int | None = None) -> DataFrame:
    """Apply ``aggs(frame)`` where ``frame(s)`` is the window ``RANGE BETWEEN s seconds
    PRECEDING AND CURRENT ROW`` (s <= range_seconds) on the timestamp, at microsecond
    resolution so sub-second events stay apart.

    Rows are grouped in time blocks of ``block_seconds`` (>= range); rows within
    ``range`` of the next block's start are copied into it as halo rows."""
    keys = list(keys)
    bs = max(block_seconds or range_seconds, range_seconds)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    blk = F.floor(us / (bs * 1_000_000))
    base = df.withColumn("_us", us).withColumn("_tb", blk)
    main = base.withColumn("_halo", F.lit(False))
    halo = (base.where(F.col("_us") >= (F.col("_tb") + 1) * (bs * 1_000_000) - range_seconds * 1_000_000)
            .withColumn("_tb", F.col("_tb") + 1).withColumn("_halo", F.lit(True)))
    both = main.unionByName(halo)
    ordered = Window.partitionBy(*keys, "_tb").orderBy("_us")

    def frame(seconds: int) -> Window:
        if seconds > range_seconds:
            raise ValueError("frame wider than the halo")
        return ordered.rangeBetween(-seconds * 1_000_000, 0)
    cols = aggs(frame)
    return both.select("*", *[v.alias(k) for k, v in cols.items()]).where(~F.col("_halo")).drop("_us", "_tb", "_halo")


def _block_of(pos_col: str, size: int) -> Column:
    return F.floor(F.col(pos_col) / size).cast("long")


def carry_last(df: DataFrame, keys: Sequence[str], value: str, out: str, pos_col: str = POS,
               block_rows: int = 262_144) -> DataFrame:
    """Forward fill: last non-null ``value`` at or before the row (by ``pos_col``)."""
    keys = list(keys)
    b = df.withColumn(BLK, _block_of(pos_col, block_rows))
    w_in = Window.partitionBy(*keys, BLK).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    summ = (b.where(F.col(value).isNotNull()).groupBy(*keys, BLK)
            .agg(F.max_by(value, pos_col).alias("_last")))
    # every block (also those without a non-null value) takes the last value of
    # the nearest earlier block: a window over the small per-block table
    blocks = b.select(*keys, BLK).distinct()
    all_blk = blocks.join(summ.select(*keys, BLK, "_last"), [*keys, BLK], "left")
    w_all = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = all_blk.select(*keys, BLK, F.last("_last", ignorenulls=True).over(w_all).alias("_carry"))
    return (b.withColumn("_inblk", F.last(value, ignorenulls=True).over(w_in))
            .join(carry, [*keys, BLK], "left")
            .withColumn(out, F.coalesce(F.col("_inblk"), F.col("_carry")))
            .drop("_inblk", "_carry", BLK))


def carry_next(df: DataFrame, keys: Sequence[str], value: str, out: str, pos_col: str = POS,
               block_rows: int = 262_144) -> DataFrame:
    """Backward fill: first non-null ``value`` at or after the row."""
    keys = list(keys)
    b = df.withColumn(BLK, _block_of(pos_col, block_rows))
    # read backwards: a frame that ends with its row is carried along, one that starts with it is read anew for each row
    w_in = Window.partitionBy(*keys, BLK).orderBy(F.desc(pos_col)).rowsBetween(Window.unboundedPreceding, 0)
    summ = (b.where(F.col(value).isNotNull()).groupBy(*keys, BLK)
            .agg(F.min_by(value, pos_col).alias("_first")))
    blocks = b.select(*keys, BLK).distinct()
    all_blk = blocks.join(summ, [*keys, BLK], "left")
    w_all = Window.partitionBy(*keys).orderBy(F.desc(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = all_blk.select(*keys, BLK, F.last("_first", ignorenulls=True).over(w_all).alias("_carry"))
    return (b.withColumn("_inblk", F.last(value, ignorenulls=True).over(w_in))
            .join(carry, [*keys, BLK], "left")
            .withColumn(out, F.coalesce(F.col("_inblk"), F.col("_carry")))
            .drop("_inblk", "_carry", BLK))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                cols: Sequence[str], suffix: str = "_cum") -> DataFrame:
    """Running sums of ``cols`` (inclusive) along ``order`` within each key: in-block
    running sums plus the totals of all earlier blocks (a window over the small
    (key, block) totals table). ``block`` must be non-decreasing along ``order``."""
    keys = list(keys)
    b = df.withColumn(BLK, block.cast("long"))
    totals = b.groupBy(*keys, BLK).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, BLK, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                          for c in cols])
    within = Window.partitionBy(*keys, BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.select("*", *[F.sum(c).over(within).alias(f"_w_{c}") for c in cols]).join(offsets, [*keys, BLK])
    return out.select(*df.columns, *[(F.col(f"_w_{c}") + F.col(f"_o_{c}")).alias(f"{c}{suffix}") for c in cols])


def value_blocks(df: DataFrame, keys: Sequence[str], value: Column, target_rows: int = 1_000_000,
                 min_width: float = 1.0, out: str = "_tblk") -> DataFrame:
    """Adds a block index that is monotone in ``value`` within each key and sized so a
    block holds about ``target_rows`` rows: width = the key's value span x target /
    the key's row count (at least ``min_width``). A hot key gets many narrow blocks,
    a sparse key a single one; one small per-key aggregate decides it."""
    from tidewater.plans.attach import attach
    keys = list(keys)
    v = value.cast("double")
    st = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bn"), F.min(v).alias("_blo"), F.max(v).alias("_bhi"))
    width = F.greatest(F.lit(float(min_width)), (F.col("_bhi") - F.col("_blo") + 1) * float(target_rows) / F.col("_bn"))
    return (attach(df, st, keys).withColumn(out, F.floor((v - F.col("_blo")) / width).cast("long"))
            .drop("_bn", "_blo", "_bhi"))


def time_blocks(df: DataFrame, keys: Sequence[str], ts: str, target_rows: int = 1_000_000,
                out: str = "_tblk") -> DataFrame:
    """``value_blocks`` on the timestamp in microseconds, at least one second wide."""
    return value_blocks(df, keys, F.unix_micros(F.col(ts).cast("timestamp")), target_rows, 1_000_000.0, out)
