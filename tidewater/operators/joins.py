"""Join-shaped operators (J1, J2, J5-J7) and set operations.

Joins are declared with the DataFrame API and Catalyst / AQE pick the
strategy: a side is broadcast only when its runtime size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-plans with real sizes), and
skewed partitions are split by AQE's skew-join handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.ordered import add_positions


def semi_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a match in ``right`` (EXISTS)."""
    return left.join(right.select(*([on] if isinstance(on, str) else on)), on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a match (NOT EXISTS)."""
    return left.join(right.select(*([on] if isinstance(on, str) else on)), on, "left_anti")


def outer_compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Align two (key, value) tables by key, missing side -> 0."""
    b = before.select(key, F.col(value).alias("before"))
    a = after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full_outer").na.fill(0, ["before", "after"])


def fan_out(messages: DataFrame, members: DataFrame, room: str, sender: str, member: str) -> DataFrame:
    """Each message goes to every other member of its room: equi-join on the
    room, then ``member <> sender``. ``members`` is the distinct membership table,
    so output = messages x (members - 1), never all message pairs."""
    m = members.select(room, F.col(member).alias("recipient")).distinct()
    return messages.join(m, room).where(F.col("recipient") != F.col(sender))


def fk_chain(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Orders -> customer (inner) -> nation (left)."""
    oc = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    return oc.join(nation, oc.c_nationkey == nation.n_nationkey, "left")


def populated_columns(df: DataFrame) -> DataFrame:
    """(column) for every column holding at least one non-null value - one fused
    aggregate over the table, unpivoted."""
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in df.columns]))
    return wide.select(cells.alias("s")).where(F.col("s.n") > 0).select("s.column")


def column_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Populated columns only in a, only in b, and in both (set difference and
    intersection of the two column tables)."""
    ca, cb = populated_columns(a), populated_columns(b)
    return (ca.exceptAll(cb).withColumn("kind", F.lit("only_left"))
            .unionByName(cb.exceptAll(ca).withColumn("kind", F.lit("only_right")))
            .unionByName(ca.intersect(cb).withColumn("kind", F.lit("both"))))


def branch_merge(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """Per key, target versions followed by source versions; ``merged_pos`` is
    the 0-based position in the merged history (block-prefix positions, so one
    huge history still ranks in parallel)."""
    u = (target.withColumn("_branch", F.lit(0)).unionByName(source.withColumn("_branch", F.lit(1))))
    block = F.col("_branch") * F.lit(1 << 40) + F.floor(F.col(order) / 4096)
    return add_positions(u, [key], ["_branch", order], block, "merged_pos").withColumnRenamed("_branch", "branch")


def dense_codes(values: DataFrame, col: str, out: str) -> DataFrame:
    """(value, code) by sorted order over the distinct values - the lookup
    table joined back to rows (range-partitioned ranking, no single-task window)."""
    from tidewater.operators.features import rank_distinct
    return rank_distinct(values.select(col).distinct(), col, out)
