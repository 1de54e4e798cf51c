"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import staged

#: A bound for a mistake in the code, far above the rounds that a graph needs (they grow with the logarithm of its size).
ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """For each node, link the neighbours above it (large) or itself and those below (small)
    to the least of the node and its neighbours. The least is found by a
    map-side-combined aggregate, so a node with many neighbours is no hot group."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = around.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    both = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return both.where("a <> b").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(a, b) links between long nodes -> (node, component), the least node of its
    component; nodes without a link are absent. Links may repeat and point either way.
    ``rows``: a bound of their number, if it is known."""
    state = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", rows=rows)
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(state)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        state = staged(_star(_star(state, True), False), "links", rows=2 * seen[0])
        last, seen = seen, mark(state)
        if seen == last:
            break
    else:
        raise RuntimeError("the components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
