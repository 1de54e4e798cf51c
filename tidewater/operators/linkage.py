"""Agglomerative clustering with single linkage (M13), from an exact minimum spanning tree.

Merging the two closest clusters again and again joins points along the edges of
the minimum spanning tree, by rising length. The points are dealt to groups, and each pair of groups
gives the spanning trees of its own points (``plans.tiles``): together they hold a minimum spanning tree of all.
It is picked out of them in Boruvka rounds: every component takes its shortest edge to another one, and
components that are linked become one, which at least halves their number; of the edges between two components the
shortest stays. Edges are ordered by length and ids, so equal lengths give no cycles. Nothing but one number a round reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans import tiles
from tidewater.plans.graph import components
from tidewater.session import staged

#: A bound for a mistake in the code: rounds halve the components.
ROUNDS = 64


def spanning_tree(points: DataFrame, n_pivots: int | None = None, seed: int = 42) -> DataFrame:
    """(a, b, height): the edges of the minimum spanning tree of ``points`` (id long, vec array<double>), one fewer than the points.
    Points that coincide are joined at height 0. Ids are distinct. ``n_pivots``: the number of groups."""
    def trees(a: tiles.Points, b: tiles.Points) -> pa.Table:
        i, j, far = tiles.tree_edges(a, b)
        return pa.table({"a": a.ids[i], "b": b.ids[j], "d": far})
    n = points.count()
    if n < 2:
        return points.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("height")).limit(0)
    found = tiles.tiled(points.select("id", "vec"), n_pivots or tiles.groups_for(n), trees, "a long, b long, d double", seed)
    # (x, y): the components an edge lies between; (d, a, b): the edge
    edge = F.struct("d", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    state = staged(found.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), edge.alias("e")), "edges")
    tree, left = None, n
    for _ in range(ROUNDS):
        ends = state.unionByName(state.select(F.col("y").alias("x"), F.col("x").alias("y"), "e"))
        best = staged(ends.groupBy("x").agg(F.min(F.struct("e", "y")).alias("m")).select("x", "m.y", "m.e"), "best", rows=left)
        named = best.select("e.a", "e.b", F.col("e.d").alias("height")).distinct()
        tree = named if tree is None else tree.unionByName(named)
        into = components(best.select(F.col("x").alias("a"), F.col("y").alias("b")), left)
        into = staged(into, "into", rows=left)
        of = lambda c: into.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        moved = state.join(of("x"), "x").join(of("y"), "y").where("_x <> _y")
        state = staged(moved.groupBy(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).agg(F.min("e").alias("e")), "edges")
        if state.isEmpty():
            return tree
        left = into.select("component").distinct().count()
    raise RuntimeError("the spanning tree did not settle")


def cut(points: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(id, cluster): the ``k`` clusters that are left without the ``k - 1`` longest edges of the tree (ties by ids); a cluster is named by its least id."""
    longest = tree.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(k - 1)
    kept = tree.join(longest, ["a", "b"], "left_anti")
    linked = components(kept.select("a", "b"))
    return points.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def agglomerative(points: DataFrame, k: int = 10, n_pivots: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, float | None]:
    """(id, cluster) with ``k`` clusters, the merges (a, b, height) and the silhouette (squared Euclidean; None for one cluster)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    tree = staged(spanning_tree(points, n_pivots=n_pivots, seed=seed), "tree")
    assigned = staged(cut(points, tree, k), "clusters")
    if assigned.select("cluster").distinct().limit(2).count() < 2:
        return assigned, tree, None
    rows = assigned.join(points, "id").select(array_to_vector("vec").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    return assigned, tree, float(ClusteringEvaluator().evaluate(rows))
