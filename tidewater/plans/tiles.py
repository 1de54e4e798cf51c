"""All pairs of points in bounded memory: the points are dealt to groups, and each pair of groups is a tile.

A tile is one group of a shuffle, its points two matrices, and its distances come from
one matrix product, some millions of cells at a time. The product only screens: what it cannot decide within
its rounding error is measured again from the differences, in the order in which Spark sums them.
So every pair is looked at, and results are those of a plain join, whatever the vectors are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most points of a group; fewer points are dealt to FEWEST groups, so that the tiles fill the cores, but for groups under SMALL.
ROWS, FEWEST, SMALL = 16_384, 8, 512
#: Distances held at a time, and points to a side of a matrix that is held as a whole.
CELLS, SIDE = 1 << 21, 4096


def groups_for(n: int) -> int:
    return max(1, math.ceil(n / ROWS), min(FEWEST, math.ceil(n / SMALL)))


class Points:
    """The rows of one group: ``ids``, the matrix ``x`` and the table they came from."""

    def __init__(self, table: pa.Table):
        vec = table["vec"].combine_chunks()
        if vec.null_count:
            raise ValueError("a vector is null")
        self.table, self.n = table, table.num_rows
        self.ids = table["id"].to_numpy()
        self.x = np.asarray(vec.flatten(), float).reshape(self.n, -1)
        self.xt = np.ascontiguousarray(self.x.T)
        self.norm = (self.x * self.x).sum(1)


def tiled(points: DataFrame, groups: int, work: Callable[[Points, Points], pa.Table], schema: str, seed: int = 42) -> DataFrame:
    """``work(a, b)`` for every pair of groups; a group with itself as work(a, a). ``points``: (id long, vec array<double>, ...).
    Rows without an id are left out; those of equal ids are in one group. Tiles take part in one shuffle of ``groups`` times the points."""
    def run(table: pa.Table) -> pa.Table:
        own = table["_g"].to_numpy()
        at = own == own.min()
        a = Points(table.filter(pa.array(at)))
        return work(a, a if table["_i"][0] == table["_j"][0] else Points(table.filter(pa.array(~at))))

    def guarded(table: pa.Table) -> pa.Table:
        if table["_i"][0] != table["_j"][0] and len(table["_g"].unique()) < 2:  # the other group is empty
            return schema_.empty_table()
        return run(table)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema_ = to_arrow_schema(StructType.fromDDL(schema))
    own = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).cast("int")
    rows = points.where(F.col("id").isNotNull()).withColumn("_g", own).withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return (rows.withColumn("_i", F.least("_g", "_h")).withColumn("_j", F.greatest("_g", "_h")).drop("_h")
            .groupBy("_i", "_j").applyInArrow(guarded, schema))


def measured(a: Points, b: Points, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i of ``a`` to the rows j of ``b``, summed as Spark's aggregate does."""
    total = np.zeros(len(i))
    for u, v in zip(a.xt, b.xt):
        t = u[i] - v[j]
        total += t * t
    return np.sqrt(total)


def error(a: Points, b: Points) -> np.ndarray:
    """How far a screened square may be off, for each row of ``a``."""
    return 8 * (a.x.shape[1] + 8) * np.finfo(float).eps * (a.norm + b.norm.max(initial=0.0))


def screened(a: Points, b: Points) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, squared distances of some rows of ``a`` to all of ``b``), up to ``error``; infinite between equal ids."""
    step = max(1, CELLS // max(b.n, 1))
    for s in range(0, a.n, step):
        d = a.x[s:s + step] @ b.x.T
        d *= -2
        d += a.norm[s:s + step, None]
        d += b.norm
        if a is b:
            d[a.ids[s:s + step, None] == b.ids] = np.inf
        yield s, d


def within(a: Points, b: Points, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whether the distance is at most ``eps``), exact."""
    slack = error(a, b)
    for s, d in screened(a, b):
        off = slack[s:s + len(d), None]
        near = d <= eps * eps + off
        i, j = np.nonzero(near & (d >= eps * eps - off))
        near[i, j] = measured(a, b, i + s, j) <= eps
        yield s, near


def closest(a: Points, b: Points, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance): the ``k`` nearest rows, ties by id."""
    out, slack, many = [], error(a, b), min(k, b.n)
    for s, d in screened(a, b):
        cut = np.partition(d, many - 1, axis=1)[:, many - 1] + 2 * slack[s:s + len(d)]
        i, j = np.nonzero((d <= cut[:, None]) & (d < np.inf))
        far = measured(a, b, i + s, j)
        order = np.lexsort((b.ids[j], far, i))
        i, j, far = i[order], j[order], far[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[kept] + s, j[kept], far[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _squares(a: Points, b: Points, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of rows i to rows j; those that cancellation leaves with few digits are measured."""
    d = a.norm[i, None] + b.norm[j] - 2 * (a.x[i] @ b.x[j].T)
    for s in range(0, len(i), max(1, CELLS // max(len(j), 1))):
        part = d[s:s + max(1, CELLS // max(len(j), 1))]
        p, q = np.nonzero(part <= 1e-4 * (a.norm[i[s:s + len(part)], None] + b.norm[j]))
        part[p, q] = measured(a, b, i[s + p], j[q]) ** 2
    if a is b:
        d[a.ids[i, None] == b.ids[j]] = np.inf
    return d


def _prim(d: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a least spanning tree of the complete bipartite graph between the rows and the columns of ``d``
    (of each of its parts, where cells are infinite)."""
    n, m = d.shape
    dt = np.ascontiguousarray(d.T)
    best, parent, todo, out = np.full(n + m, np.inf), np.zeros(n + m, int), np.ones(n + m, bool), []
    v = 0
    for _ in range(n + m):
        todo[v] = False
        best[v] = np.inf
        row, lo, hi = (d[v], n, n + m) if v < n else (dt[v - n], 0, n)
        better = (row < best[lo:hi]) & todo[lo:hi]
        np.copyto(best[lo:hi], row, where=better)
        parent[lo:hi][better] = v
        v = int(best.argmin())
        if best[v] == np.inf:
            left = np.flatnonzero(todo)
            if not len(left):
                break
            v = int(left[0])
            continue
        out.append((parent[v], v - n) if v >= n else (v, parent[v] - n))
    return out


def _prim_own(d: np.ndarray) -> list[tuple[int, int]]:
    """The same among the rows of a square matrix."""
    n = len(d)
    best, parent, todo, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), []
    v = 0
    for _ in range(n):
        todo[v] = False
        best[v] = np.inf
        better = (d[v] < best) & todo
        np.copyto(best, d[v], where=better)
        parent[better] = v
        v = int(best.argmin())
        if best[v] == np.inf:
            left = np.flatnonzero(todo)
            if not len(left):
                break
            v = int(left[0])
            continue
        out.append((parent[v], v))
    return out


def tree_edges(a: Points, b: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance): least spanning trees of the parts of a tile. An edge of the whole tree
    is in the tree of every subgraph that has it, so the trees of all tiles hold a least spanning tree of all points."""
    pieces = lambda p: [np.arange(s, min(s + SIDE, p.n)) for s in range(0, p.n, SIDE)]
    out = []
    for x, i in enumerate(pieces(a)):
        for y, j in enumerate(pieces(b)):
            if a is b and y < x:
                continue
            d = _squares(a, b, i, j)
            found = np.array(_prim_own(d) if a is b and x == y else _prim(d), int).reshape(-1, 2)
            out.append((i[found[:, 0]], j[found[:, 1]]))
    i, j = (np.concatenate(c) for c in zip(*out))
    return i, j, measured(a, b, i, j)


def linked(a: Points, b: Points, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``): pairs within ``eps`` that link what all such pairs of the tile link, fewer than its points."""
    own = np.arange(a.n)
    other = own if a is b else np.arange(a.n, a.n + b.n)
    part, pairs = np.arange(a.n if a is b else a.n + b.n), []
    for s, near in within(a, b, eps):
        for r, row in enumerate(near, s):
            j = np.flatnonzero(row)
            names, first = np.unique(part[other[j]], return_index=True)
            new = names != part[own[r]]
            if new.any():
                pairs += [(r, q) for q in j[first[new]]]
                part[np.isin(part, names[new])] = part[own[r]]
    found = np.array(pairs, int).reshape(-1, 2)
    return found[:, 0], found[:, 1]
