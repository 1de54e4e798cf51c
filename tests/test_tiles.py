"""Tiles of two groups of points against plain loops over all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tidewater.plans import tiles


def points(x, first=0):
    x = np.asarray(x, float)
    return tiles.Points(pa.table({"id": pa.array(range(first, first + len(x))), "vec": pa.array(x.tolist(), pa.list_(pa.float64()))}))


def far(a, b):
    return np.sqrt(((a.x[:, None] - b.x[None]) ** 2).sum(2))


def least_tree(n, edges):
    root, total = list(range(n)), []
    for d, i, j in sorted(edges):
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[i] = j
            total.append(d)
    return total


@pytest.fixture
def pair(monkeypatch):
    monkeypatch.setattr(tiles, "CELLS", 64)
    monkeypatch.setattr(tiles, "SIDE", 7)
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.integers(0, 3, (20, 2)), np.full((9, 2), 1e6) + rng.random((9, 2)) * 1e-3])
    return points(a), points(np.concatenate([a[::2], rng.random((5, 2))]), 100)


@pytest.mark.parametrize("same", [True, False])
def test_nearest_ties_by_id(pair, same):
    a, b = (pair[0], pair[0]) if same else pair
    d = far(a, b)
    d[a.ids[:, None] == b.ids] = np.inf
    want = [(i, int(j)) for i in range(a.n) for j in np.lexsort((b.ids, d[i]))[:4]]
    i, j, dist = tiles.closest(a, b, 4)
    assert list(zip(i.tolist(), j.tolist())) == want and np.allclose(dist, [d[w] for w in want], rtol=1e-12, atol=0)


@pytest.mark.parametrize("same", [True, False])
def test_spanning_trees_hold_the_whole_one(pair, same):
    a, b = (pair[0], pair[0]) if same else pair
    d, shift = far(a, b), 0 if same else a.n
    every = [(d[i, j], i, j + shift) for i in range(a.n) for j in range(b.n) if not same or i < j]
    i, j, dist = tiles.tree_edges(a, b)
    n = a.n if same else a.n + b.n
    assert np.allclose(least_tree(n, zip(dist, i.tolist(), (j + shift).tolist())), least_tree(n, every), rtol=1e-12, atol=0)


@pytest.mark.parametrize("same", [True, False])
def test_links_are_fewer_than_the_points(pair, same):
    a, b = (pair[0], pair[0]) if same else pair
    near = far(a, b) <= 1.0
    i, j = tiles.linked(a, b, 1.0)
    n = a.n if same else a.n + b.n
    assert len(i) < n and near[i, j].all()
    shift = 0 if same else a.n
    every = [(0.0, p, q + shift) for p, q in zip(*np.nonzero(near)) if not same or p != q]
    assert len(least_tree(n, [(0.0, int(p), int(q) + shift) for p, q in zip(i, j)])) == len(least_tree(n, every)) < len(every) / 2


def test_dense_points_list_no_pairs(spark):
    """The links and the border of a crowd used to be all its pairs, written to disk."""
    from tidewater.operators.ml import dbscan
    df = spark.createDataFrame([(i, [float(i % 3), 0.0], 0) for i in range(300)] + [(900, [3.5, 0.0], 0), (901, [50.0, 0.0], 0)], "id long, vec array<double>, label int")
    out = dbscan(df, 1.6, 120)
    assert "BroadcastNestedLoop" not in out._jdf.queryExecution().toString()
    got = {r.id: (r.cluster, r.is_core) for r in out.collect()}
    assert got[901] == (-1, False) and got[900] == (0, False) and all(got[i] == (0, True) for i in range(300))
