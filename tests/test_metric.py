"""DBSCAN by distances, against brute force in many dimensions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kohorta.operators import metric
from tests.test_cluster import brute_dbscan

SCHEMA = "id LONG, v ARRAY<DOUBLE>, f INT"


def _groups(rng, dims):
    """A wide dense group, a chain of points, narrow groups in reach of each other, and strays."""
    one = rng.normal(0, 0.02, (150, dims)) / np.sqrt(dims / 2)
    step = np.zeros((40, dims))
    step[:, 0] = np.arange(40) * 0.2 + 1
    pair = np.concatenate([rng.normal(c, 0.01, (40, dims)) for c in (5.0, 5.0 + 0.2 / np.sqrt(dims))])
    return np.concatenate([one, step, pair, rng.normal(0, 3, (30, dims)), one[:15]])


@pytest.mark.parametrize("dims, eps, cell, fanout", [(64, 0.35, 16, 4), (64, 0.35, 1024, 64), (3, 0.3, 12, 5), (20, 5.5, 20, 8)])
def test_equal_to_brute_force(table, monkeypatch, dims, eps, cell, fanout):
    monkeypatch.setattr(metric, "CELL_POINTS", cell)
    monkeypatch.setattr(metric, "FANOUT", fanout)
    monkeypatch.setattr(metric, "ROOM_POINTS", 37)
    x = _groups(np.random.default_rng(dims), dims)
    blocks = (np.arange(len(x)) % 9 == 0).astype(int)
    df = table([(i, r.tolist(), int(b)) for i, (r, b) in enumerate(zip(x, blocks))], SCHEMA)
    got = {r["id"]: r["cluster"] for r in metric.dbscan_metric(df.repartition(3), "v", eps, 5, ["f"]).collect()}
    want = brute_dbscan(x, blocks, eps, 5).tolist()
    assert len(set(want)) > 3 or dims == 20
    assert [got[i] for i in range(len(x))] == want


def test_dense_nodes_are_used(table, monkeypatch):
    monkeypatch.setattr(metric, "CELL_POINTS", 30)
    monkeypatch.setattr(metric, "FANOUT", 4)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.01, (80, 8)) for c in (0.0, 0.3, 4.0)])
    df = table([(i, r.tolist(), 0) for i, r in enumerate(x)], SCHEMA)
    points = df.select(F.lit("").alias("node"), "id", "v", F.lit(1).cast("long").alias("w"))
    tree = metric._Tree(points, 0.9, 5)
    assert tree.homes.where("dense is null").count() == 0 and tree.homes.count() == 240
    assert tree.homes.groupBy("node").count().agg(F.max("count")).first()[0] <= 30
    got = [r["cluster"] for r in metric.dbscan_metric(df, "v", 0.9, 5).orderBy("id").collect()]
    assert got == brute_dbscan(x, np.zeros(len(x)), 0.9, 5).tolist()


def test_odd_rows(table):
    rows = [(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 0), (3, None, 0), (4, [0.0, None], 0), (5, [float("nan"), 0.0], 0), (6, [9.0, 9.0], None)]
    got = {r["id"]: r["cluster"] for r in metric.dbscan_metric(table(rows, SCHEMA), "v", 0.1, 2).collect()}
    assert got == {1: 1, 2: 1, 3: -1, 4: -1, 5: -1, 6: -1}
    assert metric.dbscan_metric(table(rows, SCHEMA).where("false"), "v", 0.1, 2).count() == 0


def test_rough_distances_and_links(table, monkeypatch):
    """Far from the origin and at the very radius, points are near as differences say; links span what is near."""
    monkeypatch.setattr(metric, "BLOCK_VALUES", 500)
    rng = np.random.default_rng(8)
    for shift, scale in ((0.0, 1.0), (1e6, 1.0), (0.0, 1e-20), (0.0, 1e25)):
        x = (rng.integers(0, 3, (90, 6)) + shift) * scale
        eps = 2.0 * scale
        left, right = (pa.table({"id": list(range(len(v))), "label": [1000 + i for i in range(len(v))], "v": v.tolist()}) for v in (x[:40], x[40:]))
        near = metric._squares(x[:40], x[40:]) <= eps * eps
        assert (metric._near(left, right, eps) == near).all()
        links = metric._links(eps)(left, right)
        pairs = list(zip(links["a"].to_pylist(), links["b"].to_pylist()))
        assert all(near[a, b - 1000] for a, b in pairs) and len(set(pairs)) == len(pairs) < near.sum()
        group = {**{i: i for i in range(40)}, **{1000 + i: 1000 + i for i in range(50)}}

        def root(i):
            while group[i] != i:
                i = group[i]
            return i

        for a, b in pairs:
            assert root(a) != root(b)
            group[root(b)] = root(a)
        assert all(root(a) == root(1000 + b) for a, b in zip(*np.nonzero(near)))


def test_no_more_cells_than_the_points_need(table, monkeypatch):
    """Where no bound rules anything out, a point is sent to each cell, so these are few."""
    monkeypatch.setattr(metric, "CELL_POINTS", 100)
    x = np.random.default_rng(9).normal(0, 1, (300, 32))
    points = table([(i, r.tolist(), 0) for i, r in enumerate(x)], SCHEMA).select(F.lit("").alias("node"), "id", "v", F.lit(1).cast("long").alias("w"))
    tree = metric._Tree(points, 7.0, 5)
    assert tree.levels[0].count() <= 6
    searchers = points.select("node", "id", "v", F.lit(7.0).alias("reach"))
    assert tree.search(searchers).count() <= 300 * tree.homes.select("node").distinct().count() <= 300 * 20
