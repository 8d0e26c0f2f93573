"""Rounds of reciprocal nearest neighbours against the merge of one pair at a time."""

import numpy as np
import pytest

from kohorta.operators import cluster, ward


def _summary(spark, x, n):
    return spark.createDataFrame(
        [(i, float(k), [float(v) for v in row]) for i, (row, k) in enumerate(zip(x, n))], "cid bigint, n double, mu array<double>"
    )


@pytest.mark.parametrize("block, last", [(64, 1), (40, 20)])
def test_cuts_equal_the_plain_merge(spark, block, last):
    pick = np.random.default_rng(3)
    x, n, ks = pick.normal(size=(150, 5)), pick.integers(1, 9, 150).astype(float), [1, 2, 5, 12]
    want = ward.ward_merges(n, x, ks)
    got = {r.cid: r.labels for r in ward.ward_cuts(_summary(spark, x, n), ks, block, last).collect()}
    assert [[got[i][z] for i in range(len(x))] for z in range(len(ks))] == [want[k].tolist() for k in ks]


def test_heights_rise(spark):
    pick = np.random.default_rng(4)
    x = pick.normal(size=(40, 2))
    rows = ward.ward_hierarchy(_summary(spark, x, np.ones(40)), block=64, last=5).collect()
    want = sorted(c for *_, c in ward.merge_steps(np.ones(40), x))
    assert len(rows) == 39 and np.allclose(sorted(r.height for r in rows), want)


def test_ties_settle(spark):
    """A grid of equal distances, and rows that repeat: the number of clusters is right, and equal rows stay together."""
    x = [[float(i % 6), float(i // 6)] for i in range(36)] * 3
    points = spark.createDataFrame(list(enumerate(x)), "id bigint, features array<double>")
    rows = cluster.ward_fit(points, [3, 7, 500]).collect()
    assert len(rows) == 108
    assert [len({r.labels[z] for r in rows}) for z in range(3)] == [3, 7, 36]
    assert len({(tuple(r.features), tuple(r.labels)) for r in rows}) == 36


def test_no_rows(spark):
    points = spark.createDataFrame([], "id bigint, features array<double>")
    assert cluster.ward_fit(points, [2]).count() == 0


def test_blocks_grow_and_not_their_number(spark, monkeypatch):
    """A row is sent as often at twice the rows, and tiles of any size find the same nearest nodes."""
    monkeypatch.setattr(ward, "TILE", (32, 50))
    monkeypatch.setattr(ward, "PAIRS", 64)
    pick = np.random.default_rng(5)
    for rows in (600, 1200):
        x, n = pick.integers(0, 5, (rows, 4)).astype(float) + 1e6, pick.integers(1, 4, rows).astype(float)
        nodes = _summary(spark, x, n)
        found = ward._nearest(nodes, nodes, rows, rows, 40)
        sent = found._jdf.queryExecution().analyzed().toString()
        assert sent.count("explode(sequence(0, ") == sent.count(f"explode(sequence(0, {ward.BLOCKS - 1},") == 2
        cost = ((x[:, None] - x[None]) ** 2).sum(-1) * (n[:, None] * n) / (n[:, None] + n)
        np.fill_diagonal(cost, np.inf)
        got = {r.cid: r for r in found.collect()}
        assert [got[i].cost for i in range(rows)] == cost.min(axis=1).tolist()
        assert all(cost[i, r.other] == r.cost for i, r in got.items())


@pytest.mark.parametrize("task", [1, 60])
def test_rounds_of_one_task_are_those_of_all(spark, monkeypatch, task):
    """Merges, heights and turns are the same, and only rounds of more clusters than a task takes are written."""
    pick = np.random.default_rng(6)
    x, n = pick.normal(size=(150, 5)), pick.integers(1, 4, 150).astype(float)
    writes, written = [], ward.written
    monkeypatch.setattr(ward, "written", lambda df, name: writes.append(name) or written(df, name))
    nodes = _summary(spark, x, n)
    whole = ward.ward_hierarchy(nodes, block=30, last=4).collect()
    assert writes == ["ward-nodes"] and len(whole) == 149
    monkeypatch.setattr(ward, "TILE", (16, 7))
    monkeypatch.setattr(ward, "TASK_CLUSTERS", task)
    assert sorted(ward.ward_hierarchy(nodes, block=30, last=4).collect()) == sorted(whole)
    assert len(writes) > 5
