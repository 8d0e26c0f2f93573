"""Clustering-feature trees and Birch labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import birch, cluster


def _rows(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, features array<double>")


def _blobs(seed=1, n=900):
    pick = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [9, 0, 1], [0, 9, 2]])
    which = pick.integers(0, 3, n)
    return centers[which] + pick.normal(0, 0.6, (n, 3)), which


def test_features_add_up_and_stay_within_the_threshold():
    x, _ = _blobs()
    tree = birch.FeatureTree(3, threshold=0.5, branching=5, max_leaves=10_000)
    for row in x:
        tree.insert(1.0, row, row @ row)
    n, total, square = tree.features()
    assert len(n) == tree.leaves and n.sum() == len(x)
    assert np.allclose(total.sum(axis=0), x.sum(axis=0)) and np.isclose(square.sum(), (x * x).sum())
    radius = np.sqrt(np.maximum(square / n - ((total / n[:, None]) ** 2).sum(axis=1), 0))
    assert radius.max() <= 0.5 + 1e-6 and 20 < len(n) < len(x)

    def entries(node):
        """Entries of inner nodes are the sums of what is below them, and no node is too full."""
        assert node.size <= 5
        for i, child in enumerate(node.children or []):
            below = child.summed()
            assert np.isclose(node.n[i], below[0]) and np.allclose(node.total[i], below[1]) and np.isclose(node.square[i], below[2])
            entries(child)

    entries(tree.root)


def test_a_full_tree_raises_its_threshold():
    x, _ = _blobs(2)
    tree = birch.FeatureTree(3, threshold=0.01, branching=7, max_leaves=60)
    for row in x:
        tree.insert(1.0, row, row @ row)
    n, total, _ = tree.features()
    assert len(n) <= 60 and tree.threshold > 0.01 and n.sum() == len(x) and np.allclose(total.sum(axis=0), x.sum(axis=0))


def test_equal_rows_are_one_subcluster():
    tree = birch.FeatureTree(2, threshold=0.0, branching=3, max_leaves=4)
    for i in range(200):
        tree.insert(1.0, np.array([i % 4, 1.0]), float((i % 4) ** 2 + 1))
    assert sorted(tree.features()[0]) == [50] * 4 and tree.threshold == 0


@pytest.mark.parametrize("tree_rows", [10_000, 100, 9])
def test_birch_finds_blobs_whatever_the_partitions(spark, tree_rows, monkeypatch):
    x, which = _blobs()
    monkeypatch.setattr(birch.birch_subclusters, "__defaults__", (0.5, 50, 500, tree_rows))
    found = []
    for parts in (1, 5):
        rows = cluster.birch_labels(_rows(spark, x).repartition(parts), [2, 3], max_leaves=40).orderBy("id").collect()
        found.append([tuple(r.labels) for r in rows])
    assert found[0] == found[1]
    pairs = {(w, labels[1]) for w, labels in zip(which.tolist(), found[0])}
    assert len(pairs) == 3 and len({c for _, c in pairs}) == 3
    assert {labels[0] for labels in found[0]} == {0, 1}


def test_birch_of_few_and_no_rows(spark):
    x = np.array([[0.0, 0.0], [0.1, 0.0], [5.0, 5.0]])
    got = cluster.birch_labels(_rows(spark, x), [2, 8]).orderBy("id").collect()
    assert got[0].labels == got[1].labels != got[2].labels
    assert cluster.birch_labels(_rows(spark, x).where("false"), [2]).count() == 0
    labelled = cluster.fit_labels(_rows(spark, x), [2], "birch")
    assert labelled.select(F.size("labels")).distinct().collect()[0][0] == 1
