"""Birch: a tree of clustering features that sums rows up to subclusters of a bounded radius.

A clustering feature is (n, sum, sum of squares): it adds up, and gives centroid and radius. A row goes
down the tree to the nearest centroid at every node and joins the subcluster it ends at if that keeps its
radius within the threshold; otherwise it begins one of its own, and full nodes are split around their
two farthest entries. A tree with more subclusters than it may have is built again from them under a
larger threshold, so no tree grows with the rows.

Rows are dealt to trees by a hash of the id and taken in the order of that hash; then trees are merged in
rounds, a few at a time, in the order of their numbers. Neither depends on how rows are partitioned, so
labels do not, either.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kohorta.operators.dense import matrix, squared_distances
from kohorta.session import written

#: Largest radius of a subcluster, and entries of a node.
THRESHOLD = 0.5
BRANCHING = 50
#: Subclusters that a tree may have.
MAX_LEAVES = 500
#: Rows of a tree of the first round (about, by hash), and trees that a task of a later round merges.
TREE_ROWS = 8_192
MERGED_TREES = 8


class _Node:
    __slots__ = ("n", "total", "square", "children", "size")

    def __init__(self, dims: int, branching: int, leaf: bool):
        self.n = np.zeros(branching + 1)
        self.total = np.zeros((branching + 1, dims))
        self.square = np.zeros(branching + 1)
        self.children: list[_Node] | None = None if leaf else []
        self.size = 0

    def put(self, n: float, total: np.ndarray, square: float, child: _Node | None = None) -> None:
        i = self.size
        self.n[i], self.total[i], self.square[i] = n, total, square
        if child is not None:
            self.children.append(child)
        self.size += 1

    def summed(self) -> tuple[float, np.ndarray, float]:
        m = self.size
        return self.n[:m].sum(), self.total[:m].sum(axis=0), self.square[:m].sum()


class FeatureTree:
    """Clustering features of weighted points, at most ``max_leaves`` of them."""

    def __init__(self, dims: int, threshold: float = THRESHOLD, branching: int = BRANCHING, max_leaves: int = MAX_LEAVES):
        if branching < 2 or max_leaves < 1:
            raise ValueError("a node has two entries at least, a tree one subcluster")
        self.dims, self.threshold, self.branching, self.max_leaves = dims, threshold, branching, max_leaves
        self._clear()

    def _clear(self) -> None:
        self.root, self.leaves = _Node(self.dims, self.branching, leaf=True), 0

    def insert(self, n: float, total: np.ndarray, square: float) -> None:
        """Add a clustering feature; a row is (1, row, squared length)."""
        self._add(n, total, square)
        while self.leaves > self.max_leaves:
            self._rebuild()

    def _add(self, n: float, total: np.ndarray, square: float) -> None:
        halves = self._down(self.root, n, total, square)
        if halves:
            self.root = _Node(self.dims, self.branching, leaf=False)
            for half in halves:
                self.root.put(*half.summed(), half)

    def _down(self, node: _Node, n: float, total: np.ndarray, square: float) -> tuple[_Node, _Node] | None:
        """Add below a node; the two nodes that take its place if it was full."""
        m = node.size
        if m:
            apart = node.total[:m] / node.n[:m, None] - total / n
            i = int(np.einsum("ij,ij->i", apart, apart).argmin())
        if node.children is None:
            if m:
                both = node.n[i] + n
                middle = (node.total[i] + total) / both
                if (node.square[i] + square) / both - middle @ middle <= self.threshold**2 + 1e-12:
                    node.n[i], node.square[i] = both, node.square[i] + square
                    node.total[i] += total
                    return None
            node.put(n, total, square)
            self.leaves += 1
        else:
            halves = self._down(node.children[i], n, total, square)
            if halves is None:
                node.n[i] += n
                node.total[i] += total
                node.square[i] += square
                return None
            node.children[i] = halves[0]
            node.n[i], node.total[i], node.square[i] = halves[0].summed()
            node.put(*halves[1].summed(), halves[1])
        return self._split(node) if node.size > self.branching else None

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        m = node.size
        means = node.total[:m] / node.n[:m, None]
        d2 = squared_distances(means, means)
        a, b = np.unravel_index(d2.argmax(), d2.shape)
        near = d2[a] <= d2[b]
        near[a], near[b] = True, a == b
        if near.all():  # all entries on one place
            near[m // 2 :] = False
        halves = []
        for side in (near, ~near):
            half = _Node(self.dims, self.branching, leaf=node.children is None)
            for i in np.flatnonzero(side):
                half.put(node.n[i], node.total[i], node.square[i], None if node.children is None else node.children[i])
            halves.append(half)
        return halves[0], halves[1]

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, total, square) of the subclusters, in the order of the leaves."""
        found: list[_Node] = []

        def walk(node: _Node) -> None:
            if node.children is None:
                found.append(node)
            else:
                for child in node.children:
                    walk(child)

        walk(self.root)
        return (
            np.concatenate([f.n[: f.size] for f in found]),
            np.concatenate([f.total[: f.size] for f in found]),
            np.concatenate([f.square[: f.size] for f in found]),
        )

    def _rebuild(self) -> None:
        """Insert the subclusters again under a threshold at which about half of them should join another."""
        n, total, square = self.features()
        means = total / n[:, None]
        d2 = squared_distances(means, means)
        np.fill_diagonal(d2, np.inf)
        other = d2.argmin(axis=1)
        both = n + n[other]
        middle = (total + total[other]) / both[:, None]
        joined = np.sqrt(np.maximum((square + square[other]) / both - (middle * middle).sum(axis=1), 0.0))
        self.threshold = max(float(np.median(joined)), self.threshold * 1.05, 1e-12)
        self._clear()
        for i in range(len(n)):
            self._add(n[i], total[i], square[i])


def _packed(tree: FeatureTree) -> bytes:
    n, total, square = tree.features()
    return np.concatenate([n[:, None], square[:, None], total], axis=1).tobytes()


def _tree_table(number: int, tree: FeatureTree) -> pa.Table:
    return pa.table({"tree": pa.array([number], pa.int64()), "threshold": [tree.threshold], "features": pa.array([_packed(tree)], pa.binary())})


def birch_subclusters(
    points: DataFrame,
    threshold: float = THRESHOLD,
    branching: int = BRANCHING,
    max_leaves: int = MAX_LEAVES,
    tree_rows: int = TREE_ROWS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(sizes, centroids, threshold in the end) of the subclusters of all rows (id, features).

    An empty table has no subclusters.
    """
    rows = points.count()
    if not rows:
        return np.zeros(0), np.zeros((0, 0)), threshold
    count = max(1, math.ceil(rows / tree_rows))
    schema = "tree LONG, threshold DOUBLE, features BINARY"

    def grow(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by([("spread", "ascending"), ("order", "ascending")])
        x = matrix(own["features"], own["id"])
        tree = FeatureTree(x.shape[1], threshold, branching, max_leaves)
        for row, square in zip(x, (x * x).sum(axis=1)):
            tree.insert(1.0, row, square)
        return _tree_table(key[0].as_py(), tree)

    def merge(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("tree")
        tree = FeatureTree(dims, max(own["threshold"].to_pylist()), branching, max_leaves)
        for data in own["features"].to_pylist():
            for f in np.frombuffer(data, np.float64).reshape(-1, dims + 2):
                tree.insert(f[0], f[2:], f[1])
        return _tree_table(key[0].as_py(), tree)

    dims = points.select(F.size("features")).first()[0]
    spread = F.xxhash64(F.lit(17), "id")
    dealt = points.select("id", "features", spread.alias("spread"), F.xxhash64("features").alias("order"), F.pmod(spread, F.lit(count)).alias("tree"))
    trees = written(dealt.groupBy("tree").applyInArrow(grow, schema), "birch-trees")
    while count > 1:
        joined = trees.withColumn("into", F.floor(F.col("tree") / MERGED_TREES).cast("bigint")).groupBy("into")
        trees = written(joined.applyInArrow(merge, schema), "birch-trees")
        count = math.ceil(count / MERGED_TREES)
    last = trees.first()
    parts = np.frombuffer(bytes(last["features"]), np.float64).reshape(-1, dims + 2)
    return parts[:, 0], parts[:, 2:] / parts[:, :1], last["threshold"]
