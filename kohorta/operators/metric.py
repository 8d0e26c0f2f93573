"""DBSCAN of points with many dimensions, by distances alone.

A grid's neighbouring cells grow exponentially with dimensions. Here points go to the nearest of a few
pivots, which are points themselves, and cells with many points are cut again by pivots of their own: a
tree, whose nodes know their pivot and the distance of their farthest point. Every point has one home
leaf. A search for what lies within a margin of a point descends the tree and leaves out all cells that
are too far by the triangle inequality, so each pair of neighbours meets in one home leaf.

A node whose points all lie within half of ``eps`` of its pivot, and that has enough of them, is dense:
its points are core points of one cluster, and none of its pairs is looked at. Only points outside of
dense nodes search for themselves. Whether two dense nodes touch is settled on pivots where they decide,
and by points only between nodes that all other links leave apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kohorta.operators.dense import exact_squares, matrix, rough_squares
from kohorta.operators.density import NOISE, connected_components
from kohorta.plans.skew import spread_join
from kohorta.session import written

#: Cells with more distinct points than this are cut, into at most ``FANOUT`` cells, and no more of them
#: than twice what would hold the points. A point that no bound rules out is sent to each cell it may be near.
CELL_POINTS = 8192
FANOUT = 64
#: Points that meet the pivots, cells or points of one cell in a group.
ROOM_POINTS = 2048
#: Differences that a task holds at a time.
BLOCK_VALUES = 4_000_000
#: Bounds are widened by this much, so rounding cannot rule out a neighbour.
SLACK = 1e-9


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    return matrix(column) if len(column) else np.empty((0, 0))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances from differences: exact enough to be compared with ``eps``."""
    out = np.empty((len(x), len(y)))
    step = max(1, BLOCK_VALUES // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = ((x[at : at + step, None] - y[None]) ** 2).sum(-1)
    return out


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances that the true ones are not below and not above, from a product."""
    rounding = 4.0 * (x.shape[1] + 8) * 2.0**-53
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    d2 = (-2.0 * x) @ y.T
    d2 += xx[:, None]
    d2 += yy
    off = (rounding * (xx + yy.max(initial=0.0)))[:, None]
    return np.sqrt(np.maximum(d2 - off, 0.0)), np.sqrt(np.maximum(d2 + off, 0.0))


def _meet(many: DataFrame, few: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` on up to about ``ROOM_POINTS`` rows of a node in ``many`` and all rows of that node in ``few``.

    A node's rows in ``many`` may be any number; they are dealt by a hash of their ids. Those in ``few`` are
    as many as a cell has points or children at most, and go to each of the node's rooms.
    """
    counts = many.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROOM_POINTS)).cast("int").alias("rooms"))
    counts = written(counts, "metric-rooms")
    left = many.join(counts, "node").withColumn("room", F.pmod(F.xxhash64("id"), F.col("rooms")).cast("int"))
    right = few.join(counts, "node").withColumn("room", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1))).drop("rooms")
    # New names for the same columns: both sides may come from one table.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy("node", "room").cogroup(right.groupBy("node", "room")).applyInArrow(fn, schema)


def _deal(points: pa.Table, pivots: pa.Table) -> pa.Table:
    """Each point's nearest pivot; of equally near ones the first."""
    pivots = pivots.sort_by("child")
    if not len(points) or not len(pivots):
        return points.select(["node", "id", "w", "v", "dense"]).slice(0, 0).add_column(
            1, "parent", pa.array([], pa.string())
        ).add_column(6, "r", pa.array([], pa.float64()))
    d2 = _squares(_rows(points["v"]), _rows(pivots["v"]))
    child = d2.argmin(axis=1)
    parent = points["node"].combine_chunks()
    names = pa.array([f"{p}.{c}" for p, c in zip(parent.to_pylist(), child.tolist())], pa.string())
    r = pa.array(np.sqrt(d2[np.arange(len(child)), child]))
    return pa.table({"node": names, "parent": parent, "id": points["id"], "w": points["w"], "v": points["v"], "dense": points["dense"], "r": r})


class _Tree:
    """``homes``: every point with its leaf as ``node``; ``levels``: the cells made in each round.

    homes: (node, id, w, v, dense); levels: (parent, node, n, w, radius, v). ``dense`` names the first
    dense node on the way from the root, and v is a cell's pivot.
    """

    def __init__(self, points: DataFrame, eps: float, min_samples: int):
        self.id_type = points.schema["id"].dataType.simpleString()
        self.levels: list[DataFrame] = []
        leaves: list[DataFrame] = []
        placed = points.select("node", "id", "w", "v", F.lit(None).cast("string").alias("dense"))
        cells = points.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        while True:
            sized = written(spread_join(placed, cells.select("node", "n"), ["node"]), "metric-placed")
            leaves.append(sized.where(F.col("n") <= CELL_POINTS).drop("n"))
            large = sized.where(F.col("n") > CELL_POINTS)
            if large.isEmpty():
                break
            placed, cells = self._cut(large, eps, min_samples)
        homes = leaves[0]
        for more in leaves[1:]:
            homes = homes.unionByName(more)
        self.homes = homes

    def _cut(self, large: DataFrame, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
        """Points of large cells dealt to new ones, and the new cells.

        Pivots are the first points by a hash that a cell's size keeps to about twice ``FANOUT`` of them,
        so no list grows with its cell. Points are distinct, so two pivots part a cell.
        """
        level = len(self.levels)
        hashed = F.abs(F.xxhash64(F.lit(level), "id") % F.col("n"))
        drawn = large.where(hashed < 2 * FANOUT).withColumn("h", F.xxhash64(F.lit(level), F.lit(1), "id"))
        fan = F.least(F.lit(FANOUT), F.ceil(2 * F.first("n") / F.lit(CELL_POINTS)).cast("int"))
        lists = drawn.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "id", "v"))), F.lit(1), fan).alias("pivots"))
        pivots = lists.select("node", F.posexplode("pivots").alias("child", "pivot")).select("node", "child", F.col("pivot.v").alias("v"))
        schema = f"node string, parent string, id {self.id_type}, w bigint, v array<double>, dense string, r double"
        dealt = written(_meet(large.drop("n"), written(pivots, "metric-pivots"), _deal, schema), "metric-dealt")
        cells = dealt.groupBy("parent", "node").agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.max("r").alias("radius"), F.min_by("v", F.struct("r", "id")).alias("v")
        )
        cells = written(cells, "metric-cells")
        self.levels.append(cells)
        tight = (F.col("radius") <= eps / 2 * (1 - SLACK)) & (F.col("w") >= min_samples)
        marks = cells.select("node", F.when(tight, F.col("node")).alias("own"))
        marked = spread_join(dealt, marks, ["node"])
        return marked.select("node", "id", "w", "v", F.coalesce("dense", "own").alias("dense")), cells

    def search(self, searchers: DataFrame) -> DataFrame:
        """(node, id, v, reach, d, inside): leaves that may hold points within ``reach`` of a searcher.

        ``searchers`` are (node, id, v, reach) with the root of their block as node. ``d`` is the distance
        of the leaf's pivot, or a little more, ``inside`` says that the whole leaf is within reach.
        """
        schema = f"node string, id {self.id_type}, v array<double>, reach double, d double, inside boolean"
        front = searchers.withColumn("d", F.lit(None).cast("double")).withColumn("inside", F.lit(False))
        found: DataFrame | None = None
        for cells in self.levels:
            parents = cells.select(F.col("parent").alias("node")).distinct()
            parents = written(parents, "metric-parents")
            there = front.join(parents, "node", "left_anti")
            found = there if found is None else found.unionByName(there)
            children = cells.select(F.col("parent").alias("node"), F.col("node").alias("child"), "radius", "v")
            inner = front.join(parents, "node", "left_semi").select("node", "id", "v", "reach")
            front = written(_meet(inner, children, _descend, schema), "metric-front")
        return front if found is None else found.unionByName(front)


def _descend(searchers: pa.Table, cells: pa.Table) -> pa.Table:
    """The cells that may hold a point within reach of a searcher.

    A point within reach is no farther from the searcher's side of its own cell than the radius allows;
    and since it is nearer to its own pivot than to any other, its pivot is at most two reaches farther
    from the searcher than the searcher's nearest pivot.
    """
    if not len(searchers) or not len(cells):
        q = c = np.empty(0, np.int64)
        d = inside = np.empty((0, 0))
    else:
        least, d = _bounds(_rows(searchers["v"]), _rows(cells["v"]))
        reach, radius = np.asarray(searchers["reach"])[:, None], np.asarray(cells["radius"])[None]
        bound = np.minimum(radius + reach, d.min(axis=1)[:, None] + 2 * reach)
        inside = d + radius <= reach * (1 - SLACK)
        q, c = np.nonzero(least <= bound * (1 + SLACK))
    return pa.table(
        {
            "node": cells["child"].take(c),
            "id": searchers["id"].take(q),
            "v": searchers["v"].take(q),
            "reach": searchers["reach"].take(q),
            "d": pa.array(d[q, c] if len(q) else [], pa.float64()),
            "inside": pa.array(inside[q, c] if len(q) else [], pa.bool_()),
        }
    )


def _near(searchers: pa.Table, homes: pa.Table, eps: float) -> np.ndarray:
    """Which points are within ``eps``: by rough distances where they decide, by differences elsewhere."""
    near = np.zeros((len(searchers), len(homes)), bool)
    if not len(searchers) or not len(homes):
        return near
    x, y = _rows(searchers["v"]), _rows(homes["v"])
    step = max(1, BLOCK_VALUES // len(y))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d2, off, unit = rough_squares(part, y)
        limit = eps * eps / unit
        # The limit itself is rounded when it is compared.
        low, high = (((limit + s * off.astype(float)) * (1 + s * 1e-6)).astype(np.float32)[:, None] for s in (-1, 1))
        near[at : at + step] = d2 < low
        i, j = np.nonzero((d2 >= low) & (d2 <= high))
        near[at + i, j] = exact_squares(part, y, i, j, BLOCK_VALUES) <= eps * eps
    return near


def _around(eps: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(searchers: pa.Table, homes: pa.Table) -> pa.Table:
        near, w = _near(searchers, homes, eps), np.asarray(homes["w"], np.int64)
        weight = np.concatenate([near[at : at + 256] @ w for at in range(0, len(near), 256)] or [np.zeros(0, np.int64)])
        return pa.table({"id": searchers["id"], "around": pa.array(weight, pa.int64())})

    return run


def _links(eps: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Enough of the links between core searchers and the nodes of a leaf to connect what they connect."""

    def run(searchers: pa.Table, homes: pa.Table) -> pa.Table:
        near = _near(searchers, homes, eps)
        new, free = np.ones(near.shape[0], bool), np.ones(near.shape[1], bool)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for start in np.flatnonzero(near.any(axis=1)):
            if not new[start]:
                continue
            front = np.array([start])
            while len(front):  # a spanning tree, in turn by searchers and by homes
                new[front] = False
                places = np.flatnonzero(free)
                reached = near[np.ix_(front, places)]
                at = np.flatnonzero(reached.any(axis=0))
                found = places[at]
                pairs.append((front[reached[:, at].argmax(axis=0)], found))
                free[found] = False
                others = np.flatnonzero(new)
                reached = near[np.ix_(others, found)]
                at = np.flatnonzero(reached.any(axis=1))
                front = others[at]
                pairs.append((front, found[reached[at].argmax(axis=1)] if len(at) else front))
        q, h = (np.concatenate([p[side] for p in pairs] or [np.empty(0, np.int64)]) for side in (0, 1))
        return pa.table({"a": searchers["id"].take(q), "b": homes["label"].take(h)})

    return run


def _smallest(eps: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(searchers: pa.Table, homes: pa.Table) -> pa.Table:
        near = _near(searchers, homes, eps)
        names = homes["label"].to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        first = near[:, order].argmax(axis=1) if len(order) else np.empty(len(near), np.int64)
        hit = [bool(len(order)) and bool(near[i, order[f]]) for i, f in enumerate(first)]
        kind = searchers.schema.field("id").type
        return pa.table(
            {"id": searchers["id"], "label": pa.array([names[order[f]] if h else None for f, h in zip(first, hit)], kind)}
        )

    return run


def _touch(eps: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A link for a pair of leaves of dense nodes, of which some points are near."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _near(left, right, eps).any()
        return pa.table({"a": left["a"].slice(0, int(found)), "b": left["b"].slice(0, int(found))})

    return run


def _dense_links(tree: _Tree, homes: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between dense nodes that their pivots prove, and pairs of leaves that they leave open.

    ``homes`` have the node's id as ``label``. Pairs that are not open and have no link are apart.
    """
    cells = tree.levels[0]
    for more in tree.levels[1:]:
        cells = cells.unionByName(more)
    leaves = homes.where("dense is not null").groupBy("node", "blk", "label").agg(F.min("id").alias("id"))
    leaves = written(leaves.join(cells.select("node", "radius", "v"), "node"), "metric-leaves")
    searchers = leaves.select(F.col("blk").alias("node"), "id", "v", (F.col("radius") + eps).alias("reach"))
    met = tree.search(searchers).select("node", "id", "d")
    own = leaves.select("id", F.col("label").alias("a"), F.col("node").alias("leaf"))
    other = leaves.select("node", F.col("label").alias("b"))
    pairs = written(met.join(own, "id").join(other, "node").where("a < b"), "metric-leaf-pairs")
    linked = pairs.where(F.col("d") <= eps * (1 - SLACK)).select("a", "b").distinct()
    return linked, pairs.where(F.col("d") > eps * (1 - SLACK)).select("a", "b", "leaf", "node")


def _nodes_touching(homes: DataFrame, open_pairs: DataFrame, labels: DataFrame, eps: float) -> DataFrame:
    """Links of open pairs of leaves whose nodes are still in different components."""
    side = lambda name: labels.toDF(name, f"c{name}")
    apart = open_pairs.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b", "leaf", "node")
    apart = written(apart.withColumn("pair", F.concat_ws("|", "leaf", "node")), "metric-apart")
    left = apart.select("pair", "a", "b", F.col("leaf").alias("node")).join(homes.select("node", "v"), "node")
    right = apart.select("pair", "node").join(homes.select("node", "v"), "node").select(F.col("pair").alias("pair"), F.col("v").alias("v"))
    id_type = homes.schema["id"].dataType.simpleString()
    grouped = left.groupBy("pair").cogroup(right.groupBy("pair"))
    return grouped.applyInArrow(_touch(eps), f"a {id_type}, b {id_type}")


def dbscan_metric(
    df: DataFrame, features: str, eps: float, min_samples: int, block: Sequence[str] = (), key: str = "id"
) -> DataFrame:
    """(key, cluster): as :func:`kohorta.operators.density.dbscan`, for an array column of any length.

    Rows are compared inside equal ``block`` columns only. Equal rows are one weighted point. A row with
    a null vector, or one with a null or non-finite value, is noise and nobody's neighbour. Work follows
    the cells that the triangle inequality cannot rule out: few if points form groups narrow against
    their distances, all if ``eps`` is near the usual distance of two points.
    """
    flags: Column = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in block]) if block else F.lit("")
    # In hexadecimal, a block's name has no dot, which begins the numbers of its cells.
    rows = df.select(F.col(key).alias("id"), F.hex(flags).alias("blk"), F.col(f"`{features}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    collapsed = whole.groupBy("blk", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    points = written(collapsed, "metric-points")
    tree = _Tree(points.withColumn("node", F.col("blk")), eps, min_samples)
    id_type = tree.id_type
    homes = written(tree.homes.withColumn("blk", F.substring_index("node", ".", 1)), "metric-homes")

    # Points outside of dense nodes: how much lies around them?
    sparse = homes.where("dense is null").select(F.col("blk").alias("node"), "id", "v", F.lit(float(eps)).alias("reach"))
    met = written(tree.search(sparse), "metric-met")
    weights = homes.groupBy("node").agg(F.sum("w").alias("around"))
    whole_leaves = met.where("inside").join(written(weights, "metric-weights"), "node").select("id", "around")
    counted = _meet(met.where("not inside").select("node", "id", "v"), homes.select("node", "w", "v"), _around(eps), f"id {id_type}, around bigint")
    total = whole_leaves.unionByName(counted).groupBy("id").agg(F.sum("around").alias("around"))
    core = written(total.where(F.col("around") >= min_samples).select("id"), "metric-core")

    # Nodes of the graph: dense nodes by their smallest id, other core points by their own.
    names = homes.where("dense is not null").groupBy("dense").agg(F.min("id").alias("label"))
    dense_homes = spread_join(homes.where("dense is not null"), names, ["dense"]).select("node", "blk", "id", "w", "v", "dense", "label")
    core_homes = homes.where("dense is null").join(core, "id", "left_semi").withColumn("label", F.col("id"))
    graph = written(dense_homes.unionByName(core_homes.select(*dense_homes.columns)), "metric-graph")
    nodes = written(graph.select(F.col("label").alias("node")).distinct(), "metric-nodes")

    searching = written(met.join(core, "id", "left_semi").select("node", "id", "v"), "metric-searching")
    edges = _meet(searching, graph.select("node", "v", "label"), _links(eps), f"a {id_type}, b {id_type}")
    edges = written(edges.distinct(), "metric-links")
    if tree.levels:
        proved, open_pairs = _dense_links(tree, graph, eps)
        edges = written(edges.union(proved), "metric-links")
        labels = connected_components(nodes, edges)
        more = written(_nodes_touching(graph, open_pairs, labels, eps), "metric-more")
        if not more.isEmpty():
            labels = connected_components(nodes, edges.union(more))
    else:
        labels = connected_components(nodes, edges)
    labelled = spread_join(graph.withColumnRenamed("label", "own"), labels.toDF("own", "label"), ["own"])
    labelled = written(labelled.select("node", "id", "v", "label"), "metric-labelled")

    rest = met.join(core, "id", "left_anti").select("node", "id", "v")
    border = _meet(rest, labelled.select("node", "v", "label"), _smallest(eps), f"id {id_type}, label {id_type}")
    border = border.where("label is not null").groupBy("id").agg(F.min("label").alias("label"))
    found = written(labelled.select("id", "label").unionByName(border), "metric-found")
    by_point = points.select("blk", "v", "id").join(found, "id", "left").select("blk", "v", "label")
    clusters = rows.join(written(by_point, "metric-by-point"), ["blk", "v"], "left")
    return clusters.select(F.col("id").alias(key), F.coalesce("label", F.lit(NOISE)).alias("cluster"))
