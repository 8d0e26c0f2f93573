"""DBSCAN as Spark jobs: exact, and never a pair of points per neighbourhood.

Points are cut into grid cells so small that all points of a cell are neighbours. A cell with enough
points makes all of them core points without looking at one pair; only points of sparse cells are
compared with the cells around them. Core points of a cell share a cluster, so clusters are the
connected components of cells, and whether two cells touch is settled on bounding boxes that are
refined only where they do not decide.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kohorta.plans.skew import spread_join
from kohorta.session import written

NOISE = -1
#: Cell pairs with at most this many point pairs are compared point by point.
DIRECT_PAIRS = 4096
MAX_ROUNDS = 64


class _Grid:
    """Column names and expressions for ``dims`` coordinates and a radius."""

    def __init__(self, dims: int, eps: float):
        self.dims, self.eps = dims, eps
        # A little below eps / sqrt(dims), so rounding cannot part two points of a cell.
        self.side = eps / math.sqrt(dims) * (1 - 1e-9)
        self.x = [f"x{i}" for i in range(dims)]
        self.c = [f"c{i}" for i in range(dims)]
        self.key = ["blk", *self.c]
        reach = math.ceil(eps / self.side)
        self.offsets = [
            o
            for o in itertools.product(range(-reach, reach + 1), repeat=dims)
            if sum((max(abs(v) - 1, 0) * self.side) ** 2 for v in o) <= eps * eps
        ]

    def cells(self, level: int = 0) -> list[Column]:
        return [F.floor(F.col(x) / F.lit(self.side / 2**level)).cast("long") for x in self.x]

    def near(self, left: str, right: str) -> Column:
        """Is the point (left.x0, ...) within eps of (right.x0, ...)."""
        return F.expr(" + ".join(f"({left}{x} - {right}{x}) * ({left}{x} - {right}{x})" for x in self.x)) <= self.eps**2

    def probes(self, points: DataFrame, offsets) -> DataFrame:
        """A copy of each point for every cell it may have neighbours in, its own columns as q*."""
        moves = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])
        moved = points.withColumn("_o", F.explode(moves))
        target = [(F.col(c) + F.col("_o")[i]).alias(c) for i, c in enumerate(self.c)]
        own = [F.col(x).alias(f"q{x}") for x in self.x]
        return moved.select("blk", *target, *own, F.col("id").alias("qid"))


def _sparse_neighbours(grid: _Grid, probing: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (qid, point) within eps, for probing points that lie in sparse cells.

    A cell has fewer than ``min_samples`` probing points, so a point meets a bounded number of them
    and the work is linear in the points; the caller aggregates the pairs at once.
    """
    return points.join(grid.probes(probing, grid.offsets), grid.key).where(grid.near("", "q"))


def _boxes(grid: _Grid, points: DataFrame, level: int) -> DataFrame:
    """Per cell and sub-cell: the bounding box, one of its points and how many there are."""
    sub = [c.alias(f"s{i}") for i, c in enumerate(grid.cells(level))]
    lows = [F.min(x).alias(f"lo_{x}") for x in grid.x]
    highs = [F.max(x).alias(f"hi_{x}") for x in grid.x]
    return (
        points.select("node", *grid.x, *sub)
        .groupBy("node", *[f"s{i}" for i in range(grid.dims)])
        .agg(*lows, *highs, F.min_by(F.struct(*grid.x), "x0").alias("rep"), F.count("*").alias("n"))
    )


def _verdict(grid: _Grid) -> Column:
    """True: some points of the boxes are within eps; False: none are; null: not decided."""
    gaps, spans, reps = [], [], []
    for x in grid.x:
        gap = f"greatest(a.lo_{x} - b.hi_{x}, b.lo_{x} - a.hi_{x}, 0D)"
        span = f"greatest(a.hi_{x} - b.lo_{x}, b.hi_{x} - a.lo_{x})"
        rep = f"(a.rep.{x} - b.rep.{x})"
        gaps.append(f"{gap} * {gap}")
        spans.append(f"{span} * {span}")
        reps.append(f"{rep} * {rep}")
    limit = repr(grid.eps**2) + "D"
    return F.expr(
        f"CASE WHEN {' + '.join(reps)} <= {limit} OR {' + '.join(spans)} <= {limit} THEN true "
        f"WHEN {' + '.join(gaps)} > {limit} THEN false END"
    )


def _touching(grid: _Grid, core: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between cells that hold core points within eps of each other.

    Round by round, undecided pairs are split into pairs of sub-cells of half the size; pairs with
    few points are compared directly. Boxes shrink to single points, so every pair is decided.
    """
    half = [o for o in grid.offsets if o > (0,) * grid.dims]
    left = nodes.select("blk", *grid.c, F.col("node").alias("a"))
    moves = F.array(*[F.array(*[F.lit(v) for v in o]) for o in half])
    shifted = left.withColumn("_o", F.explode(moves)).select(
        "blk", "a", *[(F.col(c) + F.col("_o")[i]).alias(c) for i, c in enumerate(grid.c)]
    )
    pairs = shifted.join(nodes.select(*grid.key, F.col("node").alias("b")), grid.key).select("a", "b")
    subs = [f"s{i}" for i in range(grid.dims)]
    open_pairs, edges, level = written(pairs, "dbscan-pairs"), None, 0
    while level < MAX_ROUNDS:
        involved = open_pairs.select(F.col("a").alias("node")).union(open_pairs.select("b")).distinct()
        boxes = _boxes(grid, core.join(involved, "node", "left_semi"), level)
        a, b = boxes.alias("a"), boxes.alias("b")
        if level == 0:
            met = open_pairs.join(a, F.col("a.node") == F.col("a")).join(b, F.col("b.node") == F.col("b"))
        else:
            same_a = [F.shiftright(F.col(f"a.{s}"), 1) == F.col(f"a_{s}") for s in subs]
            same_b = [F.shiftright(F.col(f"b.{s}"), 1) == F.col(f"b_{s}") for s in subs]
            met = open_pairs.join(a, [F.col("a.node") == F.col("a"), *same_a]).join(
                b, [F.col("b.node") == F.col("b"), *same_b]
            )
        judged = written(
            met.select(
                F.col("a"),
                F.col("b"),
                *[F.col(f"a.{s}").alias(f"a_{s}") for s in subs],
                *[F.col(f"b.{s}").alias(f"b_{s}") for s in subs],
                (F.col("a.n") * F.col("b.n")).alias("work"),
                _verdict(grid).alias("near"),
            ),
            "dbscan-judged",
        )
        yes = judged.where("near").select("a", "b").distinct()
        unknown = judged.where("near IS NULL").join(yes, ["a", "b"], "left_anti")
        direct = _direct(grid, core, unknown.where(F.col("work") <= DIRECT_PAIRS), level)
        found = written(yes.union(direct).distinct(), "dbscan-edges")
        edges = found if edges is None else edges.union(found)
        open_pairs = written(
            unknown.where(F.col("work") > DIRECT_PAIRS).join(found, ["a", "b"], "left_anti").drop("work", "near"),
            "dbscan-open",
        )
        if open_pairs.isEmpty():
            return edges
        level += 1
    raise RuntimeError("bounding boxes did not decide all cell pairs")


def _direct(grid: _Grid, core: DataFrame, pairs: DataFrame, level: int) -> DataFrame:
    """Pairs of sub-cells decided point by point; each has at most ``DIRECT_PAIRS`` point pairs."""
    subs = [c.alias(f"s{i}") for i, c in enumerate(grid.cells(level))]
    points = core.select("node", *grid.x, *subs)
    names = [f"s{i}" for i in range(grid.dims)]
    p = points.select(F.col("node").alias("a"), *[F.col(s).alias(f"a_{s}") for s in names], *grid.x)
    q = points.select(
        F.col("node").alias("b"), *[F.col(s).alias(f"b_{s}") for s in names], *[F.col(x).alias(f"q{x}") for x in grid.x]
    )
    met = pairs.join(p, ["a", *[f"a_{s}" for s in names]]).join(q, ["b", *[f"b_{s}" for s in names]])
    return met.where(grid.near("", "q")).select("a", "b").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component.

    In every round a label is offered across each edge both to the neighbour and to the node the
    neighbour's label points to, so whole trees are hooked together; then each node takes the label
    of its label, which halves the trees. The rounds grow with the logarithm of the nodes. Each is
    written to the shared folder, which ends its lineage.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "components-edges"
    )
    labels = written(nodes.select("node", F.col("node").alias("label")), "components")
    for _ in range(MAX_ROUNDS):
        ends = both.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
        offers = (
            ends.where("lb < la")
            .select(F.explode(F.array("a", "la")).alias("node"), "lb")
            .groupBy("node")
            .agg(F.min("lb").alias("offer"))
        )
        stepped = labels.join(offers, "node", "left").select(
            "node", "label", F.least("label", F.coalesce("offer", "label")).alias("next")
        )
        seen = Observation()
        stepped = written(stepped.observe(seen, F.count_if(F.col("next") < F.col("label")).alias("moved")), "components-step")
        if seen.get["moved"] == 0:
            return labels
        targets = stepped.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        jumped = stepped.join(targets, "next")
        labels = written(jumped.select("node", F.col("jump").alias("label")), "components")
    raise RuntimeError("components did not settle")


def dbscan(
    df: DataFrame,
    dims: Sequence[str],
    eps: float,
    min_samples: int,
    block: Sequence[str] = (),
    key: str = "id",
) -> DataFrame:
    """(key, cluster): the smallest core row of the cluster, or -1 for noise.

    ``dims`` are continuous columns; the number of cells around a point grows with them, so keep
    them few. ``block`` columns are flags or other whole numbers, which part rows by at least 1 and
    so never link them while ``eps`` < 1; rows are compared inside equal blocks only. A row within
    reach of several clusters, itself not core, joins the one with the smallest label.
    """
    if block and eps >= 1:
        raise ValueError("block columns need eps < 1")
    grid = _Grid(len(dims), eps)
    flags = F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in block]) if block else F.lit("")
    rows = df.select(
        F.col(key).alias("id"), flags.alias("blk"), *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(dims, grid.x)]
    )
    # Equal rows become one weighted point.
    collapsed = rows.groupBy("blk", *grid.x).agg(F.min("id").alias("id"), F.count("*").alias("w"))
    points = written(collapsed.select("*", *[c.alias(n) for c, n in zip(grid.cells(), grid.c)]), "dbscan-points")
    cells = points.groupBy(*grid.key).agg(F.sum("w").alias("cell_w"))
    weighted = spread_join(points, cells, grid.key)
    dense = F.col("cell_w") >= min_samples
    sparse = written(weighted.where(~dense).select("id", "w", "blk", *grid.x, *grid.c), "dbscan-sparse")
    reached = (
        _sparse_neighbours(grid, sparse, points)
        .groupBy(F.col("qid").alias("id"))
        .agg(F.sum("w").alias("around"))
        .where(F.col("around") >= min_samples)
        .select("id")
    )
    columns = ["id", "blk", *grid.x, *grid.c]
    core = weighted.where(dense).select(*columns).union(sparse.join(reached, "id", "left_semi").select(*columns))
    core = written(core, "dbscan-core")
    nodes = core.groupBy(*grid.key).agg(F.min("id").alias("node"), F.count("*").alias("n_rows"))
    nodes = written(nodes, "dbscan-nodes")
    placed = core.join(nodes, grid.key).select("node", *grid.key, *grid.x, "id")
    edges = _touching(grid, placed, nodes)
    labels = connected_components(nodes, edges)
    node_labels = nodes.join(labels, "node").select(*grid.key, "label")
    core_labels = written(core.join(node_labels, grid.key).select(*columns, "label"), "dbscan-labels")
    rest = sparse.join(core.select("id"), "id", "left_anti")
    border = (
        _sparse_neighbours(grid, rest, core_labels.drop("id"))
        .groupBy(F.col("qid").alias("id"))
        .agg(F.min("label").alias("label"))
    )
    found = core_labels.select("id", "label").union(border)
    by_point = points.select("blk", *grid.x, "id").join(found, "id", "left")
    per_point = by_point.select("blk", *grid.x, F.coalesce("label", F.lit(NOISE)).alias("cluster"))
    return spread_join(rows, per_point, ["blk", *grid.x]).select(F.col("id").alias(key), "cluster")
