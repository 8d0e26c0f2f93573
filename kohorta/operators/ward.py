"""Ward's agglomerative merge in rounds of reciprocal nearest neighbours.

Ward's distance is reducible: merging two clusters brings neither closer to a third than the closer of
them was. So all pairs that are each other's nearest neighbour may merge at once, in any round, and the
hierarchy is the one that merges the closest pair at a time. A round finds the nearest neighbours of the
clusters that lost theirs, block against block, and merges every reciprocal pair; about a third of the
clusters goes in each. Once a task can hold the clusters that are left, a bounded number of them, it goes
through the other rounds by itself. A cut into k clusters takes back the k - 1 highest merges, and the others
lead every cluster to the one that stands for it.

Ties go by a hash of the pair, so that many pairs of equal distance are reciprocal at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from kohorta.operators.dense import exact_squares, matrix, rough_sides, squared_distances
from kohorta.session import literal_table, written

#: Least clusters of a block that is compared with another block in one task.
BLOCK_CLUSTERS = 2_048
#: Blocks of a table, unless they would have more than MOST_CLUSTERS.
BLOCKS = 8
MOST_CLUSTERS = 131_072
#: Seekers and nodes whose rough costs a task holds at a time, and pairs that it measures at a time.
TILE = (1024, 1024)
PAIRS = 1 << 20
#: Clusters whose rounds one task goes through, and those that it merges a pair at a time in the end.
TASK_CLUSTERS = 32_768
LAST_CLUSTERS = 500

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def merge_steps(sizes: np.ndarray, means: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(i, j, cost) of every merge of the closest pair by Ward's distance, i < j; i stands for both then.

    Works on a summary of at most a few hundred clusters.
    """
    sizes, means = sizes.astype(float).copy(), means.copy()
    dead = np.zeros(len(sizes), bool)
    cost = squared_distances(means, means) * (sizes[:, None] * sizes[None, :]) / (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(sizes) - 1):
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        i, j = min(i, j), max(i, j)
        yield int(i), int(j), float(cost[i, j])
        total = sizes[i] + sizes[j]
        means[i] = (sizes[i] * means[i] + sizes[j] * means[j]) / total
        sizes[i], dead[j] = total, True
        row = ((means - means[i]) ** 2).sum(axis=1) * sizes * total / (sizes + total)
        row[dead] = np.inf
        row[i] = np.inf
        cost[i, :] = cost[:, i] = row
        cost[j, :] = cost[:, j] = np.inf


def ward_merges(sizes: np.ndarray, means: np.ndarray, ks: Sequence[int]) -> dict[int, np.ndarray]:
    """Labels of weighted points for each number of clusters that is left."""
    owner = np.arange(len(sizes))
    alive, cuts = len(sizes), {}
    steps = merge_steps(sizes, means)
    while True:
        if alive in ks:
            cuts[alive] = np.unique(owner, return_inverse=True)[1]
        if alive <= min(ks):
            return cuts
        i, j, _ = next(steps)
        owner[owner == j] = i
        alive -= 1


def _pair_order(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A number for every unordered pair, much like a random one."""
    low, high = np.minimum(ids, other).astype(np.uint64), np.maximum(ids, other).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (low * _MULTIPLIER ^ (low >> np.uint64(31))) + high
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(27))).view(np.int64)


def _blocks(count: int, block: int) -> int:
    return max(1, min(BLOCKS, math.ceil(count / block)), math.ceil(count / max(block, MOST_CLUSTERS)))


class _Nodes(NamedTuple):
    """Clusters of a block, those that seek first: ids, sizes, means; how many seek."""

    ids: np.ndarray
    n: np.ndarray
    mu: np.ndarray
    seeking: int

    @classmethod
    def ordered(cls, ids: np.ndarray, n: np.ndarray, mu: np.ndarray, seek: np.ndarray) -> _Nodes:
        """By size, so that those of a tile are of about the same."""
        by = np.lexsort((ids, n, ~seek))
        return cls(ids[by], n[by], mu[by], int(seek.sum()))


class _Near(NamedTuple):
    """The nearest node known of each seeker: cost, order of the pair, id."""

    cost: np.ndarray
    pair: np.ndarray
    other: np.ndarray

    @classmethod
    def unknown(cls, count: int) -> _Near:
        return cls(np.full(count, np.inf), np.zeros(count, np.int64), np.zeros(count, np.int64))

    def offer(self, at: np.ndarray, cost: np.ndarray, pair: np.ndarray, other: np.ndarray) -> None:
        """Take what is nearer than the known one; ``at`` may repeat."""
        some = np.flatnonzero(cost <= self.cost[at])
        by = some[np.lexsort((pair[some], cost[some], at[some]))]
        by = by[np.flatnonzero(np.diff(at[by], prepend=-1))]
        seek = at[by]
        better = (cost[by] < self.cost[seek]) | (pair[by] < self.pair[seek])
        seek, by = seek[better], by[better]
        self.cost[seek], self.pair[seek], self.other[seek] = cost[by], pair[by], other[by]


def _meet(a: _Nodes, b: _Nodes, near_a: _Near, near_b: _Near) -> None:
    """Bring the nearest nodes of the seekers of two blocks up to date with each other's nodes.

    All nodes of ``a`` seek. Each pair is measured once for both. Rough costs, less what they may be off by, leave
    out what cannot be the nearest; the rest is measured from differences. If the seekers of ``b`` are ``a``,
    ``near_b`` is to share its memory with ``near_a``.
    """
    if not len(a.ids) or not len(b.ids):
        return
    order = np.argsort(b.ids)
    own = order[np.minimum(np.searchsorted(b.ids, a.ids, sorter=order), len(b.ids) - 1)]
    own[b.ids[own] != a.ids] = -1
    same = b.seeking == len(a.ids) and bool((own == np.arange(len(own))).all())
    x, y, unit = rough_sides(a.mu, b.mu)
    u, w = 1 / a.n, 1 / b.n

    def limits(cost: np.ndarray, widest: np.ndarray) -> np.ndarray:
        return np.nextafter((cost * widest / unit * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))

    for top in range(0, len(a.ids), TILE[0]):
        rows = slice(top, min(top + TILE[0], len(a.ids)))
        for first in range(0, len(b.ids), TILE[1]):
            columns = slice(first, min(first + TILE[1], len(b.ids)))
            if same and columns.stop <= top:
                continue  # met as rows
            least = x[rows] @ y[columns].T
            here = np.flatnonzero((own[rows] >= first) & (own[rows] < columns.stop))
            least[here, own[rows][here] - first] = np.inf

            def measure(i: np.ndarray, j: np.ndarray, top: int = top, first: int = first) -> None:
                # A tie of many nodes may leave any number of pairs, so some go at a time.
                for at in range(0, len(i), PAIRS):
                    p, q = top + i[at : at + PAIRS], first + j[at : at + PAIRS]
                    cost = exact_squares(a.mu, b.mu, p, q) * (a.n[p] * b.n[q]) / (a.n[p] + b.n[q])
                    pair = _pair_order(a.ids[p], b.ids[q])
                    near_a.offer(p, cost, pair, b.ids[q])
                    back = q < b.seeking
                    if back.any():
                        near_b.offer(q[back], cost[back], pair[back], a.ids[p[back]])

            seeking = max(0, min(columns.stop, b.seeking) - first)
            new = np.flatnonzero(np.isinf(near_a.cost[rows]))
            if len(new):
                j = least[new].argmin(axis=1)
                some = np.isfinite(least[new, j])
                measure(new[some], j[some])
            new = np.flatnonzero(np.isinf(near_b.cost[first : first + seeking]))
            if len(new):
                i = least[:, new].argmin(axis=0)
                some = np.isfinite(least[i, new])
                measure(i[some], new[some])
            known = np.where(np.isfinite(near_a.cost[rows]), near_a.cost[rows], -np.inf)
            hit = least <= limits(known, u[rows] + w[columns].max())[:, None]
            if seeking:
                back = near_b.cost[first : first + seeking]
                back = np.where(np.isfinite(back), back, -np.inf)
                hit[:, :seeking] |= least[:, :seeking] <= limits(back, u[rows].max() + w[first : first + seeking])
            some = np.flatnonzero(hit.any(axis=1))
            i, j = np.divmod(np.flatnonzero(hit[some]), hit.shape[1])
            i = some[i]
            bound = known[i]
            if seeking:
                bound = np.maximum(bound, np.append(back, -np.inf)[np.minimum(j, seeking)])
            close = least[i, j] <= limits(bound, u[rows][i] + w[columns][j])
            measure(i[close], j[close])


def _nearest(seekers: DataFrame, nodes: DataFrame, n_seekers: int, n_nodes: int, block: int) -> DataFrame:
    """(cid, other, cost): the nearest other node of every seeker.

    Seekers and nodes are cut into blocks by a hash, packed, and every two blocks meet in a task; a node is sent
    as many times as there are blocks of seekers. Blocks grow with the table, not their number, as long as a task
    can hold two of them. Where nodes tell by ``seek`` that most of them are seekers, two blocks of these meet once.
    """
    rows = columns = _blocks(n_nodes, block)
    sharing = "seek" in nodes.columns and 2 * n_seekers >= n_nodes
    if 2 * n_seekers < n_nodes:  # fewer blocks of seekers, so that nodes are sent to fewer
        rows = max(math.ceil(n_seekers / max(block, MOST_CLUSTERS)), round(rows * math.sqrt(n_seekers / n_nodes / 2)), 1)

    def packed(df: DataFrame, count: int) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                home, seek = np.asarray(batch["home"]), batch["seek"].to_numpy(zero_copy_only=False)
                parts = {"cid": np.asarray(batch["cid"]), "n": np.asarray(batch["n"]), "mu": matrix(batch["mu"])}
                kinds = [(h, s, np.flatnonzero((home == h) & (seek == s))) for h in np.unique(home) for s in (False, True)]
                kinds = [k for k in kinds if len(k[2])]
                yield pa.RecordBatch.from_pydict(
                    {"home": pa.array([h for h, *_ in kinds], pa.int32()), "seek": pa.array([s for _, s, _ in kinds], pa.bool_())}
                    | {name: pa.array([part[at].tobytes() for *_, at in kinds], pa.binary()) for name, part in parts.items()}
                )

        home = F.pmod(F.xxhash64("cid"), F.lit(count)).cast("int")
        return df.select(home.alias("home"), "seek", "cid", "n", "mu").mapInArrow(pack, "home int, seek boolean, cid binary, n binary, mu binary")

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        copies = packed(df, count).select("seek", "cid", "n", "mu", "home", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return copies.toDF("seek", "cid", "n", "mu", own, other)  # columns of its own: both sides may be one table

    def unpacked(side: pa.Table) -> _Nodes:
        def whole(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(part.as_buffer(), kind) for part in side[name]] or [np.empty(0, kind)])

        ids, n = whole("cid", np.int64), whole("n", np.float64)
        sizes = [len(part.as_buffer()) // 8 for part in side["cid"]]
        seek = np.repeat(side["seek"].to_numpy(), sizes).astype(bool)
        return _Nodes.ordered(ids, n, whole("mu", np.float64).reshape(len(ids), -1 if len(ids) else 0), seek)

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = unpacked(left), unpacked(right)
        near_b = _Near.unknown(b.seeking)
        if key[0].as_py() == key[1].as_py() and b.seeking:
            sides = [(a, near_b)]
            near_a = near_b
        else:
            near_a = _Near.unknown(len(a.ids))
            sides = [(a, near_a), (b, near_b)]
        _meet(a, b, near_a, near_b)
        found = {"cid": [], "other": [], "cost": [], "pair": []}
        for side, near in sides:
            known = np.isfinite(near.cost)
            for name, values in (("cid", side.ids[: len(known)]), *near._asdict().items()):
                found[name].append(values[known])
        return pa.table({name: np.concatenate(parts) for name, parts in found.items()})

    shared = F.col("seek") if sharing else F.lit(False)
    left = dealt(seekers.withColumn("seek", F.lit(True)), "r", rows, "c", columns).groupBy("r", "c")
    right = dealt(nodes.withColumn("seek", shared), "c", columns, "r", rows).where("NOT seek OR r <= c").groupBy("r", "c")
    found = left.cogroup(right).applyInArrow(compare, "cid bigint, other bigint, cost double, pair bigint")
    best = found.groupBy("cid").agg(F.min(F.struct("cost", "pair", "other")).alias("b"))
    return best.select("cid", F.col("b.other").alias("other"), F.col("b.cost").alias("cost"))


def _finished(
    ids: np.ndarray, n: np.ndarray, mu: np.ndarray, height: np.ndarray, other: np.ndarray, cost: np.ndarray, turn: int, last: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, height, turn) of all merges of a bounded number of clusters, by the same rounds.

    ``cost`` is nan where the nearest node, ``other``, is not known.
    """
    while len(ids) > max(last, 1):
        seek = np.isnan(cost)
        by = np.lexsort((ids, n, ~seek))
        ids, n, mu, height, other, cost = ids[by], n[by], mu[by], height[by], other[by], cost[by]
        near = _Near.unknown(seeking := int(seek.sum()))
        _meet(_Nodes(ids[:seeking], n[:seeking], mu[:seeking], seeking), _Nodes(ids, n, mu, seeking), near, near)
        other[:seeking], cost[:seeking] = near.other, near.cost
        order = np.argsort(ids)
        at = order[np.searchsorted(ids, other, sorter=order)]
        mutual = other[at] == ids
        i = np.flatnonzero(mutual & (ids < other))
        j = at[i]
        both = n[i] + n[j]
        mean = (n[i][:, None] * mu[i] + n[j][:, None] * mu[j]) / both[:, None]
        top = np.maximum(cost[i], np.maximum(height[i], height[j]))
        yield ids[i], ids[j], top, np.full(len(i), turn)
        stays = ~mutual
        left = np.where(mutual[at], np.nan, cost)
        ids, n, mu, height, other, cost = (
            np.concatenate([old[stays], fresh])
            for old, fresh in ((ids, ids[i]), (n, both), (mu, mean), (height, top), (other, other[i]), (left, np.full(len(i), np.nan)))
        )
        turn += 1
    by = np.argsort(ids)
    ids, top = ids[by], height[by].tolist()
    for k, (i, j, step) in enumerate(merge_steps(n[by], mu[by]) if len(ids) > 1 else ()):
        top[i] = max(step, top[i], top[j])
        yield ids[[i]], ids[[j]], np.array([top[i]]), np.array([turn + k])


def ward_hierarchy(summary: DataFrame, block: int = BLOCK_CLUSTERS, last: int = LAST_CLUSTERS) -> DataFrame:
    """(a, b, height, turn): all merges of the clusters (cid, n, mu); a < b, and a stands for both then.

    A merge is at least as high as those below it. Clusters need distinct ids.
    """
    merge = "a bigint, b bigint, height double, turn int"
    first = [F.lit(0.0).alias("height"), F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("double").alias("cost")]
    nodes = written(summary.select(F.col("cid").cast("bigint"), F.col("n").cast("double"), "mu", *first), "ward-nodes")
    count, turn = nodes.count(), 0
    merges = None
    while count > max(last, TASK_CLUSTERS, 1):
        known = nodes.where("other IS NOT NULL").select("cid", "other", "cost")
        seekers = nodes.where("other IS NULL")
        found = _nearest(seekers, nodes.withColumn("seek", F.col("other").isNull()), seekers.count(), count, block)
        near = written(found.unionByName(known), "ward-nearest")
        # A node merges if the nearest of its nearest is itself, and seeks again if its nearest merges with another.
        beyond = [near.select(F.col("cid").alias(f"cid{i}"), F.col("other").alias(f"other{i}")) for i in (1, 2)]
        chain = near.join(beyond[0], F.col("other") == F.col("cid1")).join(beyond[1], F.col("other1") == F.col("cid2"))
        state = chain.select(
            "cid",
            F.when(F.col("other1") == F.col("cid"), F.least("cid", "other")).alias("into"),
            F.when((F.col("other1") == F.col("cid")) | (F.col("other2") != F.col("other")), F.col("other")).alias("other"),
            "cost",
        )
        tagged = written(nodes.drop("other", "cost").join(state, "cid"), "ward-tagged")
        sides = [
            tagged.where(where).select("into", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "n", "mu", "height", "cost")])
            for s, where in (("a", "into = cid"), ("b", "into <> cid"))
        ]
        both = F.col("n_a") + F.col("n_b")
        mean = F.zip_with("mu_a", "mu_b", lambda x, y: (F.col("n_a") * x + F.col("n_b") * y) / both)
        top = F.greatest("cost_a", "height_a", "height_b")
        met = sides[0].join(sides[1], "into").select(
            F.col("cid_a").alias("a"), F.col("cid_b").alias("b"), both.alias("n"), mean.alias("mu"), top.alias("height")
        )
        met = written(met, "ward-pairs")
        done = met.select("a", "b", "height", F.lit(turn).alias("turn"))
        merges = done if merges is None else merges.unionByName(done)
        stays = tagged.where("into IS NULL").select(
            "cid", "n", "mu", "height", "other", F.when(F.col("other").isNotNull(), F.col("cost")).alias("cost")
        )
        nodes = written(stays.unionByName(met.select(F.col("a").alias("cid"), "n", "mu", "height", *first[1:])), "ward-nodes")
        count, turn = nodes.count(), turn + 1

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [b for b in batches if b.num_rows]
        if rest:
            whole = pa.Table.from_batches(rest)
            ids, n, height = (whole[c].to_numpy() for c in ("cid", "n", "height"))
            other = whole["other"].fill_null(-1).to_numpy()
            cost = whole["cost"].fill_null(float("nan")).to_numpy()
            steps = list(_finished(ids, n, matrix(whole["mu"]), height, other, cost, turn, last))
            if steps:
                a, b, top, turns = (np.concatenate(parts) for parts in zip(*steps))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(top), pa.array(turns, pa.int32())], names=["a", "b", "height", "turn"])

    final = nodes.coalesce(1).mapInArrow(finish, merge)  # at most TASK_CLUSTERS or ``last`` rows
    return final if merges is None else merges.unionByName(final)


def ward_cuts(summary: DataFrame, ks: Sequence[int], block: int = BLOCK_CLUSTERS, last: int = LAST_CLUSTERS) -> DataFrame:
    """(cid, labels): a cut of the hierarchy per k, smallest k first; labels count up with the smallest id.

    With fewer clusters than k, each is one of its own.
    """
    ks = sorted(set(ks))
    merges = written(ward_hierarchy(summary, block, last), "ward-merges")
    order = [F.desc("height"), F.desc("turn"), F.desc("a"), F.desc("b")]
    ranked = merges.orderBy(*order).limit(max(max(ks) - 1, 1)).select("a", "b")  # as many as clusters are wanted
    high = _placed(ranked)
    placed = merges.join(F.broadcast(high), ["a", "b"], "left")
    width = len(ks)
    node = lambda c, i: F.col(c) * width + i
    kept = [
        placed.where(F.coalesce(F.col("place"), F.lit(1 << 30)) >= k - 1).select(node("a", i).alias("a"), node("b", i).alias("b"))
        for i, k in enumerate(ks)
    ]
    edges = kept[0]
    for more in kept[1:]:
        edges = edges.unionByName(more)
    ids = summary.select(F.col("cid").cast("bigint").alias("cid"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    nodes = ids.select((F.col("cid") * width + F.col("i")).alias("node"))
    found = _roots(nodes, edges).withColumn("i", F.pmod("node", F.lit(width)))
    # The labels of a cut are as many as its clusters.
    heads = found.where("node = label").withColumn("number", F.row_number().over(Window.partitionBy("i").orderBy("label")) - 1)
    numbered = found.join(heads.select("label", "number"), "label")
    cuts = numbered.groupBy(F.expr(f"(node - pmod(node, {width})) div {width}").alias("cid")).agg(
        F.sort_array(F.collect_list(F.struct("i", "number"))).alias("cuts")
    )
    return cuts.select("cid", F.transform("cuts", lambda c: c["number"].cast("int")).alias("labels"))


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the node that stands for it after all merges (a, b), which is the smallest of its cluster.

    A node is b of one merge at most, so each follows its own; the ways that are left halve in every round.
    """
    up = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    steps = written(nodes.join(up, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "ward-roots")
    while True:
        seen = Observation()
        above = steps.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = F.count_if(F.col("next") != F.col("label")).alias("moved")
        steps = written(steps.join(above, "label").observe(seen, moved).select("node", F.col("next").alias("label")), "ward-roots")
        if not seen.get["moved"]:
            return steps


def _placed(ranked: DataFrame) -> DataFrame:
    """(a, b, place) of a few ordered rows."""
    rows = [(r["a"], r["b"], i) for i, r in enumerate(ranked.collect())]
    schema = "a bigint, b bigint, place int"
    return literal_table(ranked.sparkSession, rows, schema) if rows else ranked.sparkSession.createDataFrame([], schema)
