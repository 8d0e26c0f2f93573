"""Cluster validity indices and the choice of k.

Rows are (id, features array<double>, labels array<int>): one label per model, so several models are
scored together. Inertia, Davies-Bouldin and Calinski-Harabasz take two aggregations over the rows;
the tables between are one row per cluster. The silhouette that scores models is the one on squared
distances, linear in the rows; the Euclidean one needs all distances and is an operator of its own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kohorta.operators.cluster import fit_labels, matrix, squared_distances, sweep_kmeans
from kohorta.plans.skew import small_table, spread_join
from kohorta.session import literal_table, written

#: Least rows that a task of the exact silhouette holds, if there are as many.
BLOCK_ROWS = 4096
#: Blocks of rows for the exact silhouette, unless they would have more than MOST_ROWS.
BLOCKS = 32
MOST_ROWS = 131_072
#: Rows whose distances to as many others a task of the exact silhouette holds.
TILE = 512
#: Cells that stand for rows in the bounded silhouette, unless the caller names another number.
CELLS = 400
#: Centroid tables up to this size are broadcast, and larger ones are read in blocks of this size.
CENTER_BYTES = 64 << 20
#: Values of the reference sets of the gap statistic that a task makes, at most.
REFERENCE_VALUES = 1 << 22
#: Clusters in a block of the Davies-Bouldin index, on average.
BLOCK_CENTERS = 1024
RANKED = {"davies_bouldin": True, "calinski_harabasz": False, "silhouette": False}


def with_label(points: DataFrame, label: str = "label") -> DataFrame:
    """Rows of one given labelling in the form the indices take."""
    return points.select("id", "features", F.array(F.col(label).cast("int")).alias("labels"))


def drop_noise(points: DataFrame, label: str = "label", noise: int = -1) -> DataFrame:
    return points.where(F.col(label) != noise)


def dimension(points: DataFrame) -> int:
    return points.select(F.size("features")).first()[0]


def _squares(left: str, right: str, dims: int) -> str:
    """Squared distance as a sum of plain terms, which compiles; a lambda over arrays would not."""
    return " + ".join(f"({left}[{i}] - {right}[{i}]) * ({left}[{i}] - {right}[{i}])" for i in range(dims))


def _per_model(points: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(id, features, k, cluster): a row per model; it is aggregated before it is shuffled."""
    names = F.array(*[F.lit(k) for k in ks])
    return points.select("id", "features", F.explode(F.arrays_zip(names.alias("k"), F.col("labels").alias("cluster"))).alias("m")).select(
        "id", "features", F.col("m.k").alias("k"), F.col("m.cluster").alias("cluster")
    )


def centroids(points: DataFrame, ks: Sequence[int], dims: int | None = None) -> DataFrame:
    """(k, cluster, n, mu) of every cluster of every model."""
    dims = dimension(points) if dims is None else dims
    means = F.expr("array(" + ", ".join(f"avg(features[{i}])" for i in range(dims)) + ")")
    return _per_model(points, ks).groupBy("k", "cluster").agg(F.count("*").alias("n"), means.alias("mu"))


def spreads(points: DataFrame, ks: Sequence[int], dims: int | None = None) -> DataFrame:
    """Centroids with ``ss``, squared distance of the members summed, and ``dev``, mean distance."""
    dims = dimension(points) if dims is None else dims
    rows = _per_model(points, ks)
    centers = centroids(points, ks, dims)
    most = max(1, CENTER_BYTES // (8 * (dims + 4)))
    few = small_table(centers, most)
    if few is not None:
        joined = rows.join(few, ["k", "cluster"])
    else:
        joined = spread_join(rows, centers, ["k", "cluster"])
    sums = (
        joined.select("k", "cluster", "n", "mu", F.expr(_squares("features", "mu", dims)).alias("d2"))
        .groupBy("k", "cluster")
        .agg(
            F.first("n").alias("n"),
            F.first("mu").alias("mu"),
            F.sum("d2").alias("ss"),
            F.avg(F.sqrt("d2")).alias("dev"),
        )
    )
    few = small_table(sums, most) if few is not None else None
    return sums if few is None else few


def inertia(stats: DataFrame) -> DataFrame:
    """(k, n_clusters, n, inertia) per model."""
    return stats.groupBy("k").agg(
        F.count("*").alias("n_clusters"), F.sum("n").alias("n"), F.sum("ss").alias("inertia")
    )


def aic_bic(totals: DataFrame, dims: int) -> DataFrame:
    """AIC and BIC per model from its inertia, with clusters x dimensions as parameters."""
    parameters = F.col("n_clusters") * dims
    return totals.select(
        "k",
        "inertia",
        (parameters * 2 + F.col("inertia")).alias("aic"),
        (F.log("n") * parameters + F.col("inertia")).alias("bic"),
    )


class _Centers(NamedTuple):
    """Clusters of one model in a block: label, center, rows, sum of squares, mean distance."""

    code: np.ndarray
    mu: np.ndarray
    n: np.ndarray
    ss: np.ndarray
    dev: np.ndarray


def _center_blocks(stats: DataFrame) -> Iterator[dict[int, _Centers]]:
    """The clusters by model in blocks of bounded size, streamed through the driver one at a time."""
    rows: list = []
    size = 0

    def packed() -> dict[int, _Centers]:
        by_model: dict[int, list] = {}
        for r in rows:
            by_model.setdefault(r["k"], []).append(r)
        return {
            k: _Centers(*(np.array([r[c] for r in own], t) for c, t in zip(("cluster", "mu", "n", "ss", "dev"), (int, *[float] * 4))))
            for k, own in by_model.items()
        }

    for r in stats.select("k", "cluster", "mu", "n", "ss", "dev").orderBy("k", "cluster").toLocalIterator():
        rows.append(r)
        size += 8 * (len(r["mu"]) + 4)
        if size >= CENTER_BYTES:
            yield packed()
            rows, size = [], 0
    if rows:
        yield packed()


def davies_bouldin(stats: DataFrame) -> DataFrame:
    """(k, davies_bouldin): mean over clusters of the worst (dev + dev) / distance to another one.

    The clusters of a model are dealt to blocks by a hash, and every two blocks meet in a task of their
    own, from which one number per cluster comes out. So no task and no driver holds all centroids; work is
    quadratic in the clusters of a model. Clusters on the same centroid do not compare, as if infinitely far.
    """

    def worst(pair: pa.Table) -> pa.Table:
        pair = pair.combine_chunks()
        asks = np.asarray(pair.column("asks"))
        codes, dev = np.asarray(pair.column("cluster")), np.asarray(pair.column("dev"))
        mu = matrix(pair.column("mu").combine_chunks())
        other, other_mu, other_dev = codes[~asks], mu[~asks], dev[~asks]
        out = []
        for i in np.flatnonzero(asks):
            d = np.sqrt(((other_mu - mu[i]) ** 2).sum(axis=1))
            d[(other == codes[i]) | (d == 0)] = np.inf
            out.append(np.where(other == codes[i], -1.0, (dev[i] + other_dev) / d).max(initial=-1.0))
        mine = pair.filter(pa.array(asks)).select(["k", "cluster"])
        return mine.append_column("worst", pa.array(out, pa.float64()))

    slim = stats.select(F.col("k").cast("int").alias("k"), F.col("cluster").cast("int").alias("cluster"), "mu", "dev")
    # Read three times below; the rows behind the centroids are passed once.
    slim = written(slim, "centroids")
    blocks = slim.groupBy("k").agg(F.ceil(F.count("*") / BLOCK_CENTERS).alias("blocks"))
    own, every = F.pmod(F.xxhash64("cluster"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = slim.join(blocks, "k").withColumn("own", own).withColumn("met", every)
    asking = dealt.select("k", F.col("own").alias("a"), F.col("met").alias("b"), "cluster", "mu", "dev", F.lit(True).alias("asks"))
    asked = dealt.select("k", F.col("met").alias("a"), F.col("own").alias("b"), "cluster", "mu", "dev", F.lit(False).alias("asks"))
    pairs = asking.union(asked).groupBy("k", "a", "b")
    per_cluster = pairs.applyInArrow(worst, "k INT, cluster INT, worst DOUBLE").groupBy("k", "cluster").agg(F.max("worst").alias("worst"))
    return per_cluster.groupBy("k").agg(F.avg(F.when(F.col("worst") >= 0, F.col("worst"))).alias("davies_bouldin"))


def calinski_harabasz(stats: DataFrame, dims: int) -> DataFrame:
    """(k, calinski_harabasz): between-cluster over within-cluster variance."""
    mean = F.expr("array(" + ", ".join(f"sum(n * mu[{i}]) / sum(n)" for i in range(dims)) + ")")
    whole = stats.groupBy("k").agg(
        mean.alias("mean"), F.sum("n").alias("total"), F.count("*").alias("clusters"), F.sum("ss").alias("within")
    )
    between = F.sum(F.col("n") * F.expr(_squares("mu", "mean", dims)))
    parts = stats.join(whole, "k").groupBy("k", "total", "clusters", "within").agg(between.alias("between"))
    score = F.try_divide(
        F.col("between") * (F.col("total") - F.col("clusters")), F.col("within") * (F.col("clusters") - 1)
    )
    return parts.select("k", score.alias("calinski_harabasz"))


# ---- silhouette -------------------------------------------------------------------------------


def _exact(points: DataFrame, n_models: int) -> DataFrame:
    """(id, features, labels, w, s): distinct rows, their number of copies, their silhouettes.

    Copies are collapsed first, which is exact and takes most rows of flag-like features away. The
    distinct rows are cut into blocks; a task holds one block and streams all rows past it, keeping
    only the distance sums to each cluster. Blocks grow with the table, not their number, up to what a
    task can hold, so rows are sent a bounded number of times. The work is quadratic in distinct rows by
    definition; ``silhouette_squared`` is the linear index for larger tables.
    """
    # Read three times below.
    distinct = written(points.groupBy("features", "labels").agg(F.min("id").alias("id"), F.count("*").alias("w")), "silhouette-rows")
    size_rows = (
        points.select(F.posexplode("labels").alias("m", "cluster"))
        .groupBy("m", "cluster")
        .agg(F.count("*").alias("n"))
        .orderBy("m", "cluster")
        .collect()
    )
    sizes = [{r["cluster"]: r["n"] for r in size_rows if r["m"] == m} for m in range(n_models)]
    codes = [np.array(sorted(s)) for s in sizes]
    counts = [np.array([s[c] for c in code], dtype=float) for s, code in zip(sizes, codes)]
    # The clusters of all models side by side, a column of distance sums each.
    first = np.concatenate([[0], np.cumsum([len(code) for code in codes])]).astype(int)
    count = distinct.count()
    blocks = max(1, min(BLOCKS, math.ceil(count / BLOCK_ROWS)), math.ceil(count / max(BLOCK_ROWS, MOST_ROWS)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own, held, sums = None, [], None, None

        def finish():
            columns = []
            for m, code in enumerate(codes):
                at = np.searchsorted(code, held["labels"][:, m])
                total, n = sums[:, first[m] : first[m + 1]], counts[m]
                rows = np.arange(len(at))
                inside = total[rows, at] / np.maximum(n[at] - 1, 1)
                mean = total / n
                mean[rows, at] = np.inf
                outside = mean.min(axis=1)
                top = np.maximum(inside, outside)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where((n[at] > 1) & (top > 0) & np.isfinite(outside), (outside - inside) / top, 0.0)
                columns.append(s)
            flat = np.stack(columns, axis=1)
            offsets = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
            scores = pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(held["ids"]), scores], names=["id", "s"])

        def hold():
            x = np.concatenate([o[1] for o in own])
            labels = np.concatenate([o[2] for o in own])
            # A product with these and (y, 1, |y|^2) is the squared distance.
            turned = np.concatenate([-2.0 * x, (x * x).sum(axis=1)[:, None], np.ones((len(x), 1))], axis=1)
            return {"ids": [o[0] for o in own], "turned": turned, "labels": labels}, np.zeros((len(x), first[-1]))

        def add(x, labels, w):
            for start in range(0, len(x), TILE):
                part = slice(start, start + TILE)
                y = np.concatenate([x[part], np.ones((len(x[part]), 1)), (x[part] * x[part]).sum(axis=1)[:, None]], axis=1).T
                member = np.zeros((y.shape[1], first[-1]))
                for m, code in enumerate(codes):
                    member[np.arange(len(member)), first[m] + np.searchsorted(code, labels[part, m])] = w[part]
                for top in range(0, len(sums), TILE):
                    d = held["turned"][top : top + TILE] @ y
                    np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                    sums[top : top + TILE] += d @ member

        def streamed(part):
            return matrix(part.column("features")), matrix(part.column("labels")), np.asarray(part.column("w"), dtype=float)

        for batch in batches:
            blocks_here = np.asarray(batch.column("block"))
            guest = np.asarray(batch.column("guest"))
            edges = np.flatnonzero((np.diff(blocks_here) != 0) | (np.diff(guest) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(blocks_here)]):
                part = batch.slice(lo, hi - lo)
                if blocks_here[lo] != block:
                    if block is not None:
                        if held is None:
                            held, sums = hold()
                            for o in own:
                                add(o[1], o[2], o[3])
                        yield finish()
                    block, own, held, sums = blocks_here[lo], [], None, None
                if guest[lo] == 0:
                    own.append((part.column("id"), *streamed(part)))
                    continue
                if held is None:
                    held, sums = hold()
                    for o in own:
                        add(o[1], o[2], o[3])
                add(*streamed(part))
        if block is not None:
            if held is None:
                held, sums = hold()
                for o in own:
                    add(o[1], o[2], o[3])
            yield finish()

    home = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    copies = (
        distinct.withColumn("home", home)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("guest", (F.col("home") != F.col("block")).cast("int"))
        .select("block", "guest", "id", "features", "labels", "w")
        .repartition(8 * blocks, "block")  # more than blocks, so that few of these share a task
        .sortWithinPartitions("block", "guest")
    )
    id_type = points.schema["id"].dataType.simpleString()
    scores = copies.mapInArrow(stream, f"id {id_type}, s ARRAY<DOUBLE>")
    return distinct.join(scores, "id")


def silhouette_samples(points: DataFrame) -> DataFrame:
    """(id, s) with the silhouette of every row under one labelling."""
    scored = _exact(points, 1).select("features", "labels", F.col("s")[0].alias("s"))
    return spread_join(points, scored, ["features", "labels"]).select("id", "s")


def silhouette_exact(points: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, silhouette): mean Euclidean silhouette of each model, all from the same distances."""
    scored = _exact(points, len(ks))
    means = scored.agg(
        *[(F.sum(F.col("s")[i] * F.col("w")) / F.sum("w")).alias(f"s{i}") for i in range(len(ks))]
    )
    cells = [F.struct(F.lit(k).alias("k"), F.col(f"s{i}").alias("silhouette")) for i, k in enumerate(ks)]
    return means.select(F.inline(F.array(*cells)))


def silhouette_bounded(points: DataFrame, ks: Sequence[int], cells: int = CELLS, seed: int = 37) -> DataFrame:
    """(k, silhouette, error): the mean Euclidean silhouette of each model, to within ``error``.

    Rows are summed up in ``cells`` small cells, each by its rows, mean and variance per label. The mean distance
    of a row to the n rows of a cell with mean mu and variance v lies between D = |x - mu| and
    sqrt(D^2 + v): the first because distance is convex, the second because its square averages to
    D^2 + v. Sums of these bounds over a cluster's cells bound the row's mean distances, and with them its
    silhouette, which rises with the outer distance and falls with the inner one; the exact index lies within the
    stated error of the value. Cells of one row, or of equal rows, are exact, and more cells come closer.

    One pass places the rows, one aggregation sums up the cells and one more pass scores the rows, so
    shuffle grows with tasks and cells, not with pairs. The table of cells, at most ``cells`` times the labels of all
    models, is sent to every task, and refused above CENTER_BYTES.
    """
    spark = points.sparkSession
    models, _ = sweep_kmeans(points.select("id", "features"), [cells], seed, max_iter=5)
    centers = spark.sparkContext.broadcast(models[(0, cells)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, labels = matrix(batch.column("features")), matrix(batch.column("labels")).astype(np.int64)
            cell = np.concatenate([squared_distances(x[at : at + 1024], centers.value).argmin(axis=1) for at in range(0, len(x), 1024)] or [np.empty(0, np.int64)])
            coded = labels * cells + cell[:, None]
            offsets = pa.array(np.arange(0, coded.size + 1, len(ks), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("features"), pa.ListArray.from_arrays(offsets, pa.array(coded.ravel()))], names=["id", "features", "labels"]
            )

    id_type = points.schema["id"].dataType.simpleString()
    frame = points.select("id", "features", "labels")
    placed = written(frame.mapInArrow(place, f"id {id_type}, features ARRAY<DOUBLE>, labels ARRAY<LONG>"), "silhouette-cells")
    dims = dimension(points)
    stats = written(spreads(placed, ks, dims).select("k", "cluster", "n", "mu", "ss"), "silhouette-stats")
    if stats.count() * 8 * (dims + 4) > CENTER_BYTES:
        raise ValueError("the table of cells is too large to send to every task; take fewer cells")
    table: dict[int, tuple] = {}
    found = stats.orderBy("k", "cluster").toPandas()
    for k, own in found.groupby("k"):
        labels = own["cluster"].to_numpy() // cells
        code, of = np.unique(labels, return_inverse=True)
        n = own["n"].to_numpy(float)
        member = np.zeros((len(own), len(code)))
        member[np.arange(len(own)), of] = n
        table[int(k)] = (code, member.sum(axis=0), np.stack(own["mu"].to_numpy()), np.maximum(own["ss"].to_numpy(float) / n, 0.0), member)
    shared = spark.sparkContext.broadcast(table)
    at_model = {k: i for i, k in enumerate(ks)}

    def widths(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        top = np.maximum(inner, outer)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(top > 0, (outer - inner) / top, 0.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(3) for k in shared.value}
        for batch in batches:
            x, coded = matrix(batch.column("features")), matrix(batch.column("labels")).astype(np.int64)
            for at in range(0, len(x), 512):
                rows = x[at : at + 512]
                for k, (code, sizes, mu, v, member) in shared.value.items():
                    own = np.searchsorted(code, coded[at : at + 512, at_model[k]] // cells)
                    d2 = squared_distances(rows, mu)
                    low, high = np.sqrt(d2) @ member, np.sqrt(d2 + v) @ member
                    i = np.arange(len(rows))
                    others = np.maximum(sizes[own] - 1, 1)
                    inner = low[i, own] / others, high[i, own] / others
                    low, high = low / sizes, high / sizes
                    low[i, own] = high[i, own] = np.inf
                    outer = low.min(axis=1), high.min(axis=1)
                    known = (sizes[own] > 1) & np.isfinite(outer[0])
                    s_low, s_high = widths(inner[1], outer[0]), widths(inner[0], outer[1])
                    sums[k] += [s_low[known].sum(), s_high[known].sum(), len(rows)]
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), *(pa.array([v[j] for v in sums.values()], pa.float64()) for j in range(3))],
                names=["k", "low", "high", "n"],
            )

    parts = placed.select("features", "labels").mapInArrow(score, "k INT, low DOUBLE, high DOUBLE, n DOUBLE")
    means = parts.groupBy("k").agg((F.sum("low") / F.sum("n")).alias("low"), (F.sum("high") / F.sum("n")).alias("high"))
    # A tenth of a millionth for the rounding of products.
    return means.select("k", ((F.col("low") + F.col("high")) / 2).alias("silhouette"), ((F.col("high") - F.col("low")) / 2 + 1e-7).alias("error"))


def silhouette_squared(points: DataFrame, ks: Sequence[int], stats: DataFrame | None = None) -> DataFrame:
    """(k, silhouette) with squared distances, linear in the rows and one pass for all models.

    The mean squared distance of a row to a cluster is its squared distance to the centroid plus the
    cluster's own mean squared deviation, so the centroid table says all about the other rows. It is
    taken in blocks; the one block of all but huge tables is summed up in the tasks.
    """
    stats = spreads(points, ks) if stats is None else stats
    place = {k: i for i, k in enumerate(ks)}
    id_type = points.schema["id"].dataType.simpleString()

    def distances(x: np.ndarray, labels: np.ndarray, c: _Centers) -> tuple[np.ndarray, np.ndarray]:
        """Mean squared distance to the own cluster (nan: not in the block; inf: alone), to the nearest other."""
        mean = squared_distances(x, c.mu) + (c.ss / c.n)[None, :]
        at = np.minimum(np.searchsorted(c.code, labels), len(c.code) - 1)
        own, rows = c.code[at] == labels, np.arange(len(x))
        inside = np.where(own, np.where(c.n[at] > 1, mean[rows, at] * c.n[at] / np.maximum(c.n[at] - 1, 1), np.inf), np.nan)
        mean[rows[own], at[own]] = np.inf
        return inside, mean.min(axis=1)

    def widths(inside: np.ndarray, outside: np.ndarray) -> np.ndarray:
        known = np.isfinite(inside) & np.isfinite(outside)
        a, b = np.where(known, inside, 0.0), np.where(known, outside, 0.0)
        return np.where(known, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)

    def summed(block: dict[int, _Centers]):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = dict.fromkeys(block, 0.0), 0
            for batch in batches:
                x, labels = matrix(batch.column("features")), matrix(batch.column("labels"))
                seen += len(x)
                for k, c in block.items():
                    total[k] += float(widths(*distances(x, labels[:, place[k]], c)).sum())
            yield pa.RecordBatch.from_pydict(
                {"k": pa.array(list(total), pa.int32()), "total": pa.array(list(total.values()), pa.float64()), "n": pa.array([seen] * len(total), pa.int64())}
            )

        return score

    def parted(block: dict[int, _Centers]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, labels = matrix(batch.column("features")), matrix(batch.column("labels"))
                for k, c in block.items():
                    inside, outside = distances(x, labels[:, place[k]], c)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id"), pa.array(np.full(len(x), k), pa.int32()), pa.array(inside, from_pandas=True), pa.array(outside)],
                        names=["id", "k", "inside", "outside"],
                    )

        return rows

    blocks = list(itertools.islice(iterator := _center_blocks(stats), 2))
    if len(blocks) == 1:
        sums = points.select("features", "labels").mapInArrow(summed(blocks[0]), "k INT, total DOUBLE, n LONG")
        return sums.groupBy("k").agg((F.sum("total") / F.sum("n")).alias("silhouette"))
    frame = points.select("id", "features", "labels")
    parts = [frame.mapInArrow(parted(b), f"id {id_type}, k INT, inside DOUBLE, outside DOUBLE") for b in itertools.chain(blocks, iterator)]
    met = reduce(DataFrame.union, parts).groupBy("id", "k").agg(F.max("inside").alias("a"), F.min("outside").alias("b"))
    known = (F.col("a") < float("inf")) & (F.col("b") < float("inf"))
    width = F.when(known, (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).otherwise(0.0)
    return met.groupBy("k").agg(F.avg(width).alias("silhouette"))


# ---- choice of k ------------------------------------------------------------------------------


def score_models(points: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, davies_bouldin, calinski_harabasz, silhouette on squared distances) of each model."""
    dims = dimension(points)
    stats = spreads(points, ks, dims)
    width = silhouette_squared(points, ks, stats)
    return davies_bouldin(stats).join(calinski_harabasz(stats, dims), "k").join(width, "k")


def rank_scores(scores: DataFrame) -> DataFrame:
    """Scores with a min-rank per index: low Davies-Bouldin is best, high values of the others.

    The window has no key: the table has one row per k.
    """
    ranks = {
        f"{name}_rank": F.rank().over(Window.orderBy(F.col(name).asc() if ascending else F.col(name).desc()))
        for name, ascending in RANKED.items()
    }
    return scores.withColumns(ranks)


def best_k_union(ranked: DataFrame, top: int = 3) -> DataFrame:
    """k's among the best ``top`` of any index."""
    columns = [F.col(f"{name}_rank") <= top for name in RANKED]
    any_top = columns[0] | columns[1] | columns[2]
    return ranked.where(any_top).select("k").orderBy("k")


def _shortlisted(scores: DataFrame) -> DataFrame:
    listed = F.least(*[F.col(f"{name}_rank") for name in RANKED]) <= 3
    return rank_scores(scores).withColumn("shortlisted", listed)


def evaluate_k(points: DataFrame, ks: Sequence[int], method: str = "kmeans", seed: int = 37) -> DataFrame:
    """Fit, score, rank and shortlist: the ranked table with ``shortlisted``."""
    ks = sorted(set(ks))
    return _shortlisted(score_models(fit_labels(points, ks, method, seed), ks))


def shortlisted_labels(points: DataFrame, ks: Sequence[int], method: str = "kmeans", seed: int = 37) -> DataFrame:
    """(id, k, cluster) of every model that :func:`evaluate_k` shortlists."""
    ks = sorted(set(ks))
    labelled = fit_labels(points, ks, method, seed)
    listed = [r["k"] for r in _shortlisted(score_models(labelled, ks)).where("shortlisted").select("k").collect()]
    return _per_model(labelled, ks).where(F.col("k").isin(listed)).select("id", "k", "cluster")


def chosen(scores: DataFrame, value: str, highest: bool = True) -> DataFrame:
    """Scores with ``chosen``: the best k, the smallest one on a tie."""
    best = F.col(value).desc() if highest else F.col(value).asc()
    return scores.withColumn("chosen", F.row_number().over(Window.orderBy(best, F.col("k"))) == 1)


def best_k_silhouette(
    points: DataFrame, ks: Sequence[int] = range(2, 10), method: str = "kmeans", seed: int = 42, metric: str = "squared"
) -> DataFrame:
    """(k, silhouette, chosen) for the best k by the silhouette of a metric.

    ``squared`` distances are linear in the rows, ``euclidean`` ones are exact and quadratic in the distinct rows,
    and ``bounded`` are Euclidean again, linear and with an ``error`` beside the value.
    """
    ks = sorted(set(ks))
    index = {"squared": silhouette_squared, "euclidean": silhouette_exact, "bounded": silhouette_bounded}[metric]
    labelled = fit_labels(points, ks, method, seed)
    return chosen(index(labelled if metric == "squared" else written(labelled, "silhouette-labels"), ks), "silhouette")


def _inertia_table(points: DataFrame, ks: Sequence[int], seed: int) -> DataFrame:
    _, cost = sweep_kmeans(points, ks, seed)
    rows = [(int(k), float(cost[(0, k)])) for k in ks]
    return literal_table(points.sparkSession, rows, "k INT, inertia DOUBLE")


def knee(curve: DataFrame, value: str = "inertia", sensitivity: float = 1.0) -> DataFrame:
    """Mark the knee of a convex decreasing curve over k.

    Both axes are scaled to 0..1 and the curve is turned upside down; the knee is the first local
    maximum of height above the diagonal after which, before the next maximum, the height falls by
    more than ``sensitivity`` average steps. The table has one row per k.
    """
    order, whole = Window.orderBy("k"), Window.partitionBy()
    x = (F.col("k") - F.min("k").over(whole)) / (F.max("k").over(whole) - F.min("k").over(whole))
    y = (F.max(value).over(whole) - F.col(value)) / (F.max(value).over(whole) - F.min(value).over(whole))
    height = F.col("_h")
    is_top = (height >= F.lag(height).over(order)) & (height >= F.lead(height).over(order))
    after = Window.partitionBy("_section").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    falls = F.col("_top") & (F.min(height).over(after) < height - sensitivity / (F.col("_n") - 1))
    table = (
        curve.withColumn("_h", y - x)
        .withColumn("_n", F.count("*").over(whole))
        .withColumn("_top", F.coalesce(is_top, F.lit(False)))
        .withColumn("_section", F.sum(F.col("_top").cast("int")).over(order))
        .withColumn("_falls", falls)
        .withColumn("_knee", F.min(F.when(F.col("_falls"), F.col("k"))).over(whole))
    )
    return table.select("k", value, F.coalesce(F.col("k") == F.col("_knee"), F.lit(False)).alias("chosen"))


def best_k_elbow(points: DataFrame, ks: Sequence[int] = range(1, 20), seed: int = 37) -> DataFrame:
    """(k, inertia, chosen) with the knee of the inertia curve."""
    return knee(_inertia_table(points, list(ks), seed))


def aic_bic_sweep(points: DataFrame, ks: Sequence[int] = range(2, 51), seed: int = 0) -> DataFrame:
    """(k, inertia, aic, bic) of k-means for every k, with the k of the smallest AIC and BIC marked."""
    table = _inertia_table(points, list(ks), seed)
    n = points.agg(F.count("*").alias("n")).scalar()
    totals = table.withColumn("n", n).withColumn("n_clusters", F.col("k").cast("long"))
    scores = aic_bic(totals, dimension(points))
    best = lambda value: F.row_number().over(Window.orderBy(F.col(value), F.col("k"))) == 1
    return scores.withColumns({"chosen_aic": best("aic"), "chosen_bic": best("bic")})


def best_k_gap(
    points: DataFrame,
    ks: Sequence[int] = range(1, 20),
    references: int = 10,
    seed: int = 37,
    max_iter: int = 50,
    one_standard_error: bool = False,
) -> DataFrame:
    """(k, gap, sk, chosen): log inertia of uniform reference sets minus that of the rows.

    Reference sets have the size and the column ranges of the rows and are generated on the
    executors; all their models are fitted together. The largest gap wins, or with
    ``one_standard_error`` the first k whose gap is within one error of the next.
    """
    ks, spark = list(ks), points.sparkSession
    dims = dimension(points)
    bounds = points.agg(
        F.count("*").alias("n"),
        *[F.min(F.col("features")[i]).alias(f"lo{i}") for i in range(dims)],
        *[F.max(F.col("features")[i]).alias(f"hi{i}") for i in range(dims)],
    ).first()
    _, actual = sweep_kmeans(points, ks, seed, max_iter)
    # Uniform numbers from a hash of row and column, so they do not depend on how rows are placed.
    uniforms = [F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), "id"), 11) / F.lit(float(1 << 53)) for i in range(dims)]
    columns = [F.lit(bounds[f"lo{i}"]) + u * (bounds[f"hi{i}"] - bounds[f"lo{i}"]) for i, u in enumerate(uniforms)]
    rows = bounds["n"] * references
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows * dims / REFERENCE_VALUES))
    uniform = spark.range(0, rows, 1, tasks).select(
        "id", (F.col("id") % references).cast("int").alias("grp"), F.array(*columns).alias("features")
    )
    _, reference = sweep_kmeans(uniform, ks, seed, max_iter)
    gaps = []
    for k in ks:
        logs = np.log([max(reference[(g, k)], 1e-300) for g in range(references)])
        gap = logs.mean() - math.log(max(actual[(0, k)], 1e-300))
        gaps.append((int(k), float(gap), float(logs.std() * math.sqrt(1 + 1 / references))))
    table = literal_table(spark, gaps, "k INT, gap DOUBLE, sk DOUBLE")
    if not one_standard_error:
        return chosen(table, "gap")
    step = F.lead(F.col("gap") - F.col("sk")).over(Window.orderBy("k"))
    passes = table.withColumn("_ok", F.col("gap") >= step)
    first = F.min(F.when(F.col("_ok"), F.col("k"))).over(Window.partitionBy())
    return passes.withColumn("chosen", F.coalesce(F.col("k") == first, F.lit(False))).drop("_ok")


def candidate_ks(tables: Sequence[DataFrame]) -> DataFrame:
    """Distinct chosen k's of several methods, without 1."""
    union = tables[0].where("chosen").select("k")
    for t in tables[1:]:
        union = union.union(t.where("chosen").select("k"))
    return union.distinct().where("k > 1").orderBy("k")
