"""Clustering of feature rows (id, features array<double>) and projections of them.

Single models are Spark ML estimators. A sweep over many k fits all its models together: one pass
over the rows per iteration, whatever the number of models, instead of one pass per model.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.operators.birch import BRANCHING, MAX_LEAVES, THRESHOLD, birch_subclusters
from kohorta.operators.dense import matrix, squared_distances
from kohorta.operators.ward import ward_cuts, ward_merges
from kohorta.session import literal_table, written

#: Models of a sweep: centers by (group, k).
Models = dict[tuple[int, int], np.ndarray]

#: Rows that a pass over a sweep's rows multiplies with all centers at once.
CHUNK_ROWS = 1024
#: Rounds of drawing candidate centers, and candidates per round and center of the largest model.
SEED_ROUNDS = 3
OVERSAMPLING = 2
#: Micro-clusters that an agglomerative merge works on unless the caller names another number.
MICRO_CLUSTERS = 500


def _vectors(points: DataFrame) -> DataFrame:
    return points.withColumn("_vec", array_to_vector("features"))


def kmeans_fit(points: DataFrame, k: int, seed: int = 37, max_iter: int = 20, label: str = "cluster") -> DataFrame:
    """Rows with the cluster of a k-means model."""
    vectors = _vectors(points)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_vec", predictionCol=label).fit(vectors)
    return model.transform(vectors).drop("_vec")


def bisecting_fit(points: DataFrame, k: int, seed: int = 37, label: str = "cluster") -> DataFrame:
    """Rows with the leaf of a top-down hierarchy of k clusters."""
    vectors = _vectors(points)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_vec", predictionCol=label).fit(vectors)
    return model.transform(vectors).drop("_vec")


def pca_project(points: DataFrame, components: int = 2, name: str = "pca") -> DataFrame:
    """Centred rows on their first principal components, as columns pca_0, pca_1, ...

    The sign of a component is arbitrary.
    """
    vectors = _vectors(points)
    stages = [
        StandardScaler(withMean=True, withStd=False, inputCol="_vec", outputCol="_centred"),
        PCA(k=components, inputCol="_centred", outputCol="_pca"),
    ]
    projected = Pipeline(stages=stages).fit(vectors).transform(vectors)
    parts = projected.withColumn("_pca", vector_to_array("_pca"))
    columns = {f"{name}_{i}": F.col("_pca")[i] for i in range(components)}
    return parts.withColumns(columns).drop("_vec", "_centred", "_pca")


def pca_kmeans(points: DataFrame, k: int = 12, components: int = 2, seed: int = 42) -> DataFrame:
    """K-means in the plane of the first principal components."""
    projected = pca_project(points.select("id", "features"), components)
    flat = projected.withColumn("features", F.array(*[F.col(f"pca_{i}") for i in range(components)]))
    return kmeans_fit(flat, k, seed).drop("features")


# ---- sweeps -----------------------------------------------------------------------------------


def _chunks(points: DataFrame) -> DataFrame:
    """(grp, data): the rows as matrices of at most CHUNK_ROWS rows, which a pass reads without unpacking."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.asarray(batch.column("grp"))
            x = matrix(batch.column("features"))
            out: list[tuple[int, bytes]] = []
            for g in np.unique(groups):
                rows = x[groups == g]
                out += [(int(g), rows[at : at + CHUNK_ROWS].tobytes()) for at in range(0, len(rows), CHUNK_ROWS)]
            for at in range(0, len(out), 16):
                g, data = zip(*out[at : at + 16])
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(data, pa.binary())], names=["grp", "data"])

    return points.select("grp", "features").mapInArrow(pack, "grp INT, data BINARY")


def _fan(chunks: DataFrame) -> int:
    """As many tasks between the first ones and the driver as each of them reads rows."""
    return max(1, math.isqrt(chunks.rdd.getNumPartitions()))


def _lloyd_pass(chunks: DataFrame, models: Models, fan: int = 1) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Size, cost and coordinate sum by cluster of every model, from one pass over the rows.

    A task sends one packed row for all models, and ``fan`` tasks add these up for the driver. All sums are
    in the order of the tasks and do not depend on which came first.
    """
    keys = sorted(models)
    dims = models[keys[0]].shape[1]
    sizes = {key: len(models[key]) for key in keys}
    total = sum(sizes.values())
    shared = chunks.sparkSession.sparkContext.broadcast({key: np.ascontiguousarray(models[key]) for key in keys})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = np.zeros((total, dims + 2))
        at, place = {}, 0
        for key in keys:
            at[key], place = place, place + sizes[key]
        by_group: dict[int, tuple[list, slice, np.ndarray, np.ndarray]] = {}
        for g in {g for g, _ in keys}:
            mine = [key for key in keys if key[0] == g]
            centers = np.concatenate([own[key] for key in mine])
            by_group[g] = (mine, slice(at[mine[0]], at[mine[0]] + len(centers)), -2.0 * centers, (centers * centers).sum(axis=1)[:, None])
        read = False
        for batch in batches:
            for g, data in zip(batch.column("grp").to_pylist(), batch.column("data")):
                if g not in by_group:
                    continue
                read = True
                x = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, dims)
                mine, places, turned, squares = by_group[g]
                norms = (x * x).sum(axis=1)
                away = turned @ x.T
                away += squares
                # One row per center of all models; a column of a model marks its nearest one.
                member, part, first = np.empty(away.shape), sums[places], 0
                for key in mine:
                    last = first + sizes[key]
                    near, hit = away[first:last], member[first:last]
                    least = near.min(axis=0)
                    np.equal(near, least, out=hit)
                    if hit.sum() != len(x):  # equally near centers: the first one counts
                        hit[:] = 0.0
                        hit[near.argmin(axis=0), np.arange(len(x))] = 1.0
                    least += norms
                    part[first:last, 1] += hit @ np.maximum(least, 0.0, out=least)
                    first = last
                part[:, 0] += member.sum(axis=1)
                part[:, 2:] += member @ x
        if read:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["task", "sums"])

    def added(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("task")
        whole = np.zeros(total * (dims + 2))
        for data in parts["sums"]:
            whole += np.frombuffer(data.as_buffer(), np.float64)
        return pa.table({"task": parts["task"][:1], "sums": pa.array([whole.tobytes()], pa.binary())})

    parts = chunks.mapInArrow(partial, "task INT, sums BINARY")
    if fan > 1:
        parts = parts.groupBy((F.col("task") % fan).alias("of")).applyInArrow(added, "task INT, sums BINARY")
    whole = np.zeros((total, dims + 2))
    for r in sorted(parts.collect(), key=lambda r: r["task"]):
        whole += np.frombuffer(bytes(r["sums"]), np.float64).reshape(total, dims + 2)
    shared.unpersist()
    stats, place = {}, 0
    for key in keys:
        part = whole[place : place + sizes[key]]
        stats[key] = (part[:, 0], part[:, 1], part[:, 2:])
        place += sizes[key]
    return stats


def _plus_plus(rows: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centers drawn one after the other with probability by weight and squared distance; a prefix
    of the result is a draw for a smaller k."""
    chosen = [rows[rng.choice(len(rows), p=weights / weights.sum())]]
    nearest = ((rows - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        pull = nearest * weights
        total = pull.sum()
        pick = rng.choice(len(rows), p=pull / total) if total > 0 else rng.integers(len(rows))
        chosen.append(rows[pick])
        nearest = np.minimum(nearest, ((rows - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _drawn(points: DataFrame, known: dict[int, np.ndarray], cost: dict[int, float], wanted: int, salt: int) -> dict[int, np.ndarray]:
    """Rows of every group drawn with probability by squared distance to the known centers.

    A row is drawn if a hash of its id falls below its share of the group's cost times ``wanted``, so
    about ``wanted`` rows of a group come back, whatever its size, and the same ones on every run.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, groups, u = matrix(batch.column("features")), np.asarray(batch.column("grp")), np.asarray(batch.column("u"))
            d2 = np.zeros(len(x))
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                for at in range(0, len(own), CHUNK_ROWS):
                    part = own[at : at + CHUNK_ROWS]
                    d2[part] = squared_distances(x[part], known[g]).min(axis=1) * wanted / max(cost[g], 1e-300)
            hit = pa.array(np.flatnonzero(u < d2))
            yield batch.select(["grp", "id_hash", "features"]).take(hit)

    hashed = F.xxhash64(F.lit(salt), "grp", "id")
    u = F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))
    rows = points.select("grp", hashed.alias("id_hash"), u.alias("u"), "features")
    found: dict[int, list] = {}
    for r in rows.mapInArrow(draw, "grp INT, id_hash LONG, features ARRAY<DOUBLE>").orderBy("grp", "id_hash", "features").collect():
        found.setdefault(r["grp"], []).append(r["features"])
    return {g: np.array(rows) for g, rows in found.items()}


def _first_centers(points: DataFrame, chunks: DataFrame, fan: int, k: int, seed: int) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """k first centers per group by k-means|| over all rows, and each group's cost around one row.

    Every round draws candidates from the whole table, far rows more likely; in the end a candidate
    weighs as many rows as are nearest to it, and k of them are drawn. What comes to the driver is
    bounded by groups, k and rounds.
    """
    hashed = F.xxhash64(F.lit(seed), "grp", "id")
    # The least hash first: an aggregate of features would sort all rows.
    least = {r["grp"]: r["least"] for r in points.groupBy("grp").agg(F.min(hashed).alias("least")).collect()}
    lowest = F.create_map(*[F.lit(v) for pair in least.items() for v in pair])
    firsts = points.where(hashed == lowest[F.col("grp")]).groupBy("grp").agg(F.min("features").alias("features"))
    known = {r["grp"]: np.array([r["features"]]) for r in firsts.collect()}
    spread: dict[int, float] = {}
    for turn in range(SEED_ROUNDS):
        stats = _lloyd_pass(chunks, {(g, len(c)): c for g, c in known.items()}, fan)
        cost = {g: float(costs.sum()) for (g, _), (_, costs, _) in stats.items()}
        spread = spread or cost
        for g, rows in _drawn(points, known, cost, OVERSAMPLING * k, seed * 31 + turn).items():
            known[g] = np.unique(np.concatenate([known[g], rows]), axis=0)
    stats = _lloyd_pass(chunks, {(g, len(c)): c for g, c in known.items()}, fan)
    centers = {}
    for (g, _), (weights, _, _) in stats.items():
        centers[g] = _plus_plus(known[g], weights, k, np.random.default_rng(seed))
    return centers, spread


def sweep_kmeans(
    points: DataFrame, ks: Sequence[int], seed: int = 37, max_iter: int = 50, tol: float = 1e-4
) -> tuple[Models, dict[tuple[int, int], float]]:
    """Centers and inertia of k-means for every k and group, all models moved by the same passes.

    ``points`` is (id, features) or (id, features, grp), grp an int that separates data sets. Centers
    start from a draw over all rows of a group, see :func:`_first_centers`. A model whose centers
    together move by less than ``tol`` variances leaves the later passes. Rows are kept on the
    executors' disks meanwhile, so that memory does not grow with them; a lost block is computed again.
    """
    if "grp" not in points.columns:
        points = points.withColumn("grp", F.lit(0))
    points = points.select("id", "features", F.col("grp").cast("int").alias("grp")).persist(StorageLevel.DISK_ONLY)
    chunks = _chunks(points).persist(StorageLevel.DISK_ONLY)
    fan = _fan(chunks)
    try:
        start, spread = _first_centers(points, chunks, fan, max(ks), seed)
        models: Models = {(g, k): centers[:k] for g, centers in start.items() for k in ks}
        rows = {r["grp"]: r["n"] for r in points.groupBy("grp").agg(F.count("*").alias("n")).collect()}
        dims = next(iter(start.values())).shape[1]
        # The cost around one row is about twice the variance, summed over rows and dimensions.
        still = {g: tol * cost / (2 * rows[g] * dims) for g, cost in spread.items()}
        moving, inertia = set(models), {}
        for _ in range(max_iter):
            stats = _lloyd_pass(chunks, {key: models[key] for key in moving}, fan)
            for key, (n, _, total) in stats.items():
                centers = models[key].copy()
                centers[n > 0] = total[n > 0] / n[n > 0][:, None]
                if ((centers - models[key]) ** 2).sum() <= still[key[0]]:
                    moving.discard(key)
                models[key] = centers
            if not moving:
                break
        for key, (_, costs, _) in _lloyd_pass(chunks, models, fan).items():
            inertia[key] = float(costs.sum())
        return models, inertia
    finally:
        chunks.unpersist()
        points.unpersist()


def assign(points: DataFrame, centers: Sequence[np.ndarray]) -> DataFrame:
    """Rows with ``labels``, the nearest center of each model in turn."""

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("features"), batch.column("id"))
            found = np.empty((len(x), len(centers)), np.int32)
            for at in range(0, len(x), CHUNK_ROWS):
                for m, c in enumerate(centers):
                    found[at : at + CHUNK_ROWS, m] = squared_distances(x[at : at + CHUNK_ROWS], c).argmin(axis=1)
            offsets = np.arange(0, found.size + 1, len(centers), dtype=np.int32)
            labels = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("features"), labels], names=["id", "features", "labels"]
            )

    frame = points.select("id", "features")
    id_type = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(label, f"id {id_type}, features ARRAY<DOUBLE>, labels ARRAY<INT>")


def write_models(spark: SparkSession, models: Models, path: str) -> None:
    """Centers of fitted models as a table (grp, k, cluster, center)."""
    rows = [(g, k, c, [float(v) for v in center]) for (g, k), centers in sorted(models.items()) for c, center in enumerate(centers)]
    literal_table(spark, rows, "grp INT, k INT, cluster INT, center ARRAY<DOUBLE>").write.mode("overwrite").parquet(path)


def read_models(spark: SparkSession, path: str, ks: Sequence[int] | None = None) -> Models:
    """Models of a table that :func:`write_models` wrote, all of them or those of some k's."""
    rows = spark.read.parquet(path)
    rows = rows if ks is None else rows.where(F.col("k").isin(list(ks)))
    models: dict[tuple[int, int], list] = {}
    for r in rows.orderBy("grp", "k", "cluster").collect():
        models.setdefault((r["grp"], r["k"]), []).append(r["center"])
    return {key: np.array(centers) for key, centers in models.items()}


# ---- agglomerative merge of a bounded summary -------------------------------------------------


def ward_two_stage(
    points: DataFrame, ks: Sequence[int], micro: int = MICRO_CLUSTERS, seed: int = 37
) -> DataFrame:
    """Rows with ``labels``, one Ward cut per k, smallest k first.

    K-means forms at most ``micro`` small clusters, and the merge works on their sizes and means; rows
    get the label of their micro-cluster. The summary on the driver has a fixed size however many rows
    there are, and a table of any size takes the same way. The more micro-clusters, the closer to a
    merge of single rows; :func:`ward_fit` merges the rows themselves.
    """
    ks = sorted(set(ks))
    models, _ = sweep_kmeans(points, [micro], seed, max_iter=10)
    means = models[(0, micro)]
    chunks = _chunks(points.withColumn("grp", F.lit(0)))
    sizes, _, totals = _lloyd_pass(chunks, {(0, micro): means}, _fan(chunks))[(0, micro)]
    means, sizes = totals[sizes > 0] / sizes[sizes > 0][:, None], sizes[sizes > 0]
    cuts = ward_merges(sizes, means, [min(k, len(sizes)) for k in ks])
    labels = [cuts[min(k, len(sizes))] for k in ks]
    placed = assign(points, [means]).withColumnRenamed("labels", "_micro")
    # One row per micro-cluster, at most ``micro``.
    rows = [(i, [int(cut[i]) for cut in labels]) for i in range(len(sizes))]
    table = literal_table(points.sparkSession, rows, "_m INT, labels ARRAY<INT>")
    return placed.join(F.broadcast(table), F.col("_micro")[0] == F.col("_m")).select("id", "features", "labels")


def ward_fit(points: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Rows with ``labels``, one Ward cut of the rows themselves per k, smallest k first.

    Equal rows are one cluster from the start. Comparing all distinct rows with each other is quadratic in
    them, in Spark, a block against a block; the driver sees the last few hundred clusters.
    """
    first = F.min(F.xxhash64("id")).alias("cid")
    # Distinct rows need distinct numbers; two ids with one hash would be a chance of 2^-64 a pair.
    distinct = written(points.groupBy("features").agg(first, F.count("*").alias("n")), "ward-rows")
    # Numbers times the number of cuts must fit into 64 bits.
    summary = distinct.select(F.shiftrightunsigned("cid", 12).alias("cid"), "n", F.col("features").alias("mu"))
    cuts = written(ward_cuts(summary, ks), "ward-cuts")
    owned = distinct.select("features", F.shiftrightunsigned("cid", 12).alias("cid")).join(cuts, "cid").select("features", "labels")
    return points.select("id", "features").join(owned, "features").select("id", "features", "labels")


def birch_labels(
    points: DataFrame,
    ks: Sequence[int],
    threshold: float = THRESHOLD,
    branching: int = BRANCHING,
    max_leaves: int = MAX_LEAVES,
) -> DataFrame:
    """Rows with ``labels``, one cut per k, smallest k first, of a merge of Birch subclusters.

    The centroids of the subclusters are merged by Ward's distance, each counting once, and a row gets
    the label of the nearest centroid. With fewer subclusters than k, each is a cluster.
    """
    ks = sorted(set(ks))
    sizes, means, _ = birch_subclusters(points, threshold, branching, max_leaves)
    if not len(sizes):
        return points.select("id", "features", F.array().cast("array<int>").alias("labels"))
    cuts = ward_merges(np.ones(len(means)), means, [min(k, len(means)) for k in ks])
    rows = [(i, [int(cuts[min(k, len(means))][i]) for k in ks]) for i in range(len(means))]
    table = literal_table(points.sparkSession, rows, "_m INT, labels ARRAY<INT>")
    placed = assign(points, [means]).withColumnRenamed("labels", "_micro")
    return placed.join(F.broadcast(table), F.col("_micro")[0] == F.col("_m")).select("id", "features", "labels")


def fit_labels(points: DataFrame, ks: Sequence[int], method: str = "kmeans", seed: int = 37) -> DataFrame:
    """Rows with ``labels``, one cluster per k in ascending order of k, by the named method."""
    ks = sorted(set(ks))
    if method == "kmeans":
        models, _ = sweep_kmeans(points, ks, seed)
        return assign(points, [models[(0, k)] for k in ks])
    if method == "ward":
        return ward_two_stage(points, ks, seed=seed)
    if method == "birch":
        return birch_labels(points, ks)
    if method == "bisecting":
        frame = points.select("id", "features")
        for k in ks:
            frame = bisecting_fit(frame, k, seed, f"_l{k}")
        labels = F.array(*[F.col(f"_l{k}").cast("int") for k in ks])
        return frame.select("id", "features", labels.alias("labels"))
    raise ValueError(f"unknown method {method!r}")
