import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import cluster, density, features, validity


def blobs(seed=3, per=60, centers=((0, 0), (8, 0), (0, 8)), spread=0.6):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, spread, (per, len(c))) for c in centers])


def frame(table, x, labels=None):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    if labels is not None:
        rows = [(*r, [int(v) for v in np.atleast_1d(lab)]) for r, lab in zip(rows, labels)]
        return table(rows, "id LONG, features ARRAY<DOUBLE>, labels ARRAY<INT>")
    return table(rows, "id LONG, features ARRAY<DOUBLE>")


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == c].mean() for c in set(labels) if c != own)
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_silhouette_against_brute_force(table, monkeypatch):
    x = np.concatenate([blobs(per=40), blobs(per=40)[:30], [[50.0, 50.0]]])  # with copies and a singleton
    labels = np.concatenate([np.arange(len(x) - 1) % 4, [9]])
    monkeypatch.setattr(validity, "BLOCK_ROWS", 30)
    points = frame(table, x, labels)
    got = {r["id"]: r["s"] for r in validity.silhouette_samples(points).collect()}
    expected = brute_silhouette(x, labels)
    assert len(got) == len(x)
    assert np.allclose([got[i] for i in range(len(x))], expected, atol=1e-6)
    assert got[len(x) - 1] == 0
    mean = validity.silhouette_exact(points, [5]).first()["silhouette"]
    assert abs(mean - expected.mean()) < 1e-6


def test_silhouette_blocks_grow_and_not_their_number(table, monkeypatch):
    monkeypatch.setattr(validity, "BLOCK_ROWS", 5)
    monkeypatch.setattr(validity, "BLOCKS", 3)
    monkeypatch.setattr(validity, "TILE", 7)
    x = blobs(per=20)
    labels = np.arange(len(x)) % 3
    scored = validity._exact(frame(table, x, labels), 1)
    assert "explode(sequence(0, 2," in scored._jdf.queryExecution().analyzed().toString()
    got = {r["id"]: r["s"][0] for r in scored.collect()}
    assert np.allclose([got[i] for i in range(len(x))], brute_silhouette(x, labels), atol=1e-6)


def test_indices_with_large_centroid_tables(table, monkeypatch):
    x = blobs()
    points = frame(table, x, np.repeat([0, 1, 2], 60))
    small = validity.score_models(points, [3]).first()
    monkeypatch.setattr(validity, "CENTER_BYTES", 1)
    large = validity.score_models(points, [3]).first()
    assert np.allclose(small, large)


def test_sweep_finds_blobs_and_matches_one_model(table, spark):
    points = frame(table, blobs())
    models, cost = cluster.sweep_kmeans(points, [1, 2, 3, 4])
    assert cost[(0, 1)] > cost[(0, 2)] > cost[(0, 3)] > cost[(0, 4)]
    centers = models[(0, 3)][np.lexsort(models[(0, 3)].T)]
    assert np.allclose(centers, [[0, 0], [8, 0], [0, 8]], atol=0.4)
    labelled = cluster.assign(points, [models[(0, 3)]])
    total = validity.inertia(validity.spreads(labelled, [3])).first()["inertia"]
    assert abs(total - cost[(0, 3)]) < 1e-6 * total
    fitted = cluster.kmeans_fit(points, 3)
    assert sorted(r["n"] for r in features.cluster_sizes(fitted, "cluster").collect()) == [60, 60, 60]


def test_sweep_does_not_depend_on_partitions(table):
    points = frame(table, blobs())
    _, one = cluster.sweep_kmeans(points.repartition(1), [2, 3])
    _, many = cluster.sweep_kmeans(points.repartition(7), [2, 3])
    assert all(abs(one[key] - many[key]) < 1e-6 for key in one)


def test_a_pass_counts_the_first_of_equal_centers(spark):
    """Sizes, costs and sums of every model and group, as from all distances, with ties and repeated centers."""
    pick = np.random.default_rng(6)
    x, grp = pick.integers(0, 3, (500, 3)).astype(float), pick.integers(0, 2, 500)
    points = spark.createDataFrame([(v.tolist(), int(g)) for v, g in zip(x, grp)], "features array<double>, grp int")
    models = {(g, k): x[pick.integers(0, 500, k)] for g in (0, 1) for k in (1, 2, 7)}
    models[(1, 4)] = np.repeat(x[:2], 2, axis=0)
    found = cluster._lloyd_pass(cluster._chunks(points), models)
    assert set(found) == set(models)
    for (g, k), (n, cost, total) in found.items():
        own = x[grp == g]
        d2 = ((own[:, None] - models[(g, k)][None]) ** 2).sum(-1)
        label = d2.argmin(axis=1)
        assert n.tolist() == np.bincount(label, minlength=k).tolist()
        assert np.allclose(cost, np.bincount(label, d2.min(axis=1), k))
        assert np.allclose(total, [own[label == c].sum(axis=0) for c in range(k)])


def test_sweep_seeds_small_groups(spark):
    grp = F.when(F.col("id") < 5, 1).otherwise(0)
    points = spark.range(5005).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("features"), grp.alias("grp"))
    models, cost = cluster.sweep_kmeans(points, [2, 3])
    assert {key for key in models} == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert cost[(1, 3)] < cost[(1, 2)]


def test_ragged_and_null_features_are_errors(spark):
    for bad in ("array(4D)", "cast(null as array<double>)", "array(1D, null)"):
        points = spark.sql(f"select 1L as id, array(1D, 2D) as features union all select 2L, {bad}").coalesce(1)
        with pytest.raises(Exception, match="features"):
            cluster.assign(points, [np.zeros((2, 2))]).collect()


def test_shortlisted_models_keep_their_labels(table):
    points = frame(table, blobs())
    listed = {r["k"] for r in validity.evaluate_k(points, range(2, 9)).where("shortlisted").collect()}
    kept = validity.shortlisted_labels(points, range(2, 9))
    assert {r["k"] for r in kept.select("k").distinct().collect()} == listed
    assert kept.count() == 180 * len(listed)


def test_information_criteria_mark_their_minimum(table):
    got = validity.aic_bic_sweep(frame(table, blobs()), range(2, 7)).collect()
    assert [r["k"] for r in got if r["chosen_aic"]] == [min(got, key=lambda r: r["aic"])["k"]]
    assert [r["k"] for r in got if r["chosen_bic"]] == [min(got, key=lambda r: r["bic"])["k"]]


def test_best_k_of_blobs(table):
    points = frame(table, blobs())
    for found in (
        validity.best_k_silhouette(points, range(2, 7)),
        validity.best_k_silhouette(points, range(2, 7), "ward"),
        validity.best_k_silhouette(points, range(2, 5), "bisecting"),
        validity.best_k_elbow(points, range(1, 9)),
        validity.best_k_gap(points, range(1, 5), references=2, max_iter=8),
    ):
        assert [r["k"] for r in found.where("chosen").collect()] == [3]
    assert validity.best_k_gap(points, range(1, 5), 2, max_iter=8, one_standard_error=True).where("chosen").count() == 1


def test_ward_exact_and_two_stage(table):
    x = np.array([[0.0], [0.2], [1.0], [5.0], [5.1], [9.0], [0.0]])
    exact = cluster.ward_two_stage(frame(table, x), [2, 3])
    got = {r["id"]: tuple(r["labels"]) for r in exact.collect()}
    groups = lambda at: sorted(sorted(i for i in got if got[i][at] == c) for c in {v[at] for v in got.values()})
    assert groups(1) == [[0, 1, 2, 6], [3, 4], [5]]
    assert groups(0) == [[0, 1, 2, 6], [3, 4, 5]]
    staged = cluster.ward_two_stage(frame(table, blobs()), [3], micro=12)
    sizes = staged.groupBy(F.col("labels")[0]).count().collect()
    assert sorted(r["count"] for r in sizes) == [60, 60, 60]


def test_pca_is_centred_and_ordered(table):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [5, 2, 0.1] + [10, 20, 30]
    got = cluster.pca_project(frame(table, x), 2).select("pca_0", "pca_1").toPandas()
    assert np.allclose(got.mean(), 0, atol=1e-9)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(got.var(), values[:2], rtol=1e-6)


def test_rank_fixture(table, rows):
    scores = table(
        [(2, 0.9, 100.0, 0.40), (3, 0.8, 120.0, 0.40), (4, 0.9, 110.0, 0.30), (5, 1.2, 90.0, 0.20)],
        "k INT, davies_bouldin DOUBLE, calinski_harabasz DOUBLE, silhouette DOUBLE",
    )
    ranked = validity.rank_scores(scores)
    assert rows(ranked, "k", "davies_bouldin_rank", "calinski_harabasz_rank", "silhouette_rank") == [
        (2, 2, 3, 1),
        (3, 1, 1, 1),
        (4, 2, 2, 3),
        (5, 4, 4, 4),
    ]
    assert rows(validity.best_k_union(ranked)) == [(2,), (3,), (4,)]
    assert [r["k"] for r in validity.chosen(scores, "silhouette").where("chosen").collect()] == [2]
    chosen = validity.chosen(scores, "davies_bouldin", highest=False)
    assert rows(validity.candidate_ks([chosen, validity.chosen(scores, "silhouette")])) == [(2,), (3,)]


def test_knee(table, rows):
    curve = table([(k, 100.0 / k) for k in range(1, 11)], "k INT, inertia DOUBLE")
    assert [r["k"] for r in validity.knee(curve).where("chosen").collect()] == [3]
    line = table([(k, 10.0 - k) for k in range(1, 6)], "k INT, inertia DOUBLE")
    assert validity.knee(line).where("chosen").count() == 0


def brute_dbscan(x, blocks, eps, least):
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    near = (d2 <= eps * eps) & (blocks[:, None] == blocks[None])
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        reach = np.where(near & core[None, :] & core[:, None], label[None, :], len(x))
        new = np.where(core, np.minimum(label, reach.min(1)), -1)
        if (new == label).all():
            break
        label = new
    around = np.where(near & core[None, :], label[None, :], len(x)).min(1)
    return np.where(core, label, np.where(around < len(x), around, -1))


@pytest.mark.parametrize("direct", [4096, 0])
def test_dbscan_against_brute_force(table, monkeypatch, direct):
    monkeypatch.setattr(density, "DIRECT_PAIRS", direct)
    rng = np.random.default_rng(11)
    dense = rng.normal(0, 0.05, (120, 2))
    ring = np.array([[np.cos(t), np.sin(t)] for t in np.linspace(0, 5, 90)])
    sparse = rng.uniform(-2, 2, (60, 2))
    x = np.concatenate([dense, ring, sparse, dense[:20]])
    blocks = np.arange(len(x)) % 2
    points = table([(i, float(a), float(b), int(f)) for i, ((a, b), f) in enumerate(zip(x, blocks))], "id LONG, x DOUBLE, y DOUBLE, f INT")
    got = {r["id"]: r["cluster"] for r in density.dbscan(points, ["x", "y"], 0.15, 4, ["f"]).collect()}
    expected = brute_dbscan(x, blocks, 0.15, 4)
    assert len(got) == len(x)
    assert [got[i] for i in range(len(x))] == expected.tolist()
    shuffled = density.dbscan(points.orderBy(F.rand(1)), ["x", "y"], 0.15, 4, ["f"])
    assert {r["id"]: r["cluster"] for r in shuffled.collect()} == got


def test_dbscan_rejects_wide_radius_with_blocks(table):
    with pytest.raises(ValueError):
        density.dbscan(table([(1, 0.0, 1)], "id LONG, x DOUBLE, f INT"), ["x"], 1.5, 2, ["f"])


def test_components_of_a_chain(table, rows):
    n = 40
    nodes = table([(i,) for i in range(n)], "node LONG")
    edges = table([(i, i + 1) for i in range(n - 1) if i != 19], "a LONG, b LONG")
    assert rows(density.connected_components(nodes, edges)) == [(i, 0 if i < 20 else 20) for i in range(n)]


def test_feature_rules(table, rows):
    raw = table([("a", 1.0, True), ("b", None, False), ("c", float("inf"), None)], "id STRING, v DOUBLE, flag BOOLEAN")
    assert rows(features.clean_features(raw, ["v"]), "id") == [("a",)]
    assert rows(features.fill_missing(raw, ["v"]), "id", "v")[1] == ("b", 0.0)
    assert rows(features.bools_to_int(raw), "id", "flag") == [("a", 1), ("b", 0), ("c", None)]
    with pytest.raises(ValueError, match="flag"):
        features.require_numeric(raw, ["v", "flag"])


def test_bounded_silhouette_holds_the_exact_one(spark):
    pick = np.random.default_rng(5)
    x = np.concatenate([pick.normal(c, 0.7, (120, 2)) for c in ((0, 0), (6, 0), (0, 6))] + [np.zeros((60, 2))])
    labels = np.stack([(x[:, 0] > 3).astype(int), np.arange(len(x)) % 3 - 1, (np.arange(len(x)) == 5).astype(int)], axis=1)
    points = spark.createDataFrame(
        [(i, [float(v) for v in row], [int(c) for c in own]) for i, (row, own) in enumerate(zip(x, labels))],
        "id bigint, features array<double>, labels array<int>",
    )
    ks = [2, 3, 4]
    exact = {r.k: r.silhouette for r in validity.silhouette_exact(points, ks).collect()}
    errors = []
    for cells in (4, 60):
        got = {r.k: r for r in validity.silhouette_bounded(points, ks, cells).collect()}
        assert set(got) == set(ks)
        assert all(abs(r.silhouette - exact[k]) <= r.error for k, r in got.items())
        errors.append(max(r.error for r in got.values()))
    assert errors[1] < errors[0] and errors[1] < 0.2


def test_davies_bouldin_in_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(validity, "BLOCK_CENTERS", 16)
    pick = np.random.default_rng(5)
    rows, want = [], {}
    for k in (1, 2, 100):
        mu, dev = pick.normal(size=(k, 3)), pick.random(k)
        if k == 100:
            mu[7] = mu[50]
        rows += [(k, c, mu[c].tolist(), float(dev[c])) for c in range(k)]
        d = np.sqrt(((mu[:, None] - mu[None]) ** 2).sum(axis=2))
        d[d == 0] = np.inf
        ratio = (dev[:, None] + dev[None]) / d
        want[k] = None if k == 1 else np.where(np.eye(k) > 0, -1, ratio).max(axis=1).mean()
    stats = spark.createDataFrame(rows, "k INT, cluster INT, mu ARRAY<DOUBLE>, dev DOUBLE")
    got = {r.k: r.davies_bouldin for r in validity.davies_bouldin(stats).collect()}
    assert got.keys() == want.keys() and got[1] is None
    assert all(abs(got[k] - want[k]) < 1e-9 for k in (2, 100))


def test_a_sweep_keeps_no_rows_in_memory(spark, monkeypatch):
    """Rows lie on disk, a task makes a bounded part of the reference sets, and distances are taken of a few rows at a time."""
    kept, first = [], cluster._first_centers

    def seen(points, chunks, *rest):
        kept.append((points.storageLevel, chunks.storageLevel, points.rdd.getNumPartitions()))
        return first(points, chunks, *rest)

    rows = [(i, [float(i % 7), float(i % 5), float(i)]) for i in range(60)]
    points = spark.createDataFrame(rows, "id bigint, features array<double>")
    whole = validity.best_k_gap(points, [1, 3], references=10, max_iter=3).collect()
    monkeypatch.setattr(cluster, "_first_centers", seen)
    monkeypatch.setattr(cluster, "CHUNK_ROWS", 4)
    monkeypatch.setattr(validity, "REFERENCE_VALUES", 100)
    parted = validity.best_k_gap(points, [1, 3], references=10, max_iter=3).collect()
    assert all(level.useDisk and not level.useMemory for *levels, _ in kept for level in levels)
    assert kept[-1][2] == 18
    assert [(r.k, r.chosen) for r in parted] == [(r.k, r.chosen) for r in whole]
    assert np.allclose([[r.gap, r.sk] for r in parted], [[r.gap, r.sk] for r in whole])
