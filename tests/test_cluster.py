"""Clusterings by distance and kernel components against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.errors import InputError
from veilwork.operators import cluster, group


def spread(rng):
    """Dense groups, one with many copies and one in a single cell, and points between them."""
    p = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (3, 3))] + [rng.normal((0, 5), 0.02, (150, 2)), rng.uniform(-3, 7, (60, 2))])
    return np.concatenate([p, p[:30], p[:1].repeat(90, axis=0)])


def frame(spark, p):
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(p)], "id long, " + ", ".join(f"x{k} double" for k in range(p.shape[1])))
    return cluster.features_of(df, {c: F.col(c) for c in df.columns[1:]})


def same_classes(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def plain_density(p, radius, least):
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    near = d <= radius * radius
    core = near.sum(1) >= least
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            label[i], stack = i, [i]
            while stack:
                found = np.flatnonzero(near[stack.pop()] & core & (label < 0))
                label[found] = i
                stack += found.tolist()
    border = [np.where(core & near[i], d[i], np.inf) for i in range(len(p))]
    return core, np.array([label[i] if core[i] else label[np.argmin(border[i])] if np.isfinite(border[i].min()) else -1 for i in range(len(p))])


def test_density_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 40)  # the cell of 150 points is many blocks
    p = spread(np.random.default_rng(1))
    core, label = plain_density(p, 0.35, 6)
    got = {r.id: r for r in cluster.dbscan(frame(spark, p), 0.35, 6).collect()}
    assert len(got) == len(p) and [got[i].core for i in range(len(p))] == core.tolist()
    found = [got[i].prediction for i in range(len(p))]
    assert same_classes(found, label.tolist()) and [x == -1 for x in found] == (label == -1).tolist()
    assert sorted(set(found) - {-1}) == list(range(len(set(label.tolist()) - {-1})))
    assert cluster.dbscan(frame(spark, p).limit(0), 0.35, 6).count() == 0
    for bad in ((0, 3), (1, 0)):
        with pytest.raises(InputError):
            cluster.dbscan(frame(spark, p), *bad)


def plain_cuts(p, clusters):
    order = sorted((np.sqrt(((p[i] - p[j]) ** 2).sum()), i, j) for i in range(len(p)) for j in range(i))
    root, left = list(range(len(p))), len(p)
    find = lambda i: i if root[i] == i else find(root[i])
    for _, i, j in order:
        if left == clusters:
            break
        if find(i) != find(j):
            root[find(i)], left = find(j), left - 1
    return [find(i) for i in range(len(p))]


@pytest.mark.parametrize("clusters", [2, 9])
def test_single_linkage_equals_brute_force(spark, clusters):
    p = np.random.default_rng(3).normal(size=(120, 3))
    p = np.concatenate([p, p[:20]])
    got = {r.id: r.prediction for r in cluster.single_linkage(frame(spark, p), clusters).collect()}
    assert same_classes([got[i] for i in range(len(p))], plain_cuts(p, clusters)) and set(got.values()) == set(range(clusters))


def test_linkage_of_few_points(spark):
    p = np.array([[0.0], [0.0], [1.0], [5.0]])
    got = lambda **o: [r.prediction for r in cluster.single_linkage(frame(spark, p), **o).orderBy("id").collect()]
    assert got(clusters=5) == [0, 0, 1, 2] and got(distance=1.0) == [0, 0, 0, 1] and got(distance=0.0) == [0, 0, 1, 2]
    assert cluster.single_linkage(frame(spark, p).limit(0), 2).count() == 0


def test_light_forest_is_lightest():
    rng = np.random.default_rng(5)
    w = rng.random((30, 30))
    w = np.minimum(w, w.T)
    w[:12, 12:] = w[12:, :12] = np.inf
    i, j, size = cluster.light_forest(w)
    assert len(i) == 28
    root = list(range(30))
    find = lambda k: k if root[k] == k else find(root[k])
    total = 0.0
    for x, a, b in sorted((w[a, b], a, b) for a in range(30) for b in range(a) if np.isfinite(w[a, b])):
        if find(a) != find(b):
            root[find(a)], total = find(b), total + x
    assert np.isclose(size.sum(), total)


def test_kernel_component_equals_the_full_kernel(spark):
    p = np.random.default_rng(2).normal(size=(400, 3)) * [1, 0.5, 2]
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    k = np.exp(-d / 3)
    j = np.eye(len(p)) - 1 / len(p)
    values, vectors = np.linalg.eigh(j @ k @ j)
    full = vectors[:, -1] * np.sqrt(values[-1])
    full *= 1 if (full**3).sum() > 0 else -1
    made = {m: np.array([r.component for r in cluster.kernel_component(frame(spark, p), landmarks=m).orderBy("id").collect()]) for m in (400, 120)}
    assert np.abs(made[400] - full).max() < 1e-6 * np.abs(full).max()
    assert np.sqrt(((made[120] - full) ** 2).mean()) < 0.05 * full.std()  # what landmarks cost
    assert cluster.kernel_component(frame(spark, p).limit(0)).count() == 0


def test_groups_by_density_linkage_and_kernel(spark):
    p = spread(np.random.default_rng(1))[:150]
    df = frame(spark, p).drop("features")
    for options in ({"clust": "dbscan", "radius": 0.4}, {"clust": "agglomerative", "clusters": 3}, {"reduct": "kpca", "landmarks": 60}):
        out = group.advanced_magg(df, 5, key="id", cols=["x0", "x1"], **options)
        assert out.count() == 150 and out.groupBy("x0", "x1").count().filter("count < 5").count() == 0


def plain_ward(sizes, means, k):
    parts = [([i], float(n), np.array(m, float)) for i, (n, m) in enumerate(zip(sizes, means, strict=True))]
    while len(parts) > k:
        cost = {(i, j): a[1] * b[1] / (a[1] + b[1]) * ((a[2] - b[2]) ** 2).sum() for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j}
        i, j = min(cost, key=cost.get)
        (x, n, a), (y, m, b) = parts[i], parts[j]
        parts = [p for t, p in enumerate(parts) if t not in (i, j)] + [(x + y, n + m, (n * a + m * b) / (n + m))]
    label = np.empty(len(sizes), int)
    for t, p in enumerate(parts):
        label[p[0]] = t
    return label


@pytest.mark.parametrize("k", [1, 2, 5, 20])
def test_ward_equals_a_plain_version(k):
    rng = np.random.default_rng(k)
    means, sizes = rng.normal(size=(60, 3)) * (1, 2, 5), rng.integers(1, 40, 60)
    assert same_classes(cluster.ward_labels(sizes, means, k).tolist(), plain_ward(sizes, means, k).tolist())


def test_features_sum_up_to_the_table_at_every_level(spark):
    p = np.round(spread(np.random.default_rng(3)) * 64)  # whole numbers: sums are exact
    found = {}
    for parts in (1, 7):
        df = frame(spark, p).repartition(parts, "id")
        for most in (10_000, 60, 7, 1):
            features = sorted(map(tuple, cluster.feature_tree(df, 40.0, most)[0].collect()))
            assert len(features) <= most and sum(f[1] for f in features) == len(p)
            assert np.array_equal(np.sum([f[2] for f in features], axis=0), p.sum(axis=0))
            assert np.array_equal(np.sum([f[3] for f in features], axis=0), (p**2).sum(axis=0))
            assert found.setdefault(most, features) == features  # whatever the partitions
    radius = [np.sqrt(max(0, sum(f[3]) / f[1] - sum((v / f[1]) ** 2 for v in f[2]))) for f in found[10_000]]
    assert max(radius) <= 40.0 and len(found[60]) > 30


def test_birch_equals_ward_on_its_features(spark):
    p = spread(np.random.default_rng(5))
    df = frame(spark, p)
    got = [r.prediction for r in cluster.birch(df, 4, 1e-6, 1000).orderBy("id").collect()]  # a feature a point
    points, at, n = np.unique(p, axis=0, return_inverse=True, return_counts=True)
    assert same_classes(got, plain_ward(n, points, 4)[at.ravel()].tolist())
    coarse = [r.prediction for r in cluster.birch(df, 3, 0.5, 50).orderBy("id").collect()]
    assert len(set(coarse)) == 3 and len({coarse[i] for i in range(60)}) == 1  # a dense group stays whole
    assert len({r.prediction for r in cluster.birch(df, None, 3.0).collect()}) > 3


def test_birch_on_odd_tables(spark):
    df = frame(spark, np.array([[1.0, 2.0], [1.0, 2.0], [float("nan"), 1.0], [5.0, float("inf")]]))
    assert [r.prediction for r in cluster.birch(df).orderBy("id").collect()] == [0, 0, -1, -1]
    assert cluster.birch(df.limit(0)).count() == 0 and cluster.birch(df.filter("id = 2")).first().prediction == -1
    wide = frame(spark, np.random.default_rng(1).normal(size=(300, 12)))
    assert 4 < cluster.feature_tree(wide, 0.1, 40)[0].count() <= 40
    for bad in ({"threshold": 0.0}, {"most": 0}, {"clusters": 0}, {"threshold": 1e-300}):
        with pytest.raises(InputError):
            cluster.birch(frame(spark, np.array([[1.0], [2.0]])), **bad)
    rows = frame(spark, spread(np.random.default_rng(2)))
    out = group.advanced_magg(rows.drop("features"), 3, clust="birch", key="id", cols=["x0", "x1"])
    assert out.count() == rows.count() and abs(out.agg(F.sum("x0")).first()[0] - rows.agg(F.sum("x0")).first()[0]) < 1e-6
