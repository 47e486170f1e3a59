"""Neighbour index, layouts and embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitlake.operators import embed, forest, kernels, layout
from gaitlake.operators.neighbors import knn


def frame_of(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>").repartition(3)


def sheet(n, seed=0):
    """Three bent sheets in ten dimensions."""
    rng = np.random.default_rng(seed)
    u, w = rng.random((n, 2)) * 4, rng.normal(size=(2, 10))
    return np.concatenate([np.sin(u @ w[:, :5]), u @ w[:, 5:]], 1) + (np.arange(n) % 3)[:, None] * 6 * rng.normal(size=(1, 10)) + rng.normal(0, 0.05, (n, 10))


def square(x):
    return ((x[:, None] - x[None]) ** 2).sum(2)


def trust(x, y, k=12):
    n, d, e = len(x), square(x), square(y)
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.take_along_axis(np.argsort(np.argsort(d, 1), 1) + 1, np.argsort(e, 1)[:, :k], 1)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(rank - k, 0).sum()


def plane(found):
    return np.array([r["y"] for r in found.orderBy("frame").collect()])


def test_index_is_exact_where_chunks_reach_all_rows(spark):
    x = np.random.default_rng(1).normal(size=(900, 6))
    x[100:160] = x[99]  # copies: ties by key
    df = frame_of(spark, x)
    for queries in (None, df.where("frame % 7 = 0")):
        index = forest.Forest(df)
        got = {(r["src"], r["rank"]): (r["dst"], r["d2"]) for r in index.search(queries, k=4).collect()}
        want = {(r["src"], r["rank"]): (r["dst"], r["d2"]) for r in knn(queries if queries is not None else df, df, 4).collect()}
        assert got == want and index.recall == 1


def test_index_reaches_its_recall_with_small_chunks_and_hot_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([sheet(3000), np.tile(rng.normal(size=10), (1500, 1))])  # a third are copies
    df = frame_of(spark, x)
    index = forest.Forest(df, target=0.9, chunk=128)
    found = index.lists(k=6)
    assert index.recall >= 0.9
    d = square(x)
    np.fill_diagonal(d, np.inf)
    worst = np.sort(d, 1)[:, 5]
    rows = found.collect()
    assert len(rows) == len(x) and all(len(r["near"]) == 6 for r in rows)
    hits = [sum(p["d2"] <= worst[r["src"]] * (1 + 1e-9) + 1e-12 for p in r["near"]) for r in rows]
    assert np.mean(hits) / 6 >= 0.9
    assert all(abs(p["d2"] - d[r["src"], p["dst"]]) < 1e-9 for r in rows[:50] for p in r["near"])
    with pytest.raises(ValueError, match="recall"):
        forest.Forest(frame_of(spark, rng.normal(size=(2000, 40))), target=0.999, chunk=64, most=8).lists(k=6)


def test_index_of_little(spark):
    empty = frame_of(spark, np.zeros((1, 3))).limit(0)
    assert forest.Forest(empty).search().count() == 0
    assert forest.Forest(frame_of(spark, np.zeros((1, 3)))).search().count() == 0
    assert forest.Forest(frame_of(spark, np.zeros((2, 3)))).search().count() == 2


def test_affinities_equal_their_definition():
    d = np.sort(np.random.default_rng(3).random((40, 30)) * 9, 1)
    d[0, 20:] = np.inf
    p = layout.affinities(d, 8.0)
    assert np.allclose(p.sum(1), 1) and (p[0, 20:] == 0).all()
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(p > 0, p * np.log(p), 0).sum(1)
    assert np.allclose(entropy, np.log(8), atol=1e-6)


def test_memberships_equal_their_calibration():
    d = np.sort(np.random.default_rng(4).random((40, 15)), 1)
    d[1, :3] = 0
    w = layout.smooth_weights(d**2, 15)
    for row, weight in zip(d, w, strict=True):
        rho = row[row > 0].min()
        low, high = 1e-9, 1e3
        for _ in range(200):  # brute force: bisection of one row
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(-np.maximum(row - rho, 0) / mid).sum() > np.log2(15) else (mid, high)
        assert np.allclose(weight, np.exp(-np.maximum(row - rho, 0) / low), atol=1e-6)


def test_union_of_memberships(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25), (2, 0, 1.0), (1, 2, 0.125)], "i long, j long, w double")
    got = {(r["i"], r["j"]): r["w"] for r in layout.fuzzy_union(edges).collect()}
    half = {(0, 1): 0.5 + 0.25 - 0.125, (0, 2): 1.0, (1, 2): 0.125}
    assert got == half | {(j, i): w for (i, j), w in half.items()}


def test_curve_is_the_known_one():
    """The parameters that are published for 0.1 and 1."""
    assert np.allclose(layout.curve(0.1, 1.0), (1.577, 0.895), atol=5e-3)


@pytest.mark.parametrize(("scale", "close"), [(1e-6, 1e-6), (1.0, 0.01), (12.0, 0.1)])
def test_grid_forces_are_near_those_of_all_pairs(scale, close):
    """Boxes are at most 1 wide, as in the published method: single pairs are less exact than sums over many."""
    y = np.random.default_rng(5).normal(size=(400, 2)) * scale
    grid = layout.Grid(y)
    potentials, total = grid.potentials(grid.deposit(y))
    node, weight = grid.places(y)
    one, a, b = ((potentials[c][node] * weight).sum(1) for c in range(3))
    q = 1 / (1 + square(y))
    np.fill_diagonal(q, 0)
    force = ((q**2)[:, :, None] * (y[:, None] - y[None])).sum(1)
    assert abs(total / q.sum() - 1) < 0.01
    assert np.linalg.norm(y * one[:, None] - np.stack([a, b], 1) - force) < close * np.linalg.norm(force)


def test_grid_layout_is_as_trustworthy_as_all_pairs(spark):
    x = sheet(2000)
    exact = trust(x, kernels.tsne(x, 30.0, 300))
    got = plane(layout.tsne(frame_of(spark, x), rounds=150, early=50))
    assert got.shape == (2000, 2) and np.isfinite(got).all()
    assert trust(x, got) > exact - 0.02


def test_umap_and_transform_keep_neighbourhoods(spark, monkeypatch):
    x = sheet(1200)
    df = frame_of(spark, x)
    got = plane(layout.umap(df, epochs=100))
    assert trust(x, got) > 0.98
    template = layout.umap(df.where("frame % 2 = 0"), epochs=100)
    new = layout.umap_transform(df.where("frame % 2 = 1"), template)
    both = plane(new.unionByName(template.select("frame", "y")))
    assert trust(x, both) > 0.97
    again = layout.umap_transform(df.where("frame % 2 = 1").repartition(7), template)
    assert sorted(map(tuple, ((r[0], *r[1]) for r in again.collect()))) == sorted((r[0], *r[1]) for r in new.collect())


def test_an_epoch_is_the_same_in_one_block_and_in_many():
    rng = np.random.default_rng(6)
    y, i, j, w = rng.normal(size=(50, 2)), np.sort(rng.integers(0, 50, 300)), rng.integers(0, 50, 300), rng.random(300)
    whole = layout._epoch(y, np.arange(50), y, i, j, w, 3, 0, 1.5, 0.9, 0.7, 0, 2.0)
    parts = [layout._epoch(y[a:b], np.arange(a, b), y, i[(i >= a) & (i < b)] - a, j[(i >= a) & (i < b)], w[(i >= a) & (i < b)], 3, 0, 1.5, 0.9, 0.7, a, 2.0) for a, b in ((0, 20), (20, 50))]
    assert np.allclose(whole, np.concatenate(parts))


def test_layouts_of_little(spark):
    for n in (0, 1, 2, 5):
        df = frame_of(spark, np.random.default_rng(n).normal(size=(max(n, 1), 3))).limit(n)
        for made in (layout.umap(df, epochs=3), layout.tsne(df, rounds=3)):
            rows = made.collect()
            assert len(rows) == n and all(len(r["y"]) == 2 and np.isfinite(r["y"]).all() for r in rows)
    for n in (0, 1):
        df = frame_of(spark, np.ones((1, 3))).limit(n)
        assert embed.Embedding().fit(df).template.count() == n


def test_batches_are_embedded_sampled_and_embedded_together(spark):
    x = sheet(600)
    df = frame_of(spark, x).withColumn("batch", F.when(F.col("frame") < 200, 0).when(F.col("frame") < 400, 1))
    model = embed.BatchEmbedding(perplexity=10, rounds=120, sampled=4, sigma=1.0, bins=20)
    placed = model.fit_predict(df, "batch").collect()
    assert len(placed) == 600
    picked = model.picked.collect()
    assert model.template.count() == len(picked) > 0
    assert {r["batch"] for r in picked} == {0, 1, None}
    own = {r["frame"]: r["batch"] for r in df.collect()}
    assert all(own[r["frame"]] == r["batch"] for r in picked)
    counts = {}
    for r in picked:
        counts[r["batch"], r["cluster"]] = counts.get((r["batch"], r["cluster"]), 0) + 1
    assert set(counts.values()) == {4}


def test_large_batches_are_embedded_by_all_tasks(spark):
    """The same rows stand for a batch however it is embedded: all of them are labelled."""
    df = frame_of(spark, sheet(240)).withColumn("batch", F.col("frame") % 2)
    got = embed.batch_clusters(df, "batch", sigma=1.0, bins=20, perplexity=8, rounds=40, most=100)
    assert got.groupBy("batch").count().orderBy("batch").collect() == [(0, 120), (1, 120)]


def test_folds_equal_brute_force(spark):
    x = sheet(150)
    model = embed.Embedding(perplexity=10, rounds=100).fit(frame_of(spark, x))
    got = {r["k"]: r for r in embed.kfold_errors(model, [1, 4]).collect()}
    y = plane(model.template)
    fold = np.array([r[0] for r in model.template.orderBy("frame").select(F.pmod(F.xxhash64("frame", F.lit(0)), F.lit(5))).collect()])
    extent = np.linalg.norm(y.max(0) - y.min(0))
    for k in (1, 4):
        new = np.zeros_like(y)
        for f in range(5):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            at, d = kernels.nearest(x[own], x[rest], k)
            w = 1 / np.maximum(d, d[d > 0].min() / 2)
            new[own] = (y[rest][at] * w[:, :, None]).sum(1) / w.sum(1)[:, None]
        off = ((new - y) ** 2).sum(1)
        assert np.isclose(got[k]["mse"], off.mean() / extent**2) and np.isclose(got[k]["distance"], np.sqrt(off).mean() / extent)
        assert 0 <= got[k]["accuracy"] <= 1
    assert got[4]["best"] == min(got.values(), key=lambda r: r["mse"])["k"]
