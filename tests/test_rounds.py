"""Neighbours and rounds of layouts at size, on small tables."""

import functools
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitlake.operators import embed, forest, layout, neighbors


def rows_of(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>")


def squares(x):
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return d


def test_tsne_and_its_placing_need_no_trees(spark, monkeypatch):
    """Trees for 90 neighbours a row took longer than all rounds."""
    monkeypatch.setattr(forest, "COMPARED_ROWS", 100)
    monkeypatch.setattr(forest.Forest, "lists", lambda *a, **k: pytest.fail("trees"))
    rows = rows_of(spark, np.random.default_rng(0).normal(size=(300, 4)))
    assert layout.tsne(rows, rounds=2, perplexity=5.0).count() == 300
    assert forest.near(rows, rows, 3).count() == 900


def test_a_large_base_is_neither_copied_nor_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", 6000)
    rows = rows_of(spark, np.random.default_rng(0).normal(size=(300, 4)))
    plan = neighbors.knn(rows, rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "CoGroup" not in plan


@pytest.mark.parametrize("held", [64 << 20, 6000])
@pytest.mark.parametrize("k", [3, 40])
def test_neighbours_of_other_parts_equal_brute_force(spark, monkeypatch, held, k):
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", held)
    monkeypatch.setattr(neighbors, "BASE_ROWS", 32)
    x = np.random.default_rng(1).integers(0, 5, (150, 6)).astype(float)
    x[70:100] = x[70]
    part = np.arange(150) % 3
    d = squares(x)
    d[part[:, None] == part] = np.inf
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(150) for r, j in enumerate(np.lexsort((np.arange(150), d[i]))[:k])}
    rows = rows_of(spark, x).withColumn("part", F.col("frame") % 3)
    assert {(r["src"], r["rank"]): (r["dst"], r["d2"]) for r in neighbors.knn(rows, rows, k, part="part").collect()} == want


@pytest.mark.parametrize(("scale", "close"), [(1e-6, 1e-6), (1.0, 0.001), (12.0, 0.05)])
def test_pushes_are_near_those_of_all_pairs(scale, close):
    y = np.random.default_rng(5).normal(size=(400, 2)) * scale
    grid = layout.Grid(y)
    laid = grid.laid(y)
    node, weight = grid.places(y)
    got = np.stack([(grid.field(laid, "push", axis)[node] * weight).sum(1) for axis in range(2)], 1)
    want = ((1 / (1 + ((y[:, None] - y) ** 2).sum(2)) ** 2)[:, :, None] * (y[:, None] - y)).sum(1)
    assert np.linalg.norm(got - want) < close * np.linalg.norm(want)


@pytest.mark.parametrize("edges", [7, 1 << 15])
def test_pulls_equal_their_definition(monkeypatch, edges):
    """Also of rows without edges, and of one with more than are taken at a time."""
    monkeypatch.setattr(layout, "EDGES", edges)
    rng = np.random.default_rng(2)
    every, count = rng.normal(size=(60, 2)).astype(np.float32), rng.integers(0, 5, 20)
    count[[0, 3, 19]], count[7] = 0, 30
    ends = np.concatenate([[0], np.cumsum(count)])
    i, j, w = np.repeat(np.arange(20), count), rng.integers(0, 60, ends[-1]).astype(np.int32), rng.random(ends[-1]).astype(np.float32)
    apart = every[i] - every[j].astype(float)
    want = layout._sums(i, apart * (w / (1 + (apart**2).sum(1)))[:, None], 20)
    assert np.allclose(layout._pull(every[:20], every, ends, j, w), want, atol=1e-5)


def test_edges_given_twice_are_added(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.25), (3, 0, 1.0), (0, 4, 2.0)], "i long, j long, w double")
    (batch,) = layout.graph_blocks(edges, 5).toArrow().to_batches()
    ((_, first, n, ends, j, w),) = layout._read(iter([batch]))
    assert (first, n, ends.tolist(), j.tolist(), w.tolist()) == (0, 5, [0, 2, 2, 2, 3, 3], [1, 4, 0], [0.75, 2.0, 1.0])


def test_folds_need_no_trees(spark, monkeypatch):
    monkeypatch.setattr(forest, "COMPARED_ROWS", 100)
    monkeypatch.setattr(forest.Forest, "lists", lambda *a, **k: pytest.fail("trees"))
    x = np.random.default_rng(3).normal(size=(200, 4))
    part = np.arange(200) % 5
    d = squares(x)
    d[part[:, None] == part] = np.inf
    want = {(i, r + 1): int(j) for i in range(200) for r, j in enumerate(np.argsort(d[i])[:3])}
    rows = rows_of(spark, x).withColumn("fold", F.col("frame") % 5)
    assert {(r["src"], r["rank"]): r["dst"] for r in forest.near_parts(rows, "fold", 3).collect()} == want


def test_large_batches_are_embedded_at_the_same_time(spark, monkeypatch):
    """Few tasks lay the grid of one batch, so the other takes the cores they leave."""
    both, fit = threading.Barrier(2), embed.Embedding.fit
    monkeypatch.setattr(embed.Embedding, "fit", lambda self, *a: (both.wait(20), fit(self, *a))[1])
    rows = rows_of(spark, np.random.default_rng(4).normal(size=(120, 3))).withColumn("batch", F.col("frame") % 2)
    got = embed.batch_clusters(rows, "batch", sigma=1.0, bins=20, perplexity=5, rounds=10, most=50)
    assert got.select("batch", "frame").distinct().count() == 120


def test_rows_that_trees_do_not_serve_meet_all_others(spark, monkeypatch):
    """Vectors without structure: no number of trees reaches the recall, which was an error."""
    x = np.random.default_rng(5).normal(size=(1500, 40))
    rows, d = rows_of(spark, x), squares(x)
    monkeypatch.setattr(forest, "MET_ROWS", 100)
    monkeypatch.setattr(forest, "Forest", functools.partial(forest.Forest, chunk=64, most=8))
    got = {r["src"]: [p["dst"] for p in r["near"]] for r in forest.near_lists(rows, 1500, k=4, target=0.999).collect()}
    assert got == {i: np.argsort(d[i])[:4].tolist() for i in range(1500)}
