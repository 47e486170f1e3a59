"""Steps whose work, memory or disk must not grow faster than their input, on small tables."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from gaitlake.operators import embed, forest, kernels, layout, neighbors, stats


@pytest.mark.parametrize("block", [3, 4096])
def test_pairs_meet_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "PAIR_ROWS", block, raising=False)
    x = np.random.default_rng(0).integers(0, 4, (25, 3)).astype(float)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(None, [1.0, 1.0, 1.0])], "k long, x array<double>")
    found = stats.cosine_halves(rows, "k", "x", 9, [2])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    size = np.sqrt((x**2).sum(1))
    want = {(a, b): (x[a] @ x[b]) / (size[a] * size[b]) if size[a] * size[b] else np.nan for a in range(25) for b in range(a + 1, 25) if 2 not in (a, b) and (a < 9) == (b < 9)}
    got = {(r["a"], r["b"]): r["cosine"] for r in found.collect()}
    assert got.keys() == want.keys() and found.count() == len(want)
    assert all(np.isclose(got[p], want[p], rtol=1e-12, equal_nan=True) for p in want)
    assert all(r["half"] == ("Baseline" if r["a"] < 9 else "Lesion") for r in found.collect())


def test_nets_of_cross_validation_solve_systems(spark, monkeypatch):
    """Descent is for what signs leave over: a few nets, not rows times folds times penalties of them."""
    many, descended = kernels.elastic_net_many, []
    monkeypatch.setattr(kernels, "elastic_net_many", lambda gram, cross, l1, *a, **b: (descended.append(np.broadcast_shapes(cross.shape[:-1], l1.shape)), many(gram, cross, l1, *a, **b))[1])
    each = []
    monkeypatch.setattr(stats, "_each_left_out", lambda rows, predict: each.append(predict))
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(5) * 13, 200)
    y = 1.0 + np.arange(200) * 7 % 11
    stats.loo_elastic_net_cv(spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "cat long, x array<double>, y double"))
    descended.clear()
    each[0](np.column_stack([np.ones(40), x[:40], y[:40]]), np.arange(40))
    assert sum(int(np.prod(s)) for s in descended) < 0.01 * 40 * 10 * 350


def test_signed_nets_meet_the_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 30, 4))
    gram, cross = x.transpose(0, 2, 1) @ x / 30, (x.transpose(0, 2, 1) @ rng.normal(size=(6, 30, 1)))[..., 0] / 30
    l1, l2 = np.geomspace(0.3, 1e-4, 20), np.geomspace(0.1, 1e-4, 20)
    many = (gram[:, None], cross[:, None], l1, l2)
    want = kernels.elastic_net_many(*many, rounds=5000, close=1e-14)
    for guess in (np.zeros(4), np.ones(4), np.sign(want)):
        assert np.allclose(kernels.elastic_net_signed(*many, guess), want, atol=1e-10)


@pytest.mark.parametrize("held", [64 << 20, 6000])
def test_neighbours_in_cells_equal_brute_force(spark, monkeypatch, held):
    """Also beyond the bytes that go to every executor, with copies, and by bounds."""
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", held)
    monkeypatch.setattr(neighbors, "BASE_ROWS", 37)
    x = np.random.default_rng(0).integers(0, 6, (150, 6)).astype(float)
    x[70:100] = x[70]
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    bound = np.sort(d, 1)[:, 2]
    rows = spark.createDataFrame([(k, v.tolist(), float(b)) for k, (v, b) in enumerate(zip(x, bound, strict=True))], "frame long, features array<double>, bound double")
    for how in (None, "bound"):
        got = {(r["src"], r["rank"]): r["d2"] for r in neighbors.knn(rows, rows, 4, bound=how).collect()}
        want = {(i, r + 1): v for i in range(150) for r, v in enumerate(np.sort(d[i])[:4]) if how is None or v <= bound[i]}
        assert got == want


@pytest.mark.parametrize("scale", [1.0, 1e17, 1e-17])
@pytest.mark.parametrize("held", [64 << 20, 6000])
def test_neighbours_among_many_copies_have_the_smallest_keys(spark, monkeypatch, held, scale):
    """Also of vectors far from the origin, and beyond what 32-bit numbers hold."""
    monkeypatch.setattr(neighbors, "BROADCAST_BYTES", held)
    monkeypatch.setattr(neighbors, "BASE_ROWS", 64)
    x = np.random.default_rng(0).integers(0, 6, (200, 6)).astype(float) + 1000
    x[40:160] = x[40]
    x *= scale
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(200) for r, j in enumerate(np.lexsort((np.arange(200), d[i]))[:4])}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>")
    assert {(r["src"], r["rank"]): (r["dst"], r["d2"]) for r in neighbors.knn(rows, rows, 4).collect()} == want


@pytest.mark.parametrize("of", ["geodesic", "shortest_paths"])
def test_edges_of_a_path_are_sought_once(spark, of):
    """Seeking them may be most of the work."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    line = spark.range(50, numPartitions=1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("w")).mapInArrow(count, "src long, dst long, w double")
    if of == "geodesic":
        assert neighbors.geodesic(line, 3, 0, held=5) == [(3, 3.0), (2, 2.0), (1, 1.0), (0, 0.0)]
    else:
        assert neighbors.shortest_paths(line, 0, 3).where("key = 3").first()["d"] == 3.0
    assert made.value == 50


def test_neighbour_batches_hold_single_rows(spark):
    """What a Python worker gets at a time is rows, not pairs of blocks, whose number grows with the table."""
    rows = spark.range(9000).select(F.col("id").alias("frame"), F.array(*(F.rand(k) for k in range(4))).alias("features"))
    plan = neighbors.knn(rows, rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "flat" not in plan


def test_index_query_is_exact_beyond_two_chunks(spark, tmp_path):
    """A recall of 0.95 is not the SQL's result."""
    from gaitlake.plans import registry

    x = np.random.default_rng(0).normal(size=(3000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["src"], r["rank"]): r["dst"] for r in registry.queries()["knn_indexed"](spark, str(tmp_path)).collect()}
    x = x.astype(float)
    d = (x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :5]
    assert got == {(i, r + 1): near[i, r] for i in range(3000) for r in range(5)}


@pytest.mark.parametrize("name", ["tsne", "umap"])
def test_rounds_of_a_layout_send_no_rows_to_the_driver(spark, monkeypatch, name):
    """What the driver gets does not grow with rows times rounds."""
    from pyspark.sql.classic.dataframe import DataFrame

    from gaitlake.operators import layout

    sent = []
    arrow, collect = DataFrame.toArrow, DataFrame.collect
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: (sent.append(t := arrow(self)), t)[1])
    monkeypatch.setattr(DataFrame, "collect", lambda self: (sent.append(t := collect(self)), t)[1])
    rows = spark.range(2100).select(F.col("id").alias("frame"), F.array(*(F.rand(k) for k in range(4))).alias("features"))
    bytes_of = lambda t: t.nbytes if hasattr(t, "nbytes") else sum(len(str(r)) for r in t)
    sizes = []
    for rounds in (2, 6):
        sent.clear()
        made = getattr(layout, name)(rows, **{"tsne": {"rounds": rounds, "early": 1, "perplexity": 5.0}, "umap": {"epochs": rounds}}[name])
        sizes.append(sum(map(bytes_of, sent)))
        assert made.count() == 2100
    assert sizes[1] - sizes[0] < 4 * 1000


def test_folds_share_one_index(spark, monkeypatch):
    """Large templates are indexed once, not once a fold, and no row's neighbours are of its own fold."""
    monkeypatch.setattr(forest, "COMPARED_ROWS", 500)
    searches, found, search = [], [], forest.Forest.search
    monkeypatch.setattr(forest.Forest, "search", lambda self, *a, **b: (searches.append(self), found.append(f := search(self, *a, **b)), f)[2])
    x = np.random.default_rng(0).normal(size=(700, 4))
    rows = spark.createDataFrame([(k, v.tolist(), v[:2].tolist()) for k, v in enumerate(x)], "frame long, features array<double>, y array<double>")
    errors = embed.kfold_errors(embed.Embedding(template=rows), [3], folds=5).collect()
    assert len(errors) == 1 and len(searches) == 1 and searches[0].recall > 0.95
    fold = np.array([r[0] for r in rows.orderBy("frame").select(F.pmod(F.xxhash64("frame", F.lit(0)), F.lit(5))).collect()])
    d = ((x[:, None] - x) ** 2).sum(2)
    d[fold[:, None] == fold] = np.inf
    want = {(i, r + 1): v for i in range(700) for r, v in enumerate(np.sort(d[i])[:3])}
    got = {(r["src"], r["rank"]): r["d2"] for r in found[0].collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[p], want[p]) for p in want)


def test_neighbours_of_umap_are_exact_without_trees(spark, monkeypatch):
    """Trees, of which more rows need more, are for more rows than those that all can meet."""
    x = np.random.default_rng(0).normal(size=(300, 4)).round(1)
    x[200:260] = x[200]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>")
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {i: np.lexsort((np.arange(300), d[i]))[:6].tolist() for i in range(300)}
    indexed = forest.near_lists
    with monkeypatch.context() as m:
        m.setattr(forest, "MET_ROWS", 100)
        assert indexed(rows, 300, k=6).count() == 300
    monkeypatch.setattr(forest.Forest, "lists", lambda *a, **k: pytest.fail("trees"))
    got = {r["src"]: [p["dst"] for p in r["near"]] for r in forest.near_lists(rows, 300, k=6).collect()}
    assert got == want
    template = layout.umap(rows, epochs=2)
    assert template.count() == 300 and layout.umap_transform(rows.where("frame < 9"), template, epochs=2).count() == 9
