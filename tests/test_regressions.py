"""Leave-one-out regressions from sums, and shortest paths, against brute force."""

import numpy as np
import pytest

from gaitlake.operators import kernels, neighbors, stats


def rows_of(spark, x, y):
    return spark.createDataFrame([(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "cat long, x array<double>, y double").repartition(4)


def predicted(found):
    return np.array([r["prediction"] for r in found.orderBy("cat").collect()])


def scaled(a, at):
    sd = a.std(0)
    sd[sd < 1e-12] = 1
    return (a - a.mean(0)) / sd, (at - a.mean(0)) / sd


@pytest.fixture(scope="module")
def shares():
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(5), 40)
    x[:, 4] = 0.25  # a constant column
    return x, 1 + 5 * x[:, 0] + 2 * x[:, 1] + rng.random(40)


def test_least_squares(spark, shares):
    x, y = shares
    want = [x[i] @ np.linalg.lstsq(np.delete(x, i, 0), np.delete(y, i), rcond=None)[0] for i in range(len(y))]
    found = stats.loo_lstsq(rows_of(spark, x, y))
    assert np.allclose(predicted(found), want)
    assert np.isclose(stats.r_squared_of(found), stats.r_squared(y, np.array(want)))
    twice = np.concatenate([x, x[:, :2]], 1)  # of deficient rank: the smallest norm
    want = [twice[i] @ np.linalg.lstsq(np.delete(twice, i, 0), np.delete(y, i), rcond=None)[0] for i in range(len(y))]
    assert np.allclose(predicted(stats.loo_lstsq(rows_of(spark, twice, y))), want)


def test_elastic_net(spark, shares):
    x, y = shares
    want = []
    for i in range(len(y)):
        a, at = scaled(np.delete(x, i, 0), x[i])
        w, c = kernels.elastic_net(a, np.log2(np.delete(y, i)), 0.1, 0.7)
        want.append(at @ w + c)
    assert np.allclose(predicted(stats.loo_elastic_net(rows_of(spark, x, y))), want, atol=1e-6)


@pytest.mark.parametrize("n", [40, 13, 4])
def test_elastic_net_by_cross_validation(spark, shares, n):
    x, y = shares[0][:n], shares[1][:n]
    ratios, alphas = (0.1, 0.7, 1.0), 8
    want = []
    for i in range(n):
        b = np.delete(y, i)
        a, at = scaled(np.delete(x, i, 0), x[i])
        ratio = np.repeat(np.array(ratios), alphas)
        alpha = np.maximum(np.abs((a - a.mean(0)).T @ (b - b.mean())).max() / len(b) / ratio, 1e-12) * np.tile(np.geomspace(1, 1e-3, alphas), len(ratios))
        error = np.zeros(len(alpha))
        for part in np.array_split(np.arange(len(b)), min(10, len(b))):
            p, t = np.delete(a, part, 0), np.delete(b, part)
            w = kernels.elastic_net_many((p - p.mean(0)).T @ (p - p.mean(0)) / len(t), (p - p.mean(0)).T @ (t - t.mean()) / len(t), alpha * ratio, alpha * (1 - ratio))
            error += ((b[part, None] - t.mean() - (a[part] - p.mean(0)) @ w.T) ** 2).sum(0)
        k = int(error.argmin())
        w, c = kernels.elastic_net(a, b, alpha[k], ratio[k])
        want.append(at @ w + c)
    assert np.allclose(predicted(stats.loo_elastic_net_cv(rows_of(spark, x, y), ratios, alphas)), want, atol=1e-5)


def test_cross_validation_needs_rows(spark, shares):
    with pytest.raises(ValueError, match="three rows"):
        stats.loo_elastic_net_cv(rows_of(spark, shares[0][:2], shares[1][:2]))


def test_shortest_paths_equal_the_heap(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.random(90).round(3) ** 2, strict=True)]
    edges += [(100 + k, 101 + k, 0.0 if k % 5 == 0 else 0.01) for k in range(25)] + [(0, 100, 0.5), (200, 201, 1.0), (3, 3, 0.2)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    far = {r["key"]: r["d"] for r in neighbors.shortest_paths(df, 0).collect()}
    keys = {k for e in edges for k in e[:2]}
    for k in keys:
        heap = neighbors.geodesic(df, k, 0, held=10**6) if k % 9 in (0, 1) else None
        if heap is not None:
            assert (k in far) == bool(heap) and (not heap or np.isclose(far[k], heap[0][1]))
    path = neighbors.geodesic(df, 125, 0, held=0)  # a long path, found in doubling steps
    assert path[0][0] == 125 and path[-1] == (0, 0.0) and len(path) == 27 and np.isclose(path[0][1], far[125])
    assert all(a[1] >= b[1] for a, b in zip(path, path[1:], strict=False))
    assert neighbors.geodesic(df, 200, 0, held=0) == [] and neighbors.geodesic(df, 7, 7, held=0) == [(7, 0.0)]
    with pytest.raises(ValueError, match="negative"):
        neighbors.shortest_paths(spark.createDataFrame([(0, 1, -1.0)], "src long, dst long, w double"), 0)
