"""Principal components of wide features against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitlake.operators import components, reduce


def frame_of(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>").repartition(5)


def exact(x, n):
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1][:n], vectors[:, ::-1][:, :n], float(np.trace(c.T @ c) / len(x))


def apart(a, b):
    """Largest sine between two subspaces."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


@pytest.mark.parametrize("flat", [False, True])
def test_randomised_components_equal_exact_ones(spark, flat):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 40)) * (1 if flat else 0.8 ** np.arange(40)) + 5
    model = components.fit_randomised(frame_of(spark, x), range(40), 6, close=1e-10)
    values, vectors, total = exact(x, 6)
    assert np.allclose(model.variances, values, rtol=1e-9) and np.isclose(model.total, total)
    assert apart(model.components, vectors) < 1e-6
    assert np.allclose(model.mean, x.mean(0))


def test_a_thousand_columns(spark, monkeypatch):
    """Nothing of all pairs of columns: blocks of a few columns a pass."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(400, 8)) * 2.0 ** -np.arange(8)) @ rng.normal(size=(8, 1000)) + rng.normal(size=(400, 1000)) * 1e-3
    seen = []
    product = components._product
    monkeypatch.setattr(components, "_product", lambda *a: (seen.append(a[2].shape), product(*a))[1])
    model = components.fit_randomised(frame_of(spark, x), range(1000), 5)
    values, vectors, _ = exact(x, 5)
    assert apart(model.components, vectors) < 1e-6 and np.allclose(model.variances, values)
    assert max(s[1] for s in seen) == 7 and sum(s[1] for s in seen) < 100


def test_incremental_components(spark, monkeypatch):
    monkeypatch.setattr(components, "MERGED", 2)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3000, 5)) * 2.0 ** -np.arange(5)) @ rng.normal(size=(5, 30)) + 7
    model = components.fit_incremental(frame_of(spark, x), range(30), 4)  # of rank 5: exact
    values, vectors, total = exact(x, 4)
    assert apart(model.components, vectors) < 1e-6 and np.allclose(model.variances, values) and np.isclose(model.total, total)
    noisy = x + rng.normal(size=x.shape) * 0.05
    model = components.fit_incremental(frame_of(spark, noisy), range(30), 4)
    assert apart(model.components, exact(noisy, 4)[1]) < 0.02
    assert np.allclose(model.mean, noisy.mean(0))


def test_scores_by_each_method(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) * 0.7 ** np.arange(12)
    df = frame_of(spark, x).withColumn("other", F.lit("kept"))
    labels = [f"{'vel' if k % 2 else 'ang'}_{k}" for k in range(12)]
    got = {}
    for method in ("exact", "randomised", "incremental"):
        out, names = reduce.pca(df, labels, ["vel", "ang"], 3, method=method)
        rows = out.orderBy("frame").collect()
        assert names == [f"{c}_pc{k}" for c in ("vel", "ang") for k in range(3)] and rows[0]["other"] == "kept"
        got[method] = np.array([r["scores"] for r in rows])
    assert np.allclose(got["exact"], got["randomised"], atol=1e-6)
    assert np.allclose(got["exact"], got["incremental"], atol=1e-6)  # six columns, all kept
    with pytest.raises(ValueError, match="method"):
        reduce.pca(df, labels, ["vel"], 3, method="other")


def test_moments(spark):
    x = np.random.default_rng(4).normal(size=(500, 3)) * [1, 100, 0] + [1e6, 0, 0.1]
    mean, sd = reduce.moments(frame_of(spark, x))
    assert np.allclose(mean, x.mean(0)) and np.allclose(sd[:2], x.std(0)[:2]) and sd[2] == 0 and mean[2] == 0.1
    assert len(reduce.moments(frame_of(spark, x).limit(0))[0]) == 0
