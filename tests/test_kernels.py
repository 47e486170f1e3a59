import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaitlake.operators import kernels


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_spline_goes_through_its_knots_and_reproduces_cubics(n):
    rng = np.random.default_rng(n)
    x = np.sort(rng.uniform(0, 10, n))
    y = rng.normal(size=(n, 2))
    assert np.allclose(kernels.cubic_spline(x, y, x), y)
    if n >= 4:
        cubic = lambda v: np.stack([v**3 - 2 * v, 3 * v**2 + 1], 1)
        at = np.linspace(-2, 12, 30)
        assert np.allclose(kernels.cubic_spline(x, cubic(x), at), cubic(at), atol=1e-6)


def test_gaussian_keeps_a_constant_and_the_sum():
    assert np.allclose(kernels.gaussian(np.full((9, 7), 3.0), 2.0), 3.0)
    grid = np.zeros((41, 41))
    grid[20, 20] = 1
    assert kernels.gaussian(grid, 2.0).sum() == pytest.approx(1.0)


def test_watershed_separates_two_hills():
    y, x = np.mgrid[0:30, 0:40]
    hill = np.exp(-((x - 10) ** 2 + (y - 15) ** 2) / 30) + np.exp(-((x - 30) ** 2 + (y - 15) ** 2) / 30)
    label = kernels.watershed(hill, hill > 1e-3)
    assert set(np.unique(label)) == {0, 1, 2}
    assert label[15, 10] != label[15, 30]


def test_wavelet_power_peaks_at_the_trace_frequency():
    t = np.arange(900) / 90
    freqs = np.linspace(1, 25, 25)
    power = kernels.wavelet_power(np.sin(2 * np.pi * 10 * t), 90, freqs)
    assert power.shape == (900, 25)
    assert abs(freqs[power[200:700].mean(0).argmax()] - 10) <= 1


def test_fft_and_direct_convolution_agree():
    rng = np.random.default_rng(0)
    x, width = rng.normal(size=(500, 2)), 5 * 90 / (2 * np.pi * 3.0)
    wave = np.conj(kernels.morlet(int(min(10 * width, 500)), width)[::-1])
    full = np.stack([np.convolve(x[:, c], wave) for c in range(2)], 1)
    first = (len(full) - 500) // 2
    assert np.allclose(kernels.wavelet_power(x, 90, [3.0]), np.abs(full[first : first + 500]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=7), st.lists(st.integers(0, 3), max_size=7))
def test_levenshtein_is_a_metric(a, b):
    d = kernels.levenshtein(a, b)
    assert d == kernels.levenshtein(b, a)
    assert (d == 0) == (a == b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def test_nearest_breaks_ties_by_position_and_skips():
    base = np.array([[0.0], [0.0], [1.0], [5.0]])
    at, d = kernels.nearest(np.array([[0.0]]), base, 2, np.array([0]))
    assert at.tolist() == [[1, 2]]
    assert d.tolist() == [[0.0, 1.0]]


def test_elastic_nets_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    y = x @ np.array([1.0, -2, 0, 0, 3]) + rng.normal(size=40)
    one, _ = kernels.elastic_net(x, y, 0.2, 0.7)
    c = x - x.mean(0)
    many = kernels.elastic_net_many(c.T @ c / 40, c.T @ (y - y.mean()) / 40, np.array([0.14]), np.array([0.06]))
    assert np.allclose(many[0], one, atol=1e-5)


def test_forest_of_a_constant_is_the_constant():
    assert kernels.forest(np.random.default_rng(0).normal(size=(8, 2)), np.full(8, 2.5), np.zeros(2), trees=5) == 2.5


def test_tsne_keeps_two_clusters_apart():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.1, (20, 5)), rng.normal(5, 0.1, (20, 5))])
    y = kernels.tsne(points, perplexity=5, rounds=250)
    inside = np.linalg.norm(y[:20] - y[:20].mean(0), axis=1).mean()
    assert np.linalg.norm(y[:20].mean(0) - y[20:].mean(0)) > inside
