"""NumPy kernels on one session or one bounded grid; no Spark here."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np


def second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives, at its knots, of the not-a-knot cubic through (x, y), y of any number of columns; two knots give a line, three a parabola."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    column = lambda v: v.reshape(-1, *[1] * (y.ndim - 1))
    m = np.zeros_like(y)
    if n < 3:
        return m
    h = np.diff(x)
    slope = np.diff(y, axis=0) / column(h)
    if n == 3:
        m[:] = 2 * (slope[1] - slope[0]) / (x[2] - x[0])
        return m
    low, mid, high = np.zeros(n), np.ones(n), np.zeros(n)
    right = np.zeros_like(y)
    low[1:-1], mid[1:-1], high[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    right[1:-1] = 6 * np.diff(slope, axis=0)
    # The third derivative is continuous at the second and the last but one knot, which gives the end values as
    # combinations of two inner ones.
    a, b = h[0] / h[1], h[-1] / h[-2]
    mid[1] += low[1] * (1 + a)
    high[1] -= low[1] * a
    mid[-2] += high[-2] * (1 + b)
    low[-2] -= high[-2] * b
    c, d = np.zeros(n), np.zeros_like(y)
    for i in range(1, n - 1):
        under = low[i] if i > 1 else 0.0
        over = high[i] if i < n - 2 else 0.0
        pivot = mid[i] - under * c[i - 1]
        c[i] = over / pivot
        d[i] = (right[i] - under * d[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        m[i] = d[i] - c[i] * m[i + 1] if i < n - 2 else d[i]
    m[0] = (1 + a) * m[1] - a * m[2]
    m[-1] = (1 + b) * m[-2] - b * m[-3]
    return m


def spline_value(t: np.ndarray, step: np.ndarray, y0: np.ndarray, y1: np.ndarray, m0: np.ndarray, m1: np.ndarray) -> np.ndarray:
    """Value at a distance ``t`` behind a knot of the cubic between it and the next, ``step`` further, by their values and second derivatives."""
    return y0 + t * ((y1 - y0) / step - step * (2 * m0 + m1) / 6) + t * t * m0 / 2 + t**3 * (m1 - m0) / (6 * step)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic through (x, y), y of any number of columns, extrapolated at the ends.

    One knot gives a constant, two a line, three a parabola.
    """
    x, at, y = np.asarray(x, float), np.asarray(at, float), np.asarray(y, float)
    if len(x) == 0:
        raise ValueError("a spline needs a knot")
    if len(x) == 1:
        return np.repeat(y, len(at), axis=0)
    m = second_derivatives(x, y)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    column = lambda v: v.reshape(-1, *[1] * (y.ndim - 1))
    return spline_value(column(at - x[k]), column(x[k + 1] - x[k]), y[k], y[k + 1], m[k], m[k + 1])


def rolling_deviation(x: np.ndarray, half: int) -> np.ndarray:
    """Population deviation over 2 * half + 1 rows around each, end rows repeated beyond the ends."""
    k = 2 * half + 1
    # Around the mean of all rows, so that running sums stay small.
    padded = np.pad(x - x.mean(0), [(half, half)] + [(0, 0)] * (x.ndim - 1), mode="edge")
    sums = [np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(p, 0)]) for p in (padded, padded**2)]
    mean, square = ((s[k:] - s[:-k]) / k for s in sums)
    return np.sqrt(np.maximum(square - mean**2, 0))


def motion(x: np.ndarray, widths: Sequence[int], rate: float, std: bool = True, norm: bool = True, absolute: bool = False) -> np.ndarray:
    """Of frames x points x axes, for each half-width and point the centred difference times rate / (2w + 1), end frames repeated beyond the ends; then, with ``std``, the deviations of the frame-to-frame velocity over the same windows. ``norm`` puts the norm over the axes before them; ``absolute`` takes the size of differences."""
    n, at = len(x), np.arange(len(x))
    led = lambda d: np.concatenate([np.sqrt((d**2).sum(2, keepdims=True)), d], 2) if norm else d
    parts = [led((x[np.minimum(at + w, n - 1)] - x[np.maximum(at - w, 0)]) * (rate / (2 * w + 1))) for w in widths]
    if absolute:
        parts = [np.abs(p) for p in parts]
    if std:
        step = led(np.diff(x, axis=0, prepend=x[:1]) * rate)
        parts += [rolling_deviation(step, w) for w in widths]
    return np.concatenate([p.reshape(n, -1) for p in parts], 1)


def morlet(points: int, scale: float, w0: float = 5.0) -> np.ndarray:
    x = np.arange(points) - (points - 1) / 2
    return np.pi**-0.25 * np.sqrt(1 / scale) * np.exp(1j * w0 * x / scale) * np.exp(-(x**2) / (2 * scale**2))


def wavelet_width(rate: float, freqs: np.ndarray, w0: float = 5.0) -> np.ndarray:
    return w0 * rate / (2 * np.pi * np.asarray(freqs, float))


def wavelet_power(traces: np.ndarray, rate: float, freqs: np.ndarray, w0: float = 5.0, frames: int | None = None) -> np.ndarray:
    """|continuous wavelet transform| of traces (frames x columns, or one trace): a column for each trace and frequency, trace by trace. A wavelet has ten widths, but no more points than the session has ``frames`` (default: as many as the traces)."""
    traces = np.asarray(traces, float).reshape(len(traces), -1)
    n, widths = len(traces), wavelet_width(rate, freqs, w0)
    out = np.zeros((n, traces.shape[1], len(widths)))
    if not n:
        return out.reshape(0, -1)
    points = [int(min(10 * w, frames or n)) for w in widths]
    size = 1 << (n + max(points) - 2).bit_length()
    spectrum = np.fft.fft(traces, size, axis=0)
    for k, (width, m) in enumerate(zip(widths, points, strict=True)):
        wave = np.conj(morlet(m, width, w0)[::-1])
        full = np.fft.ifft(spectrum * np.fft.fft(wave, size)[:, None], axis=0)
        first = (m - 1) // 2
        out[:, :, k] = np.abs(full[first : first + n])
    return out.reshape(n, -1)


def running_median(x: np.ndarray, length: int) -> np.ndarray:
    """Median over ``length`` values around each, mirrored at the ends, of an even number the upper one of the middle two; NaN does not count.

    Two heaps hold the lower and the upper half of the window; values that have
    left it are taken off when they come to the top, so that a step takes the
    logarithm of the window's length.
    """
    n, half = len(x), length // 2
    ahead = length - 1 - half
    low: list[tuple[float, int]] = []
    high: list[tuple[float, int]] = []
    side: dict[int, bool] = {}  # whether the value at a place is in the upper half
    sizes = [0, 0]

    def value(p: int) -> float:
        q = -1 - p if p < 0 else 2 * n - 1 - p if p >= n else p
        return x[q] if 0 <= q < n else np.nan

    def clean(heap: list[tuple[float, int]], upper: bool) -> None:
        while heap and side.get(heap[0][1]) is not upper:
            heapq.heappop(heap)

    def settle() -> None:
        # The lower half has size // 2 values; the median is the first of the upper.
        want = sum(sizes) // 2
        while sizes[0] > want:
            clean(low, False)
            v, p = heapq.heappop(low)
            heapq.heappush(high, (-v, p))
            side[p] = True
            sizes[0], sizes[1] = sizes[0] - 1, sizes[1] + 1
        while sizes[0] < want:
            clean(high, True)
            v, p = heapq.heappop(high)
            heapq.heappush(low, (-v, p))
            side[p] = False
            sizes[0], sizes[1] = sizes[0] + 1, sizes[1] - 1

    def add(p: int) -> None:
        v = value(p)
        if np.isnan(v):
            return
        clean(high, True)
        upper = bool(not high or v >= high[0][0])
        heapq.heappush(high if upper else low, (v if upper else -v, p))
        side[p] = upper
        sizes[upper] += 1
        settle()

    def remove(p: int) -> None:
        if p in side:
            sizes[side.pop(p)] -= 1
            settle()

    out = np.full(n, np.nan)
    for p in range(-half, ahead):
        add(p)
    for t in range(n):
        add(t + ahead)
        remove(t - half - 1)
        clean(high, True)
        if high:
            out[t] = high[0][0]
    return out


def gaussian(grid: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian filter, edges mirrored (d c b a | a b c d | d c b a)."""
    reach = int(truncate * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (x / sigma) ** 2)
    kernel /= kernel.sum()
    out = grid.astype(float)
    for axis in range(out.ndim):
        padded = np.pad(out, [(reach, reach) if k == axis else (0, 0) for k in range(out.ndim)], mode="symmetric")
        out = np.apply_along_axis(np.convolve, axis, padded, kernel, mode="valid")
    return out


def watershed(height: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels of the basins of -height's minima by priority flood; 0 outside the mask.

    Peaks are plateaus of 4-neighbours with no higher neighbour, numbered in
    reading order; a cell takes the label of the basin that reaches it first.
    """
    rows, columns = height.shape
    label = np.zeros(height.shape, int)
    seen = np.zeros(height.shape, bool)
    near = lambda r, c: [(a, b) for a, b in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)) if 0 <= a < rows and 0 <= b < columns]
    count, queue, order = 0, [], 0
    for r, c in np.argwhere(mask):
        if seen[r, c]:
            continue
        plateau, stack, peak = [], [(r, c)], True
        seen[r, c] = True
        while stack:
            p = stack.pop()
            plateau.append(p)
            for q in near(*p):
                if height[q] > height[p]:
                    peak = False
                elif height[q] == height[p] and mask[q] and not seen[q]:
                    seen[q] = True
                    stack.append(q)
        if peak:
            count += 1
            for p in plateau:
                label[p] = count
                heapq.heappush(queue, (-height[p], order, p))
                order += 1
    while queue:
        _, _, p = heapq.heappop(queue)
        for q in near(*p):
            if mask[q] and not label[q]:
                label[q] = label[p]
                heapq.heappush(queue, (-height[q], order, q))
                order += 1
    return label


def segmented(xy: np.ndarray, bins: int = 1000, sigma: float = 15.0, least: float = 1e-3) -> np.ndarray:
    """Number of each point's basin in the logarithmic density of all of them on bins x bins cells between their extremes, 0 below ``least``."""
    low, high = xy.min(0), xy.max(0)
    cell = np.clip(np.floor((xy - low) / np.where(high > low, high - low, 1) * bins).astype(int), 0, bins - 1)
    row, col = bins - 1 - cell[:, 1], cell[:, 0]
    counts = np.bincount(row * bins + col, minlength=bins * bins).reshape(bins, bins)
    height = np.log1p(gaussian(counts, sigma))
    return watershed(height, height > least)[row, col]


def nearest(queries: np.ndarray, base: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions in base, squared distances) of the k nearest rows of each query, ties by position; ``skip`` names one position to leave out for each query."""
    d = (queries**2).sum(1)[:, None] - 2 * queries @ base.T + (base**2).sum(1)
    if skip is not None:
        has = np.flatnonzero(skip >= 0)
        d[has, skip[has]] = np.inf
    k = min(k, base.shape[0])
    # Enough of them by the fast formula, then exactly.
    some = np.argpartition(d, min(k + 8, d.shape[1]) - 1, axis=1)[:, : k + 8]
    exact = ((queries[:, None] - base[some]) ** 2).sum(2)
    exact[np.isinf(np.take_along_axis(d, some, 1))] = np.inf
    order = np.lexsort((some, exact), axis=1)[:, :k]
    return np.take_along_axis(some, order, 1), np.take_along_axis(exact, order, 1)


def tsne(points: np.ndarray, perplexity: float = 30.0, rounds: int = 500, seed: int = 0, rate: float | None = None, exaggeration: float = 1.5) -> np.ndarray:
    """Exact t-SNE to two dimensions, for a template of bounded size; affinities count twelvefold in the first 100 rounds and ``exaggeration``-fold after them."""
    n = len(points)
    if n < 2:
        return np.zeros((n, 2))
    perplexity, rate = min(perplexity, max(1.0, (n - 1) / 3)), rate or max(n / 48, 5.0)
    square = (points**2).sum(1)
    d = np.maximum(square[:, None] + square - 2 * points @ points.T, 0)
    p = np.zeros((n, n))
    for i in range(n):
        own = np.delete(d[i], i)
        own = own - own.min()
        low, high, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-own * beta)
            s = e.sum()
            entropy = np.log(s) + beta * (own * e).sum() / s
            if abs(entropy - np.log(perplexity)) < 1e-5:
                break
            if entropy > np.log(perplexity):
                low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = e / s
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    centred = points - points.mean(0)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, 2)) + (centred @ np.linalg.eigh(centred.T @ centred)[1][:, :-3:-1])[:, :2] * 1e-4 if points.shape[1] >= 2 else np.random.default_rng(seed).normal(0, 1e-4, (n, 2))
    step, gain = np.zeros_like(y), np.ones_like(y)
    for r in range(rounds):
        square = (y**2).sum(1)
        q = 1 / (1 + np.maximum(square[:, None] + square - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        pull = (p * (12 if r < 100 else exaggeration) - np.maximum(q / q.sum(), 1e-12)) * q
        slope = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(np.where(np.sign(slope) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if r < 100 else 0.8) * step - rate * gain * slope
        y = y + step
        y -= y.mean(0)
    return y


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, ratio: float, rounds: int = 2000, close: float = 1e-8) -> tuple[np.ndarray, float]:
    """(weights, intercept) of 1/2n |y - xw - b|^2 + alpha * (ratio |w|_1 + (1 - ratio)/2 |w|^2) by coordinate descent."""
    n = len(y)
    mean_x, mean_y = x.mean(0), y.mean()
    x, rest = x - mean_x, y - mean_y
    w, square = np.zeros(x.shape[1]), (x**2).sum(0) / n
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if square[j] == 0:
                continue
            rho = x[:, j] @ rest / n + square[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (square[j] + alpha * (1 - ratio))
            if new != w[j]:
                rest = rest - x[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most < close:
            break
    return w, float(mean_y - mean_x @ w)


def elastic_net_many(gram: np.ndarray, cross: np.ndarray, l1: np.ndarray, l2: np.ndarray, rounds: int = 300, close: float = 1e-7) -> np.ndarray:
    """Weights of many elastic nets at once, from (..., d, d) centred Gram matrices and (..., d) cross products, both by row."""
    w = np.zeros(np.broadcast_shapes(cross.shape, l1.shape + (1,)))
    square = np.diagonal(gram, axis1=-2, axis2=-1)
    for _ in range(rounds):
        most = 0.0
        for j in range(w.shape[-1]):
            rho = cross[..., j] - (gram[..., j, :] * w).sum(-1) + square[..., j] * w[..., j]
            new = np.sign(rho) * np.maximum(np.abs(rho) - l1, 0) / np.maximum(square[..., j] + l2, 1e-300)
            most = max(most, float(np.abs(new - w[..., j]).max()))
            w[..., j] = new
        if most < close:
            break
    return w


def elastic_net_signed(gram: np.ndarray, cross: np.ndarray, l1: np.ndarray, l2: np.ndarray, signs: np.ndarray, rounds: int = 300, close: float = 1e-7) -> np.ndarray:
    """Weights of many elastic nets, from a guess of their signs (0: weight 0), which are changed until the conditions of the optimum hold.

    Where signs are known, the weights solve a linear system. Only nets whose
    conditions fail are changed, by one sign each time: a weight with the wrong
    sign becomes 0, or else the most correlated of the others is taken in. What
    is left after that (nearly collinear columns without ``l2``) is descended on
    by ``elastic_net_many``.
    """
    shape, d = np.broadcast_shapes(cross.shape[:-1], l1.shape), cross.shape[-1]
    # Numbers of one place of all nets lie side by side.
    last = lambda x, more: np.ascontiguousarray(np.moveaxis(np.broadcast_to(x, shape + more).reshape(-1, *more), 0, -1))
    g, c, s = last(gram, (d, d)), last(cross, (d,)), last(signs, (d,)).astype(float)
    thin, thick = last(l1, ()), last(l2, ())
    out = np.zeros_like(c)
    todo = np.arange(c.shape[1])
    for _ in range(4 * d):
        own, at, one, two, sign = (g, c, thin, thick, s) if len(todo) == c.shape[1] else (g[:, :, todo], c[:, todo], thin[todo], thick[todo], s[:, todo])
        w, sound = _solved(own, at, one, two, sign)
        rest = at - np.einsum("ijk,jk->ik", own, w) - two * w
        active = sign != 0
        wrong = np.where(active & (w * sign <= 0), -w * sign + 1e-300, 0.0)
        beyond = np.where(active, 0.0, np.abs(rest) - one)
        tight = 1e-12 * np.maximum(np.abs(at).max(0), one)
        right = sound & ~wrong.any(0) & (beyond <= tight).all(0)
        out[:, todo[right]] = w[:, right]
        left = ~right
        todo, sign, rest, wrong, beyond = todo[left], sign[:, left], rest[:, left], wrong[:, left], beyond[:, left]
        if not len(todo):
            break
        k = np.arange(len(todo))
        drop, take = wrong.argmax(0), beyond.argmax(0)
        bad = wrong.any(0)
        j = np.where(bad, drop, take)
        sign[j, k] = np.where(bad, 0.0, np.sign(rest[take, k]))
        s[:, todo] = sign
    if len(todo):
        out[:, todo] = elastic_net_many(np.moveaxis(g[:, :, todo], -1, 0), c[:, todo].T, thin[todo], thick[todo], rounds, close).T
    return np.moveaxis(out, 0, -1).reshape(*shape, d)


def _solved(gram: np.ndarray, cross: np.ndarray, l1: np.ndarray, l2: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of given signs, whether their system could be solved), by elimination; nets lie along the last axis."""
    d, active = len(cross), sign != 0
    a = gram * (active[:, None] & active)
    b = (cross - l1 * sign) * active
    sound = np.ones(cross.shape[1], bool)
    for j in range(d):
        a[j, j] = np.where(active[j], a[j, j] + l2, 1.0)
    scale = np.stack([a[j, j] for j in range(d)])
    for j in range(d):
        sound &= a[j, j] > 1e-10 * scale[j]
        pivot = np.where(sound, a[j, j], 1.0)
        for i in range(j + 1, d):
            f = a[i, j] / pivot
            a[i, j:] -= f * a[j, j:]
            b[i] -= f * b[j]
    w = np.zeros_like(b)
    for j in range(d - 1, -1, -1):
        w[j] = (b[j] - (a[j, j + 1 :] * w[j + 1 :]).sum(0)) / np.where(sound, a[j, j], 1.0)
    return w, sound


def forest(x: np.ndarray, y: np.ndarray, at: np.ndarray, trees: int = 100, seed: int = 0) -> float:
    """Prediction at one point of a random forest: bootstrapped regression trees, all features, grown until leaves are pure or single."""
    rng = np.random.default_rng(seed)
    total = 0.0
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        while True:
            a, b = x[rows], y[rows]
            if len(b) < 2 or (b == b[0]).all():
                break
            best = (np.inf, -1, 0.0)
            for j in range(a.shape[1]):
                order = np.argsort(a[:, j], kind="stable")
                v, t = a[order, j], b[order]
                n = np.arange(1, len(t))
                left, square = np.cumsum(t)[:-1], np.cumsum(t * t)
                error = square[-1] - left**2 / n - (t.sum() - left) ** 2 / (len(t) - n)
                error[v[1:] == v[:-1]] = np.inf
                k = int(error.argmin())
                if error[k] < best[0]:
                    best = (error[k], j, (v[k] + v[k + 1]) / 2)
            if best[1] < 0:
                break
            # Only the branch that the point takes is grown.
            side = a[:, best[1]] <= best[2]
            rows = rows[side if at[best[1]] <= best[2] else ~side]
        total += float(y[rows].mean())
    return total / trees


def levenshtein(a: list, b: list) -> int:
    """Edit distance of two sequences, unit costs."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
