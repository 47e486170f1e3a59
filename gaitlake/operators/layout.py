"""Layouts of neighbour graphs on the plane: t-SNE through a grid, and UMAP.

The graph lies in blocks of rows, one record each, on the executors. Rows are
moved synchronously: in each round a task reads the coordinates of all rows (a
few numbers a row, at most MOST_ROWS rows) from the files that the tasks of the
round before left in the shared folder, a file a block, and leaves those of its
own rows. A round is a job or two, so lost executors cost no more than the
round. Nothing that grows with the rows passes through the driver, which gets a
line from each task.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.functions.shared import discard, folder, got, numbered, put, written
from gaitlake.operators import reduce
from gaitlake.operators.forest import near_lists

#: Rows of a block; most rows of a layout, of whose coordinates every task holds 8 bytes a row.
BLOCK_ROWS, MOST_ROWS = 2048, 8_000_000
BLOCKS = "block int, first long, n int, file string"
#: Edges that are taken at a time, so that what is computed of them stays near the core.
EDGES = 1 << 15


def graph_blocks(edges: DataFrame, rows: int) -> DataFrame:
    """(block, first, n, file): the edges (i, j, w) that leave each run of BLOCK_ROWS rows, from ``first`` on, lie in a file of the shared folder in order of i and j; every block of the ``rows`` rows has one. Weights of an edge that is given more than once are added."""
    shared = folder(edges.sparkSession)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("i", "ascending"), ("j", "ascending")]) if table.num_rows > 1 else table
        block = table["block"][0].as_py()
        first = block * BLOCK_ROWS
        i, j, w = (table[c].drop_null().to_numpy() for c in ("i", "j", "w"))
        new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)])
        i, j, w = i[new], j[new], np.add.reduceat(w, new) if len(new) else w
        n, file = min(rows - first, BLOCK_ROWS), f"{shared}/edges-{block}"
        ends = np.searchsorted(i, first + np.arange(n + 1))
        put(file, b"".join(a.tobytes() for a in (ends.astype(np.int64), j.astype(np.int32), w.astype(np.float32))))
        return pa.table({"block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()), "n": pa.array([n], pa.int32()), "file": pa.array([file])})

    blocks = -(-rows // BLOCK_ROWS)
    spine = edges.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("w"))
    held = edges.select(F.floor(F.col("i") / BLOCK_ROWS).cast("int").alias("block"), F.col("i").cast("long"), F.col("j").cast("long"), F.col("w").cast("double")).union(spine)
    return written(held.groupBy("block").applyInArrow(packed, BLOCKS))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, first, n, ends, j, w) of each block: row r of it has the edges from ends[r] to ends[r + 1]."""
    for batch in batches:
        for record in batch.to_pylist():
            n, data = record["n"], got(record["file"])
            ends = np.frombuffer(data, np.int64, n + 1)
            j, w = (np.frombuffer(data, t, ends[-1], 8 * (n + 1) + at * ends[-1]) for t, at in ((np.int32, 0), (np.float32, 4)))
            yield record["block"], record["first"], n, ends, j, w


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1)


def _ragged(near: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(squared distances, a row for each list, infinite beyond its end; the places of real ones; their keys)."""
    ends = np.asarray(near.offsets) - near.offsets[0].as_py()
    n, flat = np.diff(ends), near.flatten()
    real = np.arange(n.max(initial=0)) < n[:, None]
    d = np.full(real.shape, np.inf)
    d[real] = flat.field("d2").to_numpy()
    return d, real, flat.field("dst").to_numpy()


def affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Each row's Gaussian weights of its neighbours, of sum 1 and entropy ln(perplexity), or what its neighbours allow; infinite distances get none."""
    low, high, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
    if not d2.size:
        return d2
    d = d2 - d2[:, :1]
    ok = np.isfinite(d)
    d = np.where(ok, d, 0.0)
    for _ in range(64):
        e = np.where(ok, np.exp(-d * beta[:, None]), 0.0)
        s = e.sum(1)
        flat = np.log(s) + beta * (d * e).sum(1) / s > np.log(perplexity)
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return e / s[:, None]


def smooth_weights(d2: np.ndarray, k: int) -> np.ndarray:
    """Each row's fuzzy memberships exp(-(d - rho) / sigma): rho is the smallest distance above 0, sigma makes the sum log2(k); infinite distances get none."""
    if not d2.size:
        return d2
    d, target = np.sqrt(d2), np.log2(max(k, 2))
    ok = np.isfinite(d)
    rho = np.where(ok & (d > 0), d, np.inf).min(1)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    over = np.where(ok, np.maximum(d - rho[:, None], 0), 0.0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        total = np.where(ok, np.exp(-over / sigma[:, None]), 0.0).sum(1)
        large = total > target
        low, high = np.where(large, low, sigma), np.where(large, sigma, high)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    # A row's sigma is at least a thousandth of its mean distance.
    mean = np.where(ok, d, 0.0).sum(1) / np.maximum(ok.sum(1), 1)
    sigma = np.maximum(sigma, np.maximum(1e-3 * mean, 1e-300))
    return np.where(ok, np.exp(-over / sigma[:, None]), 0.0)


def weighted(lists: DataFrame, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, j, w) from (src, near): the weights that ``weigh`` gives to each row of squared distances."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                d, real, dst = _ragged(part.column("near"))
                yield pa.record_batch({"i": np.repeat(part.column("src").to_numpy(), real.sum(1)), "j": dst, "w": weigh(d)[real]})

    return lists.mapInArrow(edges, "i long, j long, w double")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", "w").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def _every(path: str, rows: int, kind: type = np.float32) -> np.ndarray:
    """Coordinates of all rows from the blocks' files below ``path``."""
    y = np.empty((rows, 2), kind)
    for first in range(0, rows, BLOCK_ROWS):
        own = y[first : first + BLOCK_ROWS]
        own[:] = np.frombuffer(got(f"{path}/y-{first // BLOCK_ROWS}"), kind).reshape(own.shape)
    return y


def _lines(steps: DataFrame) -> None:
    """Runs the tasks of a round; each returns a line."""
    steps.collect()


def kept(points: DataFrame, path: str, kind: type = np.float32, noise: float = 0.0, seed: int = 0) -> None:
    """Leaves the coordinates of the rows (i, a, b) as the blocks' files below ``path``, with a little noise."""

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        block = table["block"][0].as_py()
        y = np.stack([table[c].to_numpy() for c in "ab"], 1) + np.random.default_rng((seed, block)).normal(0, noise, (table.num_rows, 2))
        put(f"{path}/y-{block}", y.astype(kind).tobytes())
        return pa.table({"block": pa.array([block], pa.int32())})

    held = points.select(F.floor(F.col("i") / BLOCK_ROWS).cast("int").alias("block"), F.col("i").cast("long"), F.col("a").cast("double"), F.col("b").cast("double"))
    held.groupBy("block").applyInArrow(packed, "block int").agg(F.count("*")).collect()


def start(points: DataFrame, path: str, spread: float, seed: int) -> None:
    """First coordinates of the rows (i, x), left below ``path``: the two main components, scaled to a deviation of ``spread``, with a little noise."""
    width = points.select(F.size("x")).first()[0]
    if width >= 2:
        main = written(reduce.project(points.select("i", "x"), reduce.fit_pca(points.select("x"), range(width), 2, "x"), "x").select("i", F.col("scores")[0].alias("a"), F.col("scores")[1].alias("b")))
        scale = F.lit(spread / (main.select(F.stddev_pop("a")).first()[0] or 1.0))
        kept(main.select("i", (F.col("a") * scale).alias("a"), (F.col("b") * scale).alias("b")), path, noise=spread / 100, seed=seed)
    else:
        kept(points.select("i", F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), path, noise=spread / 100, seed=seed)


# t-SNE --------------------------------------------------------------------------------------------

#: Least boxes of the grid a side; nodes of a box a side; columns that are transformed at a time.
BOXES, NODES, COLUMNS = 50, 3, 64
#: Greatest width of a box: with it, pushes are as exact as those from potentials of boxes 1 wide.
WIDTH = 0.85


def _length(least: int) -> int:
    """The smallest even number from ``least`` on without prime factors above 5, as transforms like."""
    for n in itertools.count(least + least % 2, 2):
        rest = n
        for f in (2, 3, 5):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n


@functools.lru_cache(maxsize=2)
def _spectrum(size: int, step: float, kind: str) -> np.ndarray:
    """A quarter of the transform of a kernel on a plane of ``size`` nodes a side, ``step`` apart: of 1 / (1 + d^2) (all), its square (near), or that times the way along the first axis (push), where it is imaginary."""
    way = np.arange(size // 2 + 1) * step
    kernel = 1 / (1 + way[:, None] ** 2 + way**2)
    if kind != "all":
        kernel *= kernel
    sign = 1
    if kind == "push":
        kernel *= way[:, None]
        # Half the plane away lies no other node.
        kernel[-1], sign = 0, -1
    across = np.concatenate([np.fft.rfft(np.concatenate([k, k[:, -2:0:-1]], 1), axis=1).real for k in np.array_split(kernel, -(-len(kernel) // COLUMNS))])
    down = (np.fft.rfft(np.concatenate([k, sign * k[-2:0:-1]]), axis=0) for k in np.array_split(across, -(-len(kernel) // COLUMNS), axis=1))
    return np.concatenate([d.imag if sign < 0 else d.real for d in down], 1)


class Grid:
    """Boxes over the points, each with NODES x NODES nodes between which potentials are interpolated by parabolas."""

    def __init__(self, y: np.ndarray) -> None:
        low, high = y.min(0).astype(float), y.max(0).astype(float)
        span = float((high - low).max()) or 1.0
        # Sides are multiples of ten boxes, so that few spectra are needed.
        self.boxes = max(BOXES, -(-int(np.ceil(span / WIDTH)) // 10) * 10)
        self.width = min(span / BOXES, WIDTH)
        self.low = (low + high - self.boxes * self.width) / 2
        self.side = self.boxes * NODES

    def places(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, weights): the nine nodes of each point's box and its weight at each."""
        at = (y - self.low) / self.width
        box = np.clip(np.floor(at), 0, self.boxes - 1)
        t = at - box
        a, b, c = t - 1 / 6, t - 1 / 2, t - 5 / 6
        one = np.stack([b * c * 4.5, -9 * a * c, a * b * 4.5], 2)
        node = (box * NODES).astype(np.int64)[:, :, None] + np.arange(NODES)
        return (node[:, 0, :, None] * self.side + node[:, 1, None, :]).reshape(len(y), -1), (one[:, 0, :, None] * one[:, 1, None, :]).reshape(len(y), -1)

    def laid(self, y: np.ndarray, charge: np.ndarray | float = 1.0) -> np.ndarray:
        """One charge of the points on the nodes."""
        out = np.zeros(self.side**2)
        for at in range(0, len(y), 1 << 18):
            node, weight = self.places(y[at : at + (1 << 18)])
            weight *= charge if np.isscalar(charge) else charge[at : at + (1 << 18), None]
            out += np.bincount(node.ravel(), weight.ravel(), self.side**2)
        return out

    def deposit(self, y: np.ndarray) -> np.ndarray:
        """Charges 1, x and y of the points on the nodes."""
        return np.stack([self.laid(y), self.laid(y, y[:, 0]), self.laid(y, y[:, 1])])

    def potentials(self, charges: np.ndarray) -> tuple[np.ndarray, float]:
        """(potentials 1 / (1 + d^2)^2 of the three charges on the nodes, sum over all pairs)."""
        return np.stack([self.field(c, "near") for c in charges]), self.total(charges[0])

    def _columns(self, charges: np.ndarray, kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, transforms of the charges, of the kernel) of some columns at a time, on a plane of twice the side."""
        size = _length(2 * self.side)
        half, quarter = np.fft.rfft(charges.reshape(self.side, self.side), size, axis=1), _spectrum(size, self.width / NODES, kind)
        for first in range(0, half.shape[1], COLUMNS):
            near = quarter[:, first : first + COLUMNS].T
            yield first, np.fft.fft(np.ascontiguousarray(half[:, first : first + COLUMNS].T), size, axis=1), np.concatenate([near, (-1 if kind == "push" else 1) * near[:, -2:0:-1]], 1)

    def field(self, charges: np.ndarray, kind: str, axis: int = 0) -> np.ndarray:
        """What the charges on the nodes do to a point at each node, by a kernel of ``_spectrum``; pushes are those along ``axis``."""
        own = charges.reshape(self.side, self.side)
        size = _length(2 * self.side)
        out = np.empty((self.side, size // 2 + 1), complex)
        for first, each, near in self._columns(own.T if axis else own, kind):
            each *= near
            out[:, first : first + COLUMNS] = np.fft.ifft(each, axis=1)[:, : self.side].T
        found = np.fft.irfft(out * 1j if kind == "push" else out, size, axis=1)[:, : self.side]
        return (found.T if axis else found).ravel()

    def total(self, charges: np.ndarray) -> float:
        """Sum of 1 / (1 + d^2) over all pairs of different points of charge 1."""
        size = _length(2 * self.side)
        # The sum over the nodes, taken from the transforms; all columns but the first and the last stand for two.
        each = np.concatenate([(near * (own.real**2 + own.imag**2)).sum(1) for _, own, near in self._columns(charges, "all")])
        return max(float(2 * each.sum() - each[0] - each[-1]) / size**2 - float(charges.sum()), 1e-12)


def _pull(own: np.ndarray, every: np.ndarray, ends: np.ndarray, j: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of w (y_i - y_j) / (1 + d^2) over the edges of each own row; coordinates are 32-bit numbers, of which a pair is fetched as one of 64 bits."""
    out, others = np.zeros((len(own), 2)), every.view(np.float64).ravel()
    first = 0
    while first < len(own):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + EDGES, "right")) - 1)
        some, count = slice(ends[first], ends[last]), np.diff(ends[first : last + 1])
        at = np.take(others, j[some], mode="clip").view(np.float32).reshape(-1, 2)
        apart = [np.repeat(own[first:last, c], count) - at[:, c] for c in range(2)]
        near = apart[0] * apart[0]
        near += apart[1] * apart[1]
        near += 1
        np.divide(w[some], near, out=near)
        real = np.flatnonzero(count)
        for c in range(2) if len(real) else ():
            out[first + real, c] = np.add.reduceat(apart[c] * near, ends[first:last][real] - ends[first], dtype=np.float64)
        first = last
    return out


def _moved(state: np.ndarray, force: np.ndarray, momentum: float, rate: float) -> np.ndarray:
    """(y, step, gain) after a step of gradient descent with a gain for each number."""
    y, step, gain = state[:, :2], state[:, 2:4], state[:, 4:6]
    gain = np.maximum(np.where(np.sign(force) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
    step = momentum * step - rate * gain * force
    return np.concatenate([y + step, step, gain], 1)


def tsne(points: DataFrame, key: str = "frame", column: str = "features", perplexity: float = 30.0, rounds: int = 500, early: int = 125, exaggeration: float = 1.5, seed: int = 0, target: float = 0.95) -> DataFrame:
    """(key, features, y): t-SNE of all rows to two dimensions; keys are numeric and differ.

    Affinities reach the 3 * perplexity nearest rows, sought with a
    recall of ``target`` or more. In each round three tasks lay all rows onto
    a grid, one each for the sum over all pairs and for the pushes along
    either axis, and then every task moves its rows by their edges and by
    these pushes. Rows beyond MOST_ROWS are an error.
    """
    spark = points.sparkSession
    held = written(numbered(points.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("x")), "key"))
    n = held.count()
    if n > MOST_ROWS:
        raise ValueError(f"a layout has at most {MOST_ROWS} rows")
    if n < 2:
        return held.select(F.col("key").alias(key), F.col("x").alias(column), F.array(F.lit(0.0), F.lit(0.0)).alias("y"))
    perplexity = min(perplexity, max(1.0, (n - 1) / 3))
    lists = near_lists(held, n, None, min(n - 1, int(3 * perplexity)), "i", "x", seed=seed, target=target)
    edges = _both(weighted(lists, lambda d: affinities(d, perplexity) / (2 * n)))
    blocks = graph_blocks(edges, n).repartition(min(-(-n // BLOCK_ROWS), spark.sparkContext.defaultParallelism)).persist()
    shared, rows = folder(spark), n
    start(held, f"{shared}/0", 1e-4, seed)
    tasks = spark.range(0, 3, 1, 3)
    for r in range(rounds):
        now, then = f"{shared}/{r}", f"{shared}/{r + 1}"
        boost, momentum = (12.0, 0.5) if r < early else (exaggeration, 0.8)

        def fields(batches: Iterator[pa.RecordBatch], now: str = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for which in batch.column(0).to_pylist():
                    y = _every(now, rows).astype(float)
                    grid = Grid(y)
                    laid = grid.laid(y)
                    put(f"{now}/field-{which}", np.float64(grid.total(laid)).tobytes() if which == 2 else grid.field(laid, "push", which).astype(np.float32).tobytes())
                yield batch

        def advance(batches: Iterator[pa.RecordBatch], now: str = now, then: str = then, first_round: bool = r == 0, boost: float = boost, momentum: float = momentum) -> Iterator[pa.RecordBatch]:
            every = _every(now, rows)
            grid = Grid(every)
            pushes = [np.frombuffer(got(f"{now}/field-{c}"), np.float32) for c in range(2)]
            total = float(np.frombuffer(got(f"{now}/field-2"))[0])
            for block, first, n, ends, j, w in _read(batches):
                y = every[first : first + n].astype(float)
                rest = np.repeat([[0.0, 0.0, 1.0, 1.0]], n, 0) if first_round else np.frombuffer(got(f"{now}/rest-{block}"), np.float32).reshape(n, 4)
                pull = _pull(every[first : first + n], every, ends, j, w)
                node, weight = grid.places(y)
                push = np.stack([(p[node] * weight).sum(1) for p in pushes], 1) / total
                moved = _moved(np.concatenate([y, rest], 1), 4 * (boost * pull - push), momentum, max(rows / 48, 5.0)).astype(np.float32)
                put(f"{then}/rest-{block}", moved[:, 2:].tobytes())
                put(f"{then}/y-{block}", moved[:, :2].tobytes())
            yield pa.record_batch({"id": pa.array([1], pa.int64())})

        _lines(tasks.mapInArrow(fields, "id long"))
        _lines(blocks.mapInArrow(advance, "id long"))
        discard(spark, now)
    blocks.unpersist()
    return placed(held, f"{shared}/{rounds}", n, key, column)


def placed(held: DataFrame, path: str, rows: int, key: str, column: str) -> DataFrame:
    """(key, column, y) from (i, key, x) and the coordinates of all rows below ``path``, which are deleted; a table."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = None
        for batch in batches:
            y = _every(path, rows).astype(float) if y is None else y
            own = y[batch.column("i").to_numpy()]
            yield pa.record_batch({"key": batch.column("key"), "x": batch.column("x"), "y": pa.ListArray.from_arrays(np.arange(0, 2 * len(own) + 1, 2, dtype=np.int32), pa.array(own.ravel()))})

    out = written(held.select("i", "key", "x").mapInArrow(joined, "key long, x array<double>, y array<double>"))
    discard(held.sparkSession, path)
    return out.select(F.col("key").alias(key), F.col("x").alias(column), "y")


# UMAP ---------------------------------------------------------------------------------------------

#: Rows drawn against each edge, and the most that one pair moves a row.
AGAINST, CLIP = 5, 4.0


def curve(min_dist: float, spread: float) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^(2b)), fitted to 1 within ``min_dist`` and exp(-(d - min_dist) / spread) beyond, by Gauss-Newton steps."""
    d = np.linspace(0, spread * 3, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([0.0, 0.0])  # logarithms of a and b
    error = lambda p: 1 / (1 + np.exp(p[0]) * d ** (2 * np.exp(p[1]))) - want
    damp = 1e-3
    for _ in range(200):
        e = error(p)
        f = e + want
        slope = -f * (1 - f)
        jacobian = np.stack([slope, slope * 2 * np.exp(p[1]) * np.log(d)], 1)
        new = p - np.linalg.solve(jacobian.T @ jacobian + damp * np.eye(2), jacobian.T @ e)
        if (error(new) ** 2).sum() < (e**2).sum():
            p, damp = new, damp / 3
        else:
            damp *= 4
    return float(np.exp(p[0])), float(np.exp(p[1]))


def _attraction(apart: np.ndarray, a: float, b: float) -> np.ndarray:
    d = np.maximum((apart**2).sum(1), 1e-12)
    return np.clip(apart * (-2 * a * b * d ** (b - 1) / (1 + a * d**b))[:, None], -CLIP, CLIP)


def _repulsion(apart: np.ndarray, a: float, b: float) -> np.ndarray:
    d = (apart**2).sum(1)
    return np.clip(apart * (2 * b / ((1e-3 + d) * (1 + a * d**b)))[:, None], -CLIP, CLIP)


def _noise(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the given integers alone, so that draws do not depend on how rows are dealt to tasks."""
    h = np.zeros(1, np.uint64)
    for part in parts:
        h = (h ^ np.asarray(part, np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(float) / 2**53


def _epoch(own: np.ndarray, ids: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, epoch: int, seed: int, a: float, b: float, alpha: float, first: int | None, share: float) -> np.ndarray:
    """Own rows after an epoch: an edge is drawn with probability ``w``, and with it AGAINST rows of ``others`` (never the row itself, own row 0 being their row ``first``). A row moves by the sum of its pairs, over half their number where that is more than one, as all of them are taken at the same place."""
    drawn = np.flatnonzero(_noise(seed, epoch, ids[i], j) < w)
    i, j = i[drawn], j[drawn]
    move = share * _sums(i, _attraction(own[i] - others[j], a, b), len(own))
    against = (_noise(seed + 1, epoch, ids[i][:, None], j[:, None], np.arange(AGAINST)) * len(others)).astype(np.int64).ravel()
    at = np.repeat(i, AGAINST)
    if first is not None:
        real = against != at + first
        against, at = against[real], at[real]
    move += _sums(at, _repulsion(own[at] - others[against], a, b), len(own))
    return own + alpha * move / np.maximum(np.bincount(i, minlength=len(own)) / 2, 1)[:, None]


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """(i, j, w) in both directions: u + v - u v of the memberships of the two rows in each other."""
    pairs = edges.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    # Of two weights, the other is the sum without the larger.
    return _both(pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("s") - F.col("m") * (F.col("s") - F.col("m"))).alias("w")))


def umap(points: DataFrame, key: str = "frame", column: str = "features", neighbors: int = 15, min_dist: float = 0.5, spread: float = 1.0, epochs: int = 200, seed: int = 0, target: float = 0.95) -> DataFrame:
    """(key, features, y): UMAP of all rows to two dimensions; keys are numeric and differ.

    Memberships of the ``neighbors`` nearest rows (the row itself counts as
    one) are calibrated, united, and drawn as edges; edges that would be drawn
    less than once are left to chance, not cut. An epoch is a job; where one
    block has all rows, its task runs all epochs, with the same result. Rows
    beyond MOST_ROWS are an error.
    """
    spark = points.sparkSession
    held = written(numbered(points.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("x")), "key"))
    n = held.count()
    if n > MOST_ROWS:
        raise ValueError(f"a layout has at most {MOST_ROWS} rows")
    if n < 2:
        return held.select(F.col("key").alias(key), F.col("x").alias(column), F.array(F.lit(0.0), F.lit(0.0)).alias("y"))
    k = max(min(n - 1, neighbors - 1), 1)
    lists = near_lists(held, n, None, k, "i", "x", seed=seed, target=target)
    blocks = graph_blocks(fuzzy_union(weighted(lists, lambda d: smooth_weights(d, k + 1))), n)
    blocks = blocks.repartition(min(-(-n // BLOCK_ROWS), spark.sparkContext.defaultParallelism)).persist()
    a, b = curve(min_dist, spread)
    shared, rows = folder(spark), n
    start(held, f"{shared}/0", 5.0 * spread, seed)
    single = n <= BLOCK_ROWS
    for epoch in range(0, epochs, epochs if single else 1):
        last = epochs if single else epoch + 1
        now, then = f"{shared}/{epoch}", f"{shared}/{last}"

        def advance(batches: Iterator[pa.RecordBatch], now: str = now, then: str = then, epoch: int = epoch, last: int = last) -> Iterator[pa.RecordBatch]:
            every = _every(now, rows)
            for block, first, n, ends, j, w in _read(batches):
                i = np.repeat(np.arange(n), np.diff(ends))
                for e in range(epoch, last):
                    own = _epoch(every[first : first + n], np.arange(first, first + n), every, i, j, w, e, seed, a, b, 1 - e / epochs, first, 2.0).astype(np.float32)
                    every = own if single else every
                put(f"{then}/y-{block}", own.tobytes())
            yield pa.record_batch({"id": pa.array([1], pa.int64())})

        _lines(blocks.mapInArrow(advance, "id long"))
        discard(spark, now)
    blocks.unpersist()
    return placed(held, f"{shared}/{epochs}", n, key, column)


def umap_transform(points: DataFrame, template: DataFrame, key: str = "frame", column: str = "features", neighbors: int = 15, min_dist: float = 0.5, spread: float = 1.0, epochs: int = 67, seed: int = 0, target: float = 0.95) -> DataFrame:
    """(key, y) of new rows on a template (key, features, y) that stays where it is: each starts at the mean of its nearest template rows, weighted by its memberships, and is moved by edges drawn to them and rows drawn from the whole template. Each row is on its own, so all epochs are one pass."""
    spark = points.sparkSession
    held = written(numbered(template.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("x"), "y"), "key"))
    n = held.count()
    if n > MOST_ROWS:
        raise ValueError(f"a layout has at most {MOST_ROWS} rows")
    shared = folder(spark)
    kept(held.select("i", F.col("y")[0].alias("a"), F.col("y")[1].alias("b")), shared, float)
    k = max(min(n, neighbors), 1)
    asked = points.select(F.col(key).cast("long").alias("i"), F.col(column).cast("array<double>").alias("x"))
    lists = near_lists(held, n, asked, k, "i", "x", False, seed, target)
    a, b = curve(min_dist, spread)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = None
        for batch in batches:
            y = _every(shared, n, float) if y is None else y
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                src = part.column("src").to_numpy()
                d, real, j = _ragged(part.column("near"))
                w = smooth_weights(d, k)
                own = np.zeros((len(src), 2))
                i = np.repeat(np.arange(len(src)), real.sum(1))
                flat = w[real]
                total = np.bincount(i, flat, len(src))
                own = _sums(i, y[j] * flat[:, None], len(src)) / total[:, None]
                for e in range(epochs):
                    own = _epoch(own, src, y, i, j, flat, e, seed, a, b, (1 - e / epochs) / 4, None, 1.0)
                yield pa.record_batch({"key": src, "y": pa.ListArray.from_arrays(np.arange(0, 2 * len(own) + 1, 2, dtype=np.int32), pa.array(own.ravel()))})

    return lists.mapInArrow(moved, "key long, y array<double>").withColumnRenamed("key", key)
