"""Principal components of wide features, without a matrix of all pairs of columns.

Randomised: a block of directions goes to the executors, each task multiplies
its rows by it and back, and the blocks of all tasks are added up by column.
The blocks of successive passes span a Krylov space, in which the components
are sought until their residuals vanish. Incremental: each task keeps the
components of the rows it has seen, and these summaries are merged in groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.operators import tiles
from gaitlake.operators.reduce import Pca, moments

#: Rows of a batch that a task decomposes at once; summaries that are merged in one step.
BATCH_ROWS, MERGED = 1024, 16


def _columns(frames: DataFrame, positions: Sequence[int], column: str) -> DataFrame:
    own = list(positions)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"x": tiles.lists(tiles.matrix(batch.column(0))[:, own])})

    return frames.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(picked, "x array<double>")


def _product(frames: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """X'X times the block, X being the centred rows: one pass, d rows of the block's width for each task."""
    width = block.shape[1]
    shared = frames.sparkSession.sparkContext.broadcast((mean, block))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, block = shared.value
        total = np.zeros_like(block)
        for batch in batches:
            if batch.num_rows:
                x = tiles.matrix(batch.column(0)) - mean
                total += x.T @ (x @ block)
        yield pa.record_batch({"j": np.arange(len(total)), "z": tiles.lists(total)})

    parts = frames.mapInArrow(partial, "j long, z array<double>").groupBy("j").agg(F.array(*(F.sum(F.col("z")[k]) for k in range(width))).alias("z")).orderBy("j").toArrow()
    shared.destroy()
    return tiles.matrix(parts["z"])


def _signed(vectors: np.ndarray) -> np.ndarray:
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def fit_randomised(frames: DataFrame, positions: Sequence[int], n: int, column: str = "features", sample: DataFrame | None = None, more: int = 2, passes: int = 60, close: float = 1e-8, seed: int = 0) -> Pca:
    """The ``n`` main components of the columns at ``positions``, fitted on ``sample`` (default: all rows), centred on its own means; the model's means are of all rows.

    A pass multiplies a block of ``n + more`` directions; passes end when the
    residual of each component is ``close`` times the first variance, or the
    blocks span all columns, or after ``passes``. The driver holds the blocks,
    columns x (n + more) numbers a pass.
    """
    rows = _columns(sample if sample is not None else frames, positions, column).persist()
    mean, sd = moments(rows, "x")
    count = rows.count()
    d = len(mean)
    n = min(n, d)
    basis = np.zeros((d, 0))
    image = np.zeros((d, 0))
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(n + more, d))))[0]
    for _ in range(passes):
        basis, image = np.concatenate([basis, block], 1), np.concatenate([image, _product(rows, mean, block)], 1)
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:n], inner[:, ::-1][:, :n]
        vectors = basis @ inner
        off = np.linalg.norm(image @ inner - vectors * values, axis=0)
        if (off <= close * max(values[0], 1e-300)).all() or basis.shape[1] >= d:
            break
        # What the newest products have beyond the directions so far, twice, as once is not orthogonal enough.
        block = image[:, -block.shape[1] :]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-12 * max(float(values[0]), 1e-300)][:, : d - basis.shape[1]]
        if not block.shape[1]:
            break
    rows.unpersist()
    whole = mean if sample is None else moments(_columns(frames, positions, column), "x")[0]
    return Pca(list(positions), whole, _signed(vectors), np.maximum(values, 0) / max(count, 1), float((sd**2).sum()))


def _summary(count: float, mean: np.ndarray, held: np.ndarray, total: float, rows: np.ndarray, keep: int) -> tuple:
    """(count, mean, held, total) with further rows: ``held`` is the components times their singular values, ``total`` all squares."""
    if not len(rows):
        return count, mean, held, total
    own = rows.mean(0)
    return _merged((count, mean, held, total), (float(len(rows)), own, rows - own, float(((rows - own) ** 2).sum())), keep)


def _merged(a: tuple, b: tuple, keep: int) -> tuple:
    """The summary of the rows of two."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n = a[0] + b[0]
    shift = np.sqrt(a[0] * b[0] / n) * (a[1] - b[1])
    stacked = np.concatenate([a[2], b[2], shift[None]])
    _, size, vectors = np.linalg.svd(stacked, full_matrices=False)
    return n, (a[0] * a[1] + b[0] * b[1]) / n, size[:keep, None] * vectors[:keep], a[3] + b[3] + float((shift**2).sum())


def fit_incremental(frames: DataFrame, positions: Sequence[int], n: int, column: str = "features", more: int = 10) -> Pca:
    """The ``n`` main components by merging: tasks go through their rows in batches and keep ``n + more`` components; their summaries are merged MERGED at a time until one is left. Exact where no more components are needed than are kept, near the largest otherwise."""
    d = len(positions)
    keep = min(n + more, d)

    def kept(s: tuple, group: int) -> pa.RecordBatch:
        return pa.record_batch({"g": pa.array([group], pa.int64()), "count": pa.array([s[0]]), "mean": tiles.lists(s[1][None]), "held": tiles.lists(s[2].reshape(1, -1)), "total": pa.array([s[3]])})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = (0.0, np.zeros(d), np.zeros((0, d)), 0.0)
        for batch in batches:
            x = tiles.matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d))
            for at in range(0, len(x), BATCH_ROWS):
                s = _summary(*s, x[at : at + BATCH_ROWS], keep)
        if s[0]:
            yield kept(s, TaskContext.get().partitionId())

    def together(table: pa.Table) -> pa.Table:
        s = None
        for k in range(table.num_rows):
            one = (table["count"][k].as_py(), np.array(table["mean"][k].as_py()), np.array(table["held"][k].as_py()).reshape(-1, d), table["total"][k].as_py())
            s = one if s is None else _merged(s, one, keep)
        return pa.Table.from_batches([kept(s, table["g"][0].as_py())])

    schema = "g long, count double, mean array<double>, held array<double>, total double"
    rows = _columns(frames, positions, column)
    parts = rows.mapInArrow(first, schema)
    left = rows.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // MERGED)
        parts = parts.withColumn("g", F.floor(F.col("g") / MERGED)).groupBy("g").applyInArrow(together, schema)
    found = parts.collect()
    if not found:
        return Pca(list(positions), np.zeros(d), np.zeros((d, 0)), np.zeros(0), 0.0)
    count, mean, total = found[0]["count"], np.array(found[0]["mean"]), found[0]["total"]
    _, size, vectors = np.linalg.svd(np.array(found[0]["held"]).reshape(-1, d), full_matrices=False)
    return Pca(list(positions), mean, _signed(vectors[:n].T), size[:n] ** 2 / count, total / count)
