"""Long sessions in overlapping tiles.

A session's frames are cut into runs of equally many, each with a margin of
the frames beside it. An operator whose windows are no wider than the margin
gives the same rows on a tile as on the whole session, but for the margin,
which is dropped; so no task has to hold a session. Positions in a session are
counted in stretches first, so that this needs no task of its size either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Frames of a tile, without its margins.
TILE_ROWS = 16_384
#: Values of ``t`` that are counted together.
STRETCH = 8192


def counted(frames: DataFrame, name: str, flag: Column | None = None, total: str | None = None) -> DataFrame:
    """Adds ``name``: how many frames of the session, of those with ``flag``, lie at or before each; and ``total``, how many there are."""
    flag = (F.lit(1) if flag is None else flag.cast("int")).cast("long")
    held = frames.withColumns({"_s": F.floor(F.col("t") / STRETCH), "_f": flag})
    sums = held.groupBy(F.col("id").alias("_id"), F.col("_s").alias("_k")).agg(F.sum("_f").alias("_n"))
    sums = sums.withColumn("_before", F.expr("coalesce(sum(_n) over (partition by _id order by _k rows between unbounded preceding and 1 preceding), 0)"))
    if total:
        sums = sums.withColumn(total, F.expr("sum(_n) over (partition by _id)"))
    held = held.join(sums.drop("_n"), F.col("id").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_k")))
    own = F.expr("sum(_f) over (partition by id, _s order by t rows between unbounded preceding and current row)")
    return held.withColumn(name, F.col("_before") + own).drop("_s", "_f", "_id", "_k", "_before")


def tiled(frames: DataFrame, margin: int, rows: int = TILE_ROWS, place: str = "pos", size: Column | None = None) -> DataFrame:
    """Each row in its tile (``own``) and in those whose margins reach it; adds ``tile`` and ``own``. ``place`` counts a session's rows from 0, of which there are ``size`` where that is given."""
    home = F.floor(F.col(place) / rows)
    last = F.floor((F.col(place) + margin) / rows)
    if size is not None:
        last = F.least(last, F.floor((size - 1) / rows))
    tiles = F.sequence(F.floor(F.greatest(F.col(place) - margin, F.lit(0)) / rows), last)
    return frames.select("*", F.explode(tiles).alias("tile")).withColumn("own", F.col("tile") == home)


def over(frames: DataFrame, operator: Callable[[DataFrame], DataFrame], margin: int, rows: int = TILE_ROWS, contiguous: bool = False) -> DataFrame:
    """What ``operator`` makes of the frames of each session (``id``, in order of ``t``), run on tiles.

    The operator must group by ``id`` and order by ``t`` alone, keep both, and
    look no further than ``margin`` frames; it sees tiles as sessions.
    ``contiguous`` says that ``t`` counts each session's frames from 0 without
    gaps; otherwise they are counted first.
    """
    held = frames.withColumn("_pos", F.col("t").cast("long")) if contiguous else counted(frames, "_pos").withColumn("_pos", F.col("_pos") - 1)
    cut = tiled(held, margin, rows, "_pos").withColumns({"id": F.struct("id", "tile"), "t": F.struct(F.col("_pos").alias("pos"), "t")}).drop("_pos", "tile", "own")
    out = operator(cut)
    return out.where(F.floor(F.col("t.pos") / rows) == F.col("id.tile")).withColumns({"id": F.col("id.id"), "t": F.col("t.t")})


def grouped_arrow(frames: DataFrame, keys: Sequence[str], order: Sequence[str], function: Callable[[pa.Table], pa.Table], schema: str | StructType, target: int = 4096) -> DataFrame:
    """``function`` on the Arrow table of each group, sorted; groups follow each other in one stream, without a call of pandas for each."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready: list[pa.Table] = []
        last = None

        def finished(force: bool) -> Iterator[pa.RecordBatch]:
            if ready and (force or sum(r.num_rows for r in ready) >= target):
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready.clear()

        def closed() -> None:
            if held:
                found = function(pa.Table.from_batches(held).combine_chunks())
                held.clear()
                if found.num_rows:
                    ready.append(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
                change |= codes[1:] != codes[:-1]
            ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                now = tuple(batch.column(k)[a].as_py() for k in keys)
                if now != last:
                    closed()
                    yield from finished(False)
                    last = now
                held.append(batch.slice(a, b - a))
        closed()
        yield from finished(True)

    return frames.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists of numbers (of lists, flattened) as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(values)
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        values = values.flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), float).reshape(n, -1)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)[: len(rows) + 1], pa.array(rows.ravel()))
