"""Operators along sessions that have no relational form, as Arrow stages on tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaitlake.functions import numbers
from gaitlake.functions.shared import written
from gaitlake.operators import kernels, tiles
from gaitlake.operators.timeseries import outlier_flags

#: Knots on either side of a tile. The system of a cubic spline has twice the weight on its diagonal, so that a knot's
#: effect halves, at least, with each further knot: beyond these it is below the last bit.
KNOTS = 64


def by_session(frames: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """Applies a pandas function to each session's frames, in order of ``t``; for functions of the user that need whole sessions."""
    return frames.groupBy("id").applyInPandas(lambda rows: function(rows.sort_values("t", kind="stable")), schema)


def _flat(column: str = "kp") -> object:
    return F.flatten(F.transform(column, lambda k: F.array(k["x"], k["y"], k["z"])))


def _points(column: str) -> object:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(column) / 3).cast("int") - 1), lambda j: F.struct(*(F.get(column, 3 * j + a).alias(n) for a, n in enumerate("xyz"))))


def repaired(pose: DataFrame, rows: int = tiles.TILE_ROWS, contiguous: bool = False, **rule: float) -> DataFrame:
    """(id, t, kp, repaired): replaces the frames that ``outlier_flags(**rule)`` calls bad by a cubic spline through the good ones of the session. Sessions with fewer than two good frames stay as they are.

    Good frames are knots, in tiles of ``rows`` of them; a tile gives the
    pieces between two knots with bad frames between them, at which the bad
    frames are looked up, however many they are. ``contiguous``: ``t`` counts
    the frames of each session from 0.
    """
    flagged = tiles.over(pose, lambda p: outlier_flags(p, **rule), rule.get("length", 6) + 1, contiguous=contiguous)
    held = tiles.counted(written(flagged.select("id", "t", _flat().alias("v"), "bad")), "g", ~F.col("bad"), "n")
    knots = tiles.tiled(held.where("not bad and n >= 2").withColumn("k", F.col("g") - 1), KNOTS, rows, "k", F.col("n"))
    kind = pose.schema["id"].dataType.simpleString()

    def pieces(table: pa.Table) -> pa.Table:
        t, y, k = table["t"].to_numpy().astype(float), tiles.matrix(table["v"]), table["k"].to_numpy()
        m = kernels.second_derivatives(t, y)
        last = table["n"][0].as_py() - 1
        own = table["own"].to_numpy()[:-1] & (k[:-1] < last)
        at = np.flatnonzero(own & ((np.diff(t) > 1) | (k[:-1] == 0) | (k[1:] == last)))
        return pa.table({"pid": table["id"].take(pa.array(at)), "piece": k[at] + 1, "t0": t[at], "step": t[at + 1] - t[at], **{name: tiles.lists(v[at + s]) for name, v, s in (("y0", y, 0), ("y1", y, 1), ("m0", m, 0), ("m1", m, 1))}})

    found = tiles.grouped_arrow(knots.select("id", "tile", "t", "v", "k", "n", "own"), ("id", "tile"), ("k",), pieces, f"pid {kind}, piece long, t0 double, step double, y0 array<double>, y1 array<double>, m0 array<double>, m1 array<double>")
    found = found.withColumnRenamed("piece", "_piece")
    fix = F.when(F.col("bad") & (F.col("n") >= 2), F.least(F.greatest("g", F.lit(1)), F.col("n") - 1))
    held = held.withColumn("_fix", fix).join(found, F.col("id").eqNullSafe(F.col("pid")) & (F.col("_fix") == F.col("_piece")), "left")
    d, h = F.col("t") - F.col("t0"), F.col("step")
    y0, y1, m0, m1 = (lambda j, c=c: F.get(c, j) for c in ("y0", "y1", "m0", "m1"))
    value = lambda j: y0(j) + d * ((y1(j) - y0(j)) / h - h * (2 * m0(j) + m1(j)) / 6) + d * d * m0(j) / 2 + d * d * d * (m1(j) - m0(j)) / (6 * h)
    fixed = F.col("_piece").isNotNull()
    new = F.when(fixed, F.transform(F.sequence(F.lit(0), F.size("v") - 1), value)).otherwise(F.col("v"))
    return numbers.held(held, w=new).select("id", "t", _points("w").alias("kp"), fixed.alias("repaired"))


def wavelets(frames: DataFrame, labels: Sequence[str], column: str = "features", rate: float = 90.0, freqs: Sequence[float] | None = None, w0: float = 5.0, contiguous: bool = False, rows: int = tiles.TILE_ROWS) -> tuple[DataFrame, list[str]]:
    """(id, t, features) with labels: wavelet power of each feature, feature by feature, at each frequency. ``contiguous``: ``t`` counts the frames of each session from 0."""
    freqs = np.linspace(1, 25, 25) if freqs is None else np.asarray(freqs, float)
    margin = int(10 * kernels.wavelet_width(rate, freqs, w0).max()) + 1
    # A session of more than one tile is longer than any wavelet; a shorter one lies in its first tile as a whole.
    rows = max(rows, margin)
    held = frames.select("id", "t", F.col(column).cast("array<double>").alias("v"))
    held = held.withColumn("pos", F.col("t").cast("long")) if contiguous else tiles.counted(held, "pos").withColumn("pos", F.col("pos") - 1)

    def power(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        if not own.any():
            return table.slice(0, 0).select(["id", "t", "v"]).rename_columns(["id", "t", "features"])
        found = kernels.wavelet_power(tiles.matrix(table["v"]), rate, freqs, w0, len(own) if table["tile"][0].as_py() == 0 else margin)
        return pa.table({"id": table["id"].filter(pa.array(own)), "t": table["t"].filter(pa.array(own)), "features": tiles.lists(found[own])})

    out = tiles.grouped_arrow(tiles.tiled(held, margin, rows), ("id", "tile"), ("pos",), power, f"id {frames.schema['id'].dataType.simpleString()}, t {frames.schema['t'].dataType.simpleString()}, features array<double>")
    return out, [f"wlet_{name}_{round(float(f), 2)}" for name in labels for f in freqs]


def long_medians(frames: DataFrame, column: str, length: int, rows: int = tiles.TILE_ROWS) -> DataFrame:
    """As ``median_filter``, for windows of any length: two heaps slide along each tile. Adds up to a session only what its tiles hold; other columns are kept."""
    held = tiles.counted(frames, "_pos").withColumn("_pos", F.col("_pos") - 1)
    # Rows travel with the column alone; the others are joined to the result.
    cut = tiles.tiled(held.select("id", "_pos", F.col(column).cast("double").alias("v")), length, max(rows, 4 * length), "_pos")

    def medians(table: pa.Table) -> pa.Table:
        own = table["own"].to_numpy()
        x = table["v"].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False) if own.any() else np.zeros(0)
        found = kernels.running_median(x, length)[own] if own.any() else x
        return pa.table({"_mid": table["id"].filter(pa.array(own)), "_mpos": table["_pos"].filter(pa.array(own)), "_median": pc.if_else(pc.is_nan(pa.array(found)), None, pa.array(found))})

    found = tiles.grouped_arrow(cut, ("id", "tile"), ("_pos",), medians, f"_mid {frames.schema['id'].dataType.simpleString()}, _mpos long, _median double")
    joined = held.join(found, F.col("id").eqNullSafe(F.col("_mid")) & (F.col("_pos") == F.col("_mpos")))
    return joined.withColumn(column, F.col("_median")).drop("_mid", "_mpos", "_median", "_pos")


def speed_augmented(pose: DataFrame, levels: Sequence[float], rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(id, old_id, level, t, kp): each session resampled to int(n / level) frames by a cubic spline through all of its frames; new ids are id * levels + position of the level. A tile makes the new frames that lie behind its own knots."""
    flat = tiles.counted(pose.select(F.col("id").cast("long").alias("id"), "t", _flat().alias("v")), "k", total="n").withColumn("k", F.col("k") - 1)
    knots = tiles.tiled(flat, KNOTS, rows, "k", F.col("n"))
    levels = list(levels)

    def resample(table: pa.Table) -> pa.Table:
        k, y, n, old = table["k"].to_numpy(), tiles.matrix(table["v"]), table["n"][0].as_py(), table["id"][0].as_py()
        own = k[table["own"].to_numpy()]
        m, parts = kernels.second_derivatives(k, y), []
        for number, level in enumerate(levels):
            count = int(n / level)
            step = (n - 1) / (count - 1) if count > 1 else 0.0
            # The frames whose piece begins at an own knot; the last piece has its end as well.
            j = np.arange(max(0, int(own[0] / step) - 2) if step else 0, min(count, int((own[-1] + 1) / step) + 3) if step else count)
            at = np.where(j == count - 1, n - 1.0, j * step) if count > 1 else j * 0.0
            piece = np.minimum(at.astype(np.int64), max(n - 2, 0))
            j, at, piece = (v[(piece >= own[0]) & (piece <= own[-1])] for v in (j, at, piece))
            p = piece - k[0]
            q = np.minimum(p + 1, len(y) - 1)
            new = kernels.spline_value((at - piece)[:, None], 1.0, y[p], y[q], m[p], m[q])
            parts.append(pa.table({"id": np.full(len(j), old * len(levels) + number), "old_id": np.full(len(j), old), "level": np.full(len(j), float(level)), "t": j, "v": tiles.lists(new)}))
        return pa.concat_tables(parts)

    out = tiles.grouped_arrow(knots.select("id", "tile", "k", "v", "n", "own"), ("id", "tile"), ("k",), resample, "id long, old_id long, level double, t long, v array<double>")
    return out.select("id", "old_id", "level", "t", _points("v").alias("kp"))


def int_levenshtein(pairs: DataFrame, a: str, b: str, name: str = "distance") -> DataFrame:
    """Edit distance of two integer arrays; strings have a built-in function."""

    @F.pandas_udf("long")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kernels.levenshtein(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn(name, distance(a, b))
