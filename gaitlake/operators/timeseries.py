"""Frame-ordered operators: every window is within a session, in order of ``t``.

Windows have a fixed number of frames. At a session's ends, frames are taken
as repeated (differences, deviations), mirrored (medians) or zero (means), as
stated. Several columns over one window share its sort and exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gaitlake.functions.numbers import norm
from gaitlake.operators import kernels, tiles
from gaitlake.operators.geometry import AXES, at, point


#: Longest window whose frames are sorted for each row.
SORTED_FRAMES = 128


def session(*more: str) -> WindowSpec:
    return Window.partitionBy("id", *more).orderBy("t")


def whole(*more: str) -> WindowSpec:
    return session(*more).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def frame_diff(x: Column, width: int, centred: bool = True, by: Sequence[str] = ()) -> Column:
    """x[t + w] - x[t - w], or x[t] - x[t - w]; beyond an end, the end's value counts. Needs x free of nulls."""
    w, every = session(*by), whole(*by)
    back = F.coalesce(F.lag(x, width).over(w), F.first(x).over(every))
    return (F.coalesce(F.lead(x, width).over(w), F.last(x).over(every)) if centred else x) - back


def padded_std(x: Column, half: int, by: Sequence[str] = ()) -> Column:
    """Population deviation over 2 * half + 1 frames, end values repeated beyond the ends."""
    w, every = session(*by), whole(*by)
    near = w.rowsBetween(-half, half)
    t, n = F.row_number().over(w) - 1, F.count(F.lit(1)).over(every)
    pre, post = F.greatest(F.lit(0), half - t), F.greatest(F.lit(0), half - (n - 1 - t))
    first, last = F.first(x).over(every), F.last(x).over(every)
    k = 2 * half + 1
    mean = (F.sum(x).over(near) + pre * first + post * last) / k
    square = (F.sum(x * x).over(near) + pre * first * first + post * last * last) / k
    return F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def zero_padded_mean(x: Column, width: int) -> Column:
    """Sum over ``width`` frames, zeros beyond the ends, over ``width``; an even window reaches one frame further ahead."""
    return F.sum(x).over(session().rowsBetween(-((width - 1) // 2), width // 2)) / width


def velocities(pose: DataFrame, joints: Sequence[int], names: Sequence[str], widths: Sequence[int] = (3, 31, 89), rate: float = 90.0, tag: str = "abs", std: bool = True, absolute: bool = False, contiguous: bool = False, rows: int = tiles.TILE_ROWS) -> tuple[DataFrame, list[str]]:
    """(id, t, features) with its labels: for each half-width and joint the norm and axes of the centred difference, times rate / (2w + 1).

    With ``std``, the deviations over the same windows of the frame-to-frame
    velocity follow. Beyond a session's ends its end frames count. Sessions
    are cut into tiles; ``contiguous`` says that ``t`` counts the frames of
    each session from 0.
    """
    flat = pose.select("id", "t", F.array(*(at(j, a) for j in joints for a in AXES)).alias("v"))
    kinds = ("vel", "vel_std") if std else ("vel",)
    labels = [f"{tag}_{kind}_{a}_{names[j]}_{2 * w + 1}" for kind in kinds for w in widths for j in joints for a in ("norm", *AXES)]
    return _moving(flat, widths, rate, len(AXES), std, absolute, contiguous, rows), labels


def angular_velocities(frames: DataFrame, labels: Sequence[str], widths: Sequence[int] = (1, 15, 45), rate: float = 90.0, column: str = "angles", contiguous: bool = False, rows: int = tiles.TILE_ROWS) -> tuple[DataFrame, list[str]]:
    """(id, t, features) with labels: centred differences of each angle times rate / (2w + 1), then deviations of its frame-to-frame velocity. Angles are not unwrapped. Sessions are cut into tiles, as in ``velocities``."""
    names = [f"{name.replace('ang', kind)}_{2 * w + 1}" for kind in ("avel", "avel_std") for w in widths for name in labels]
    return _moving(frames.select("id", "t", F.col(column).alias("v")), widths, rate, 1, True, False, contiguous, rows), names


def _moving(frames: DataFrame, widths: Sequence[int], rate: float, axes: int, std: bool, absolute: bool, contiguous: bool, rows: int) -> DataFrame:
    """(id, t, features) by ``kernels.motion`` of the arrays ``v``, ``axes`` numbers a point, on tiles."""
    widths, margin = list(widths), max(widths) + 2
    held = frames.withColumn("v", F.col("v").cast("array<double>"))
    held = held.withColumn("pos", F.col("t").cast("long")) if contiguous else tiles.counted(held, "pos").withColumn("pos", F.col("pos") - 1)

    def moved(table: pa.Table) -> pa.Table:
        own = pa.array(table["own"].to_numpy())
        x = tiles.matrix(table["v"]) if pc.any(own).as_py() else np.zeros((0, axes))
        found = kernels.motion(x.reshape(len(x), -1, axes), widths, rate, std, axes > 1, absolute)[np.asarray(own)] if len(x) else np.zeros((0, 1))
        return pa.table({"id": table["id"].filter(own), "t": table["t"].filter(own), "features": tiles.lists(found)})

    kind = lambda c: frames.schema[c].dataType.simpleString()
    return tiles.grouped_arrow(tiles.tiled(held, margin, rows), ("id", "tile"), ("pos",), moved, f"id {kind('id')}, t {kind('t')}, features array<double>")


def median_filter(frames: DataFrame, column: str, length: int = 5) -> DataFrame:
    """Replaces a column by its running median over ``length`` frames, mirrored at the ends (d c b a | a b c d | d c b a).

    Of an even number the upper one of the middle two counts; the window then
    reaches one frame further back. Sessions must have length // 2 frames at
    least; a shorter one is mirrored as far as it goes. Windows of more than
    SORTED_FRAMES are not sorted for each frame, but kept in heaps.
    """
    if length > SORTED_FRAMES:
        from gaitlake.operators.grouped import long_medians

        return long_medians(frames, column, length)
    half = length // 2
    w, every = session(), whole()
    ahead = length - 1 - half
    near = F.collect_list(F.col(column)).over(w.rowsBetween(-half, ahead))
    t, n = (F.row_number().over(w) - 1).cast("int"), F.count(F.lit(1)).over(every).cast("int")
    # The mirrored frames lie within the nearest `length` ones, so each end needs no more than a bounded list.
    wide = F.collect_list(F.col(column)).over(w.rowsBetween(-length, length))
    frames = frames.withColumns({"_near": near, "_wide": wide, "_t": t, "_n": n})
    base = F.greatest(F.col("_t") - length, F.lit(0))

    def mirrored(o: Column) -> Column:
        i = F.col("_t") + o
        return F.get("_wide", F.when(i < 0, -1 - i).when(i >= F.col("_n"), 2 * F.col("_n") - 1 - i) - base)

    missing = F.filter(F.sequence(F.lit(-half), F.lit(ahead)), lambda o: (F.col("_t") + o < 0) | (F.col("_t") + o >= F.col("_n")))
    held = F.array_sort(F.filter(F.concat("_near", F.transform(missing, mirrored)), lambda x: x.isNotNull()))
    return frames.withColumn(column, F.get(held, (F.size(held) / 2).cast("int"))).drop("_near", "_wide", "_t", "_n")


def trimmed(frames: DataFrame, size: int) -> DataFrame:
    """Without the first and last ``size`` frames of each session; size 0 changes nothing."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return frames.withColumns({"_r": F.row_number().over(session()) - 1, "_n": n}).where((F.col("_r") >= size) & (F.col("_r") < F.col("_n") - size)).drop("_r", "_n")


def strided(frames: DataFrame, step: int, by_session: bool = False, frame: str = "frame") -> DataFrame:
    """Every ``step``-th frame, over all sessions or within each."""
    return frames.where(F.pmod(F.col("t" if by_session else frame), F.lit(step)) == 0)


def outlier_flags(pose: DataFrame, speed: float | None = None, height: float | None = None, error: float | None = None, length: int = 6) -> DataFrame:
    """Adds ``value`` and ``bad`` by one of three rules: pooled speed, summed height, or mean distance to the running median.

    Pooled speed is the norm over joints of each joint's step summed over its axes.
    """
    if speed is not None:
        total = F.transform("kp", lambda k: k["x"] + k["y"] + k["z"])
        pose = pose.withColumn("_s", total)
        step = F.zip_with("_s", F.coalesce(F.lag("_s", 1).over(session()), F.col("_s")), lambda a, b: (a - b) * (a - b))
        value = F.sqrt(F.aggregate(step, F.lit(0.0), lambda s, x: s + x))
        return pose.withColumn("value", value).drop("_s").withColumn("bad", F.col("value") > speed)
    if height is not None:
        value = F.aggregate(F.transform("kp", lambda k: k["z"]), F.lit(0.0), lambda s, x: s + x)
        return pose.withColumn("value", value).withColumn("bad", F.col("value") > height)
    long = pose.select("id", "t", F.posexplode("kp").alias("j", "k")).select(F.struct("id", "j").alias("id"), "t", "k")
    for a in AXES:
        long = median_filter(long.withColumn(f"m{a}", F.col(f"k.{a}")), f"m{a}", length)
    far = long.groupBy(F.col("id.id").alias("id"), "t").agg(F.avg(norm(*(F.col(f"k.{a}") - F.col(f"m{a}") for a in AXES))).alias("value"))
    return pose.join(far, ["id", "t"]).withColumn("bad", F.col("value") > error)


def plane_fit(points: DataFrame, by: str = "id") -> DataFrame:
    """(id, a, b, c) of z = a x + b y + c by least squares from population moments; null where x and y lie on a line."""
    m = points.groupBy(by).agg(*(F.covar_pop(p, q).alias(p + q) for p, q in (("x", "x"), ("y", "y"), ("x", "y"), ("x", "z"), ("y", "z"))), *(F.avg(a).alias(f"m{a}") for a in AXES))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    ok = F.when(det != 0, det)
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / ok
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / ok
    return m.select(by, a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))


def floor_plane(pose: DataFrame, foot: int = 12, wide: float = 1.5) -> DataFrame:
    """(id, a, b, c): the plane through a foot's positions, fitted again without those more than ``wide`` deviations off the first fit."""
    points = pose.select("id", *(at(foot, a).alias(a) for a in AXES))
    first = points.join(plane_fit(points), "id").withColumn("r", F.col("z") - (F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c")))
    spread = first.groupBy("id").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("sd"))
    near = first.join(spread, "id").where(F.abs(F.col("r") - F.col("m")) < wide * F.col("sd")).select("id", *AXES)
    return plane_fit(near)


def align_floor(pose: DataFrame, foot: int = 12, head: int = 0) -> DataFrame:
    """Turns every session so that its floor is level at height 0; adds ``upright``: whether the head is above the foot on average. A level floor is only lowered."""
    pose = pose.join(floor_plane(pose, foot), "id")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    n = F.sqrt(a * a + b * b + 1)
    u, v, w = -a / n, -b / n, 1 / n
    k = 1 / (1 + w)

    def level(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"] - c
        return point((1 - u * u * k) * x - u * v * k * y - u * z, -u * v * k * x + (1 - v * v * k) * y - v * z, u * x + v * y + w * z)

    pose = pose.withColumn("kp", F.transform("kp", level)).drop("a", "b", "c")
    side = pose.groupBy("id").agg((F.avg(at(head, "z")) > F.avg(at(foot, "z"))).alias("upright"))
    return pose.join(F.broadcast(side), "id")
