"""Data augmentation: functions that turn a pose table into several altered copies.

New session ids are ``id + copy * (largest id + 1)``. Copies come from a join
with a small table of levels or from one explode, never from a loop of unions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.functions.numbers import held
from gaitlake.operators.geometry import AXES, at, pitched, point


def _copies(pose: DataFrame, n: int, ids: int | None = None) -> DataFrame:
    """Adds ``copy`` 0 to n - 1 and renumbers ``id``; ``old_id`` keeps it."""
    ids = ids if ids is not None else (pose.agg(F.max("id")).first()[0] or 0) + 1
    out = pose.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({"old_id": F.col("id"), "id": F.col("id") + F.col("copy") * F.lit(ids)})


def expand_meta(meta: DataFrame, copies: int) -> DataFrame:
    """Session metadata for that many copies: ``old_id`` and the new ``id``."""
    return _copies(meta, copies).drop("copy")


def mirror(pose: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Original and mirrored copy (``label``): y negated, left and right joints swapped."""
    n = pose.select(F.size("kp")).first()[0]
    other = list(range(n))
    for a, b in pairs:
        other[a], other[b] = b, a
    flipped = F.transform(F.array(*(F.col("kp")[j] for j in other)), lambda k: point(k["x"], -k["y"], k["z"]))
    out = _copies(pose, 2)
    return out.withColumns({"label": F.when(F.col("copy") == 0, "Original").otherwise("Mirrored"), "kp": F.when(F.col("copy") == 0, F.col("kp")).otherwise(flipped)}).drop("copy")


def joint_ablation(pose: DataFrame, groups: Mapping[str, Sequence[int]], ablations: Sequence[str]) -> DataFrame:
    """Original ("Normal") and, for each space-joined list of groups, a copy with those joints at their mean over all frames."""
    for name in groups:
        if " " in name:
            raise ValueError("group names may not contain spaces")
    n = pose.select(F.size("kp")).first()[0]
    means = pose.agg(F.array(*(point(*(F.avg(at(j, a)) for a in AXES)) for j in range(n))).alias("_mean"))
    out = _copies(pose, 1 + len(ablations)).join(F.broadcast(means))
    gone = [sorted({j for g in a.split(" ") for j in groups[g]}) for a in ablations]

    def ablated(joints: Sequence[int]) -> Column:
        return F.array(*(F.col("_mean")[j] if j in joints else F.col("kp")[j] for j in range(n)))

    kp, label = F.col("kp"), F.lit("Normal")
    for k, (name, joints) in enumerate(zip(ablations, gone, strict=True), 1):
        kp, label = F.when(F.col("copy") == k, ablated(joints)).otherwise(kp), F.when(F.col("copy") == k, name).otherwise(label)
    return out.withColumns({"kp": kp, "label": label}).drop("_mean", "copy")


def noise(pose: DataFrame, levels: Sequence[float], seed: int = 0) -> DataFrame:
    """A copy for each level with normal noise of that deviation on every coordinate, drawn from the hash of its place, so reruns agree; the first level must be 0."""
    if levels[0] != 0:
        raise ValueError("the first level must be 0")
    out = _copies(pose, len(levels)).withColumn("noise", F.get(F.array(*(F.lit(float(v)) for v in levels)), F.col("copy")))

    def normal(j: Column, axis: str) -> Column:
        u = lambda k: (F.pmod(F.xxhash64("id", "t", j, F.lit(axis), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))

    return out.withColumn("kp", F.transform("kp", lambda k, j: point(*(k[a] + F.col("noise") * normal(j, a) for a in AXES)))).drop("copy")


def pitch(pose: DataFrame, levels: int = 10, joint: int = 3) -> DataFrame:
    """Copies turned about y by 0 to 1 times the pitch of ``joint``, in ``levels`` equal steps."""
    out = _copies(pose, levels).withColumn("pitch", F.col("copy") / float(max(levels - 1, 1)))
    out = held(out, _a=F.col("pitch") * F.atan2(at(joint, "z"), at(joint, "x")))
    return pitched(out, "_a").drop("_a", "copy")
