"""Row-local geometry of poses.

A pose table has one row for each frame: ``id`` (session), ``t`` (frame within
the session) and ``kp``, an array of structs x, y, z, one for each joint. All
functions here are projections: no shuffle, and Catalyst folds chains of them
into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.functions.numbers import angle_between, divided, held, norm

AXES = ("x", "y", "z")
PLANES = {"xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def at(joint: int, axis: str, pose: str = "kp") -> Column:
    return F.col(pose)[joint][axis]


def center(pose: DataFrame, joint: int = 4) -> DataFrame:
    """Every joint relative to one of them."""
    pose = held(pose, **{f"_{a}": at(joint, a) for a in AXES})
    return pose.withColumn("kp", F.transform("kp", lambda k: point(*(k[a] - F.col(f"_{a}") for a in AXES)))).drop(*(f"_{a}" for a in AXES))


def rotate_to_x(pose: DataFrame, joint: int = 3, level: bool = False) -> DataFrame:
    """Turns each frame about z so that ``joint`` points along +x; with ``level`` also about y, so that its z becomes 0. Does not centre."""
    yaw = -F.atan2(at(joint, "y"), at(joint, "x"))
    pose = held(pose, _c=F.cos(yaw), _s=F.sin(yaw))
    c, s = F.col("_c"), F.col("_s")
    pose = pose.withColumn("kp", F.transform("kp", lambda k: point(k["x"] * c - k["y"] * s, k["x"] * s + k["y"] * c, k["z"]))).drop("_c", "_s")
    if not level:
        return pose
    return pitched(held(pose, _pitch=F.atan2(at(joint, "z"), at(joint, "x"))), "_pitch").drop("_pitch")


def pitched(pose: DataFrame, angle: str) -> DataFrame:
    """Turns each frame about y by the angle in a column: x' = x cos + z sin, z' = z cos - x sin."""
    pose = held(pose, _c=F.cos(angle), _s=F.sin(angle))
    c, s = F.col("_c"), F.col("_s")
    return pose.withColumn("kp", F.transform("kp", lambda k: point(k["x"] * c + k["z"] * s, k["y"], k["z"] * c - k["x"] * s))).drop("_c", "_s")


def flat_labels(joints: Sequence[str]) -> list[str]:
    return [f"ego_euc_{j}_{a}" for j in joints for a in AXES]


def flattened(pose: DataFrame) -> DataFrame:
    """Adds ``features``: the coordinates of all joints in a row."""
    return pose.withColumn("features", F.flatten(F.transform("kp", lambda k: F.array(k["x"], k["y"], k["z"]))))


def is_centred(pose: DataFrame) -> bool:
    """Whether some joint's coordinates sum to exactly 0 over all frames."""
    n = pose.select(F.size("kp")).first()
    if n is None:
        return False
    sums = pose.select(F.posexplode("kp").alias("j", "k")).groupBy("j").agg(F.sum(F.col("k.x") + F.col("k.y") + F.col("k.z")).alias("s"))
    return not sums.where("s = 0").isEmpty()


def link_lengths(pose: DataFrame, links: Sequence[tuple[int, int]], metric: str = "l1") -> DataFrame:
    """Adds ``lengths``: of each link, in the sum of absolute differences (l1) or Euclidean (l2)."""

    def length(a: int, b: int) -> Column:
        d = [at(a, x) - at(b, x) for x in AXES]
        return F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2]) if metric == "l1" else norm(*d)

    if metric not in ("l1", "l2"):
        raise ValueError(f"unknown metric {metric}")
    return pose.withColumn("lengths", F.array(*(length(a, b) for a, b in links)))


def angle_labels(triples: Sequence[tuple[int, int, int]], planes: bool = False) -> list[str]:
    return [f"ang_{a}_{b}_{c}" + (f"_{p}" if planes else "") for a, b, c in triples for p in (PLANES if planes else ("",))]


def joint_angles(pose: DataFrame, triples: Sequence[tuple[int, int, int]], planes: bool = False) -> DataFrame:
    """Adds ``angles``: at the middle joint of each triple, in space or (``planes``) of the projections on xy, xz and yz; NaN for a link of length 0."""

    sides = F.array(*(F.struct(*((at(j, x) - at(t[1], x)).alias(f"{n}{x}") for n, j in (("u", t[0]), ("v", t[2])) for x in AXES)) for t in triples))
    # One expression over the sides, not one for each triple: plans stay small however many there are.
    angle = lambda d, axes: angle_between([d[f"u{x}"] for x in axes], [d[f"v{x}"] for x in axes])
    each = F.transform("_sides", (lambda d: F.array(*(angle(d, p) for p in PLANES.values()))) if planes else (lambda d: angle(d, AXES)))
    return held(pose, _sides=sides).withColumn("angles", F.flatten(each) if planes else each).drop("_sides")


def head_angle(link: tuple[int, int, int] = (0, 3, 4)) -> Column:
    """Angle in the xy plane from the second link to the first, in (0, 2 pi]; arguments of atan2 are (x, y)."""
    a, b, c = link
    u = [at(a, x) - at(b, x) for x in "xy"]
    v = [at(c, x) - at(b, x) for x in "xy"]
    raw = F.atan2(u[0], u[1]) - F.atan2(v[0], v[1])
    return F.when(raw <= 0, raw + 2 * 3.141592653589793).otherwise(raw)


def align_heading(pose: DataFrame, root: int = 4, front: int = 3, back: int = 5, with_z: bool = False) -> DataFrame:
    """Relative to the root, turned so that back-to-front points along +x; scaled to [-1, 1] by the smallest and largest coordinate of the whole table.

    Without ``with_z`` the turn is about z alone. A heading straight along -x
    leaves no single turn and gives NaN.
    """
    pose = held(center(pose, root), _h=F.array(*(at(front, a) - at(back, a) if a != "z" or with_z else F.lit(0.0) for a in AXES)))
    length = norm(*(F.col("_h")[i] for i in range(3)))
    pose = held(pose, _u=F.array(*(divided(F.col("_h")[i], length) for i in range(3)))).drop("_h")
    u = F.col("_u")
    k = divided(F.lit(1.0), 1 + u[0])

    def turned(p: Column) -> Column:
        x = p["x"] * u[0] + p["y"] * u[1] + p["z"] * u[2]
        y = -u[1] * p["x"] + (1 - u[1] * u[1] * k) * p["y"] - u[1] * u[2] * k * p["z"]
        z = -u[2] * p["x"] - u[1] * u[2] * k * p["y"] + (1 - u[2] * u[2] * k) * p["z"]
        return point(x, y, z)

    pose = held(pose.withColumn("_kp", F.transform("kp", turned)), kp2=F.col("_kp")).drop("_u", "_kp", "kp").withColumnRenamed("kp2", "kp")
    ends = pose.agg(F.min(F.array_min(F.transform("kp", lambda k: F.least(k["x"], k["y"], k["z"])))).alias("_low"), F.max(F.array_max(F.transform("kp", lambda k: F.greatest(k["x"], k["y"], k["z"])))).alias("_high"))
    scale = lambda v: 2 * (v - F.col("_low")) / (F.col("_high") - F.col("_low")) - 1
    return pose.join(F.broadcast(ends)).withColumn("kp", F.transform("kp", lambda k: point(scale(k["x"]), scale(k["y"]), scale(k["z"])))).drop("_low", "_high")


def limits(pose: DataFrame) -> DataFrame:
    """(axis, low, high): the range of each axis with 5 % of its width on either side; z starts at its smallest value or 0, whichever is less, without margin."""
    ends = pose.select(F.explode("kp").alias("k")).agg(*(f(F.col(f"k.{a}")).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))))
    rows = []
    for a in AXES:
        low, high = F.col(f"low_{a}"), F.col(f"high_{a}")
        margin = (high - low) * 0.05
        rows.append(F.struct(F.lit(a).alias("axis"), (F.least(low, F.lit(0.0)) if a == "z" else low - margin).alias("low"), (high + margin).alias("high")))
    return ends.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def segments(pose: DataFrame, links: Sequence[tuple[int, int]]) -> DataFrame:
    """(id, t, link, x0, y0, z0, x1, y1, z1): what a skeleton drawing needs."""
    lines = [F.struct(F.lit(i).cast("long").alias("link"), *(at(j, a).alias(f"{a}{e}") for e, j in enumerate(link) for a in AXES)) for i, link in enumerate(links)]
    return pose.select("id", "t", F.explode(F.array(*lines)).alias("s")).select("id", "t", "s.*")


def exploded(pose: DataFrame, *keep: str) -> DataFrame:
    """Long layout: (id, t, joint, x, y, z)."""
    return pose.select("id", "t", *keep, F.posexplode("kp").alias("joint", "k")).select("id", "t", *keep, F.col("joint").cast("long").alias("joint"), "k.x", "k.y", "k.z")
