"""What plots of clusters show, as tables: sampled motifs, labelled maps, ridges."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.operators.density import Watershed, density_by


def motif_centres(labels: DataFrame, cluster: str = "cluster", n: int = 9, frames: int = 100, apart: int = 200, seed: int = 0, key: str = "frame") -> DataFrame:
    """(cluster, sample, key): up to ``n`` frames of each cluster, picked greedily in an order given by a hash.

    A pick lies ``apart`` frames or more from earlier ones of its cluster and
    half of ``frames`` or more from either end of the recording. A pick shuts
    out at most ``2 * apart - 1`` frames, so the first ``(n - 1) * (2 * apart -
    1) + 1`` candidates decide, however many there are; keys must be distinct.
    """
    last = labels.agg((F.max(key) + 1).alias("_total"))
    inside = labels.select(cluster, key).join(F.broadcast(last)).where((F.col(key) >= frames / 2) & (F.col(key) <= F.col("_total") - frames / 2))
    rank = F.expr(f"row_number() over (partition by {cluster} order by pmod({key} * 7919 + {seed}, 10007), {key})")
    first = inside.withColumn("_r", rank).where(F.col("_r") <= (n - 1) * (2 * apart - 1) + 1)
    ordered = first.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(key).cast("long").alias("f")))), lambda c: c["f"]).alias("_c"))
    free = lambda picks, f: (F.size(picks) < n) & ~F.exists(picks, lambda p: F.abs(p - f) < apart)
    picks = F.aggregate("_c", F.array().cast("array<bigint>"), lambda picks, f: F.when(free(picks, f), F.array_append(picks, f)).otherwise(picks))
    return ordered.select(cluster, F.posexplode(picks).alias("sample", key))


def motif_frames(centres: DataFrame, frames: int = 100, centred: bool = True, key: str = "frame") -> DataFrame:
    """Each centre as the ``frames`` frames around it, or from it on; ``step`` counts them."""
    every = centres.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    return every.withColumn(key, F.col(key) + F.col("step") - F.lit(frames // 2 if centred else 0))


def motif_density(points: DataFrame, frames: DataFrame, fitted: Watershed, cluster: str = "cluster", key: str = "frame") -> DataFrame:
    """(cluster, row, col, density): of each cluster's sampled frames (``motif_frames``), on the axes and masked by the labels of the fitted segmentation of all points (key, x, y)."""
    return density_by(points.select(key, "x", "y").join(frames.select(cluster, key), key), cluster, fitted)


def coloured(points: DataFrame, by: str) -> DataFrame:
    """Adds ``color``: the number from 0 of the row's category, categories in their order, null first."""
    kinds = points.select(F.col(by).alias("_kind")).distinct()
    kinds = kinds.withColumn("color", F.expr("cast(row_number() over (order by _kind) - 1 as int)"))  # one row for each category
    return points.join(kinds, F.col(by).eqNullSafe(F.col("_kind"))).drop("_kind")


def planar(frames: DataFrame, stride: int, across: str = "x", up: str = "z") -> DataFrame:
    """(.., u, v): the first and every ``stride``-th step of exploded poses side by side in a plane."""
    kept = frames.where((F.col("step") == 0) | (F.pmod(F.col("step") + 1, F.lit(stride)) == 0))
    return kept.withColumns({"u": F.col(across) + F.col("step") / stride, "v": F.col(up)}).drop("x", "y", "z")


def label_codes(labels: Sequence[tuple[int, str]]) -> dict[int, int]:
    """Cluster to the number of its label, in order of first appearance; a cluster with several labels has the last of them."""
    number: dict[str, int] = {}
    for _, name in labels:
        number.setdefault(name, len(number))
    out: dict[int, int] = {}
    for cluster, name in labels:
        out[cluster] = max(out.get(cluster, 0), number[name])
    return out


def labelled(cells: DataFrame, labels: Sequence[tuple[int, str]], cluster: str = "cluster") -> DataFrame:
    """Adds ``code``, the number of the cluster's label; 0 where it has none."""
    code = F.lit(0)
    for k, number in sorted(label_codes(labels).items()):
        code = F.when(F.col(cluster) == k, F.lit(number)).otherwise(code)
    return cells.withColumn("code", code)


def painted(cells: DataFrame, values: DataFrame, column: str, cluster: str = "cluster") -> DataFrame:
    """Each map cell with its cluster's value; 0 for the background and clusters without one."""
    return cells.join(values.select(cluster, F.col(column).cast("double").alias(column)), cluster, "left").withColumn(column, F.coalesce(F.when(F.col(cluster) > 0, F.col(column)), F.lit(0.0)))


def ridge(values: DataFrame, column: str, label: str, points: int = 200, adjust: float = 0.5, cut: float = 3.0) -> DataFrame:
    """(label, point, at, density): Gaussian kernel density of each label, bandwidth by Scott's rule times ``adjust``, from ``cut`` bandwidths below the smallest value to as many above the largest.

    Labels with one value only, or none but equal ones, have no density. Rows
    are expanded over the points and summed where they lie; what is shuffled
    is one row for each label and point of a task.
    """
    values = values.select(label, F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    stats = values.groupBy(label).agg(F.count("*").alias("_n"), (F.stddev_samp("_v") * F.pow(F.count("*").cast("double"), F.lit(-0.2)) * adjust).alias("_h"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_h > 0")
    stats = stats.select(label, "_n", "_h", (F.col("_low") - cut * F.col("_h")).alias("_low"), ((F.col("_high") - F.col("_low") + 2 * cut * F.col("_h")) / (points - 1)).alias("_step"))
    every = values.join(stats, label).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("_low") + F.col("point") * F.col("_step")
    z = (at - F.col("_v")) / F.col("_h")
    summed = every.groupBy(label, "point").agg(F.sum(F.exp(-z * z / 2)).alias("_s"), F.first("_n").alias("_n"), F.first("_h").alias("_h"), F.first(at).alias("at"))
    return summed.select(label, "point", "at", (F.col("_s") / (F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))).alias("density"))
