"""A recording: frames with features, their labels and the sessions' metadata, kept and cut together."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.sources.io import read_features, write_features


@dataclass(frozen=True)
class Recording:
    """``frames`` (id, frame, features) with the ``labels`` of the features, and ``meta``, one row for each id."""

    frames: DataFrame
    labels: list[str]
    meta: DataFrame

    def shape(self) -> DataFrame:
        """(n_frames, n_features), one row."""
        return self.frames.agg(F.count("*").alias("n_frames"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("n_features"))

    def meta_unique(self, column: str) -> DataFrame:
        """Distinct values of a column of the metadata."""
        return self.meta.select(column).distinct()

    def every(self, step: int) -> Recording:
        return replace(self, frames=self.frames.where(F.pmod(F.col("frame"), F.lit(step)) == 0))

    def of(self, condition: Column) -> Recording:
        """The sessions whose metadata meet a condition."""
        meta = self.meta.where(condition)
        return replace(self, frames=self.frames.join(meta.select("id"), "id", "left_semi"), meta=meta)

    def save(self, path: str) -> None:
        write_features(self.frames, self.labels, path, meta=self.meta)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recording:
        return cls(*read_features(spark, path), spark.read.parquet(f"{path}/meta"))


def joined_features(a: DataFrame, b: DataFrame, labels_a: list[str], labels_b: list[str], key: str = "frame") -> tuple[DataFrame, list[str]]:
    """(key, features) with labels: two feature sets side by side, for the frames that both have."""
    right = b.select(key, F.col("features").alias("_more"))
    return a.select(key, "features").join(right, key).select(key, F.concat("features", "_more").alias("features")), [*labels_a, *labels_b]


def joints(pose: DataFrame, order: list[int]) -> DataFrame:
    """Poses of the joints given, in that order."""
    return pose.withColumn("kp", F.array(*(F.get("kp", F.lit(j)) for j in order)))


def zipped(frames: DataFrame, labels: DataFrame, factor: int, key: str = "frame", place: str = "place") -> DataFrame:
    """Frames with the label at position frame // factor, as labels of downsampled frames have."""
    return frames.withColumn(place, F.floor(F.col(key) / factor)).join(labels, place).drop(place)


def first_appearance(frames: DataFrame, label: str = "label", key: str = "frame") -> DataFrame:
    """(label, first, place): labels by the frame in which they first appear."""
    first = frames.groupBy(label).agg(F.min(key).alias("first"))
    return first.withColumn("place", F.expr("cast(row_number() over (order by first) as long)"))  # one row for each label


def peak(frames: DataFrame, value: str, by: str = "id", key: str = "t") -> DataFrame:
    """(by, key, value) of each session's largest value, the first frame of equal ones."""
    best = frames.where(F.col(value).isNotNull()).groupBy(by).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(key)).alias("k"))).alias("m"))
    return best.select(by, (-F.col("m.k")).alias(key), F.col("m.v").alias(value))


def best_so_far(scores: DataFrame, parameter: str, metric: str) -> DataFrame:
    """Adds ``best``, the parameter with the smallest metric among those up to it; one row for each parameter."""
    w = F.expr(f"min(struct({metric}, {parameter})) over (order by {parameter} rows between unbounded preceding and current row)")
    return scores.withColumn("best", w[parameter])


def rolling(frames: DataFrame, value: str, window: int) -> DataFrame:
    """Adds ``window``: the values, nulls included, of an odd number of frames around each, end values repeated beyond the ends of a session."""
    if window % 2 == 0:
        raise ValueError("a rolling window has an odd number of frames")
    half = window // 2
    # A list of nulls would leave them out, one of structs does not.
    near = f"collect_list(struct({value} as v)) over (partition by id order by t rows between {half} preceding and {half} following)"
    back, ahead = (f"count(1) over (partition by id order by t rows between {x})" for x in (f"{half} preceding and current row", f"current row and {half} following"))
    held = frames.withColumns({"_near": F.expr(near), "_back": F.lit(half + 1) - F.expr(back), "_ahead": F.lit(half + 1) - F.expr(ahead)})
    ends = (F.array_repeat(F.element_at("_near", 1), F.col("_back").cast("int")), F.array_repeat(F.element_at("_near", -1), F.col("_ahead").cast("int")))
    return held.withColumn("window", F.transform(F.concat(ends[0], "_near", ends[1]), lambda x: x["v"])).drop("_near", "_back", "_ahead")


def borders(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(row, col, cluster) of the cells of a segmented map that have a neighbour above, below or beside them with another label (0 where the map has no cell)."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    asked = cells.where(F.col(cluster) > 0).select("row", "col", cluster, F.explode(steps).alias("s")).select("row", "col", cluster, (F.col("row") + F.col("s.a")).alias("_r"), (F.col("col") + F.col("s.b")).alias("_c"))
    other = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(cluster).alias("_o"))
    return asked.join(other, ["_r", "_c"], "left").where(F.coalesce("_o", F.lit(0)) != F.col(cluster)).select("row", "col", cluster).distinct()
