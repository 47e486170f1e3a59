"""Aggregates: scaling, cluster occupancy, heuristics, principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gaitlake.functions.shared import numbered


def moments(frames: DataFrame, column: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """(means, population deviations) of an array column's positions; a position of equal values has deviation 0. Tasks sum up their rows, positions are added up by number."""

    one = frames.select(F.col(column).cast("array<double>")).first()
    if one is None:
        return np.zeros(0), np.zeros(0)
    # Sums of differences from one row: large values of small spread keep their digits.
    shift = np.array(one[0], float)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square, low, high = 0, 0.0, 0.0, np.inf, -np.inf
        for batch in batches:
            x = _rows(batch.column(0))
            if not len(x):
                continue
            x = x - shift
            own, both = x.mean(0), n + len(x)
            square = square + ((x - own) ** 2).sum(0) + (own - mean) ** 2 * n * len(x) / both
            mean = mean + (own - mean) * len(x) / both
            n, low, high = both, np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.record_batch({"j": np.arange(len(mean)), "n": np.full(len(mean), n), "mean": mean, "square": square, "low": low, "high": high})

    parts = frames.select(F.col(column).cast("array<double>")).mapInArrow(partial, "j long, n long, mean double, square double, low double, high double")
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    sums = parts.groupBy("j").agg(n.alias("n"), (mean / n).alias("mean"), F.sum("square").alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("between"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("j").collect()
    means = np.array([r["mean"] for r in sums], float)
    square = np.array([r["within"] + r["between"] - r["n"] * r["mean"] ** 2 for r in sums], float)
    flat = np.array([r["low"] == r["high"] for r in sums], bool)
    return shift + np.where(flat, 0.0, means), np.where(flat, 0.0, np.sqrt(np.maximum(square, 0) / np.array([max(r["n"], 1) for r in sums], float)))


def _rows(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as rows; a null list or number is an error."""
    flat = column.flatten()
    if column.null_count or flat.null_count:
        raise ValueError("features must not be null")
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def standard_scaled(frames: DataFrame, labels: Sequence[str], column: str = "features", clip: float | None = None) -> tuple[DataFrame, list[str]]:
    """Standard scores over all rows, without columns of deviation 0, cut off at +-clip."""
    mean, sd = moments(frames, column)
    keep = [j for j in range(len(mean)) if sd[j] != 0]

    def score(j: int) -> Column:
        x = (F.col(column)[j] - float(mean[j])) / float(sd[j])
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), x)) if clip else x

    return frames.withColumn(column, F.array(*(score(j) for j in keep))), [labels[j] for j in keep]


def cluster_shares(labels: DataFrame, cluster: str = "cluster", clusters: int | None = None) -> DataFrame:
    """(cluster, freq): share of each of the clusters 0 to n - 1; labels beyond do not count; NaN without any."""
    clusters = clusters or (labels.agg(F.max(cluster)).first()[0] or 0) + 1
    found = labels.where(F.col(cluster).between(0, clusters - 1)).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    spine = labels.sparkSession.range(clusters).select(F.col("id").cast("int").alias("cluster"))
    return spine.join(F.broadcast(found), "cluster", "left").join(F.broadcast(total)).select("cluster", F.coalesce(F.coalesce("n", F.lit(0)) / F.col("total"), F.lit(float("nan"))).alias("freq"))


def cluster_shares_by(labels: DataFrame, cat: str, cluster: str = "cluster", clusters: int | None = None, empty: float = float("nan")) -> DataFrame:
    """(cat, cluster, freq): shares within each category, every cluster in every category; ``empty`` where a category has no counted label."""
    clusters = clusters or (labels.agg(F.max(cluster)).first()[0] or 0) + 1
    counts = labels.where(F.col(cluster).between(0, clusters - 1)).groupBy(F.col(cat).alias("cat"), F.col(cluster).cast("int").alias("cluster")).agg(F.count("*").alias("n"))
    totals = labels.groupBy(F.col(cat).alias("cat")).agg(F.count(F.when(F.col(cluster).between(0, clusters - 1), 1)).alias("total"))
    spine = totals.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
    found = counts.withColumnsRenamed({"cat": "_cat", "cluster": "_cluster"})
    rows = spine.join(found, F.col("cat").eqNullSafe(F.col("_cat")) & (F.col("cluster") == F.col("_cluster")), "left")
    return rows.select("cat", "cluster", F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(F.lit(empty)).alias("freq"))


def mean_sem(shares: DataFrame, group: str) -> DataFrame:
    """(group, cluster, mean, sem) over categories; the standard error from the population deviation."""
    return shares.groupBy(group, "cluster").agg(F.avg("freq").alias("mean"), (F.stddev_pop("freq") / F.sqrt(F.count("*"))).alias("sem"))


@dataclass(frozen=True)
class Heuristic:
    """A behaviour's score: features that speak for it and against it."""

    high: tuple[str, ...]
    low: tuple[str, ...] = ()


def heuristic_score(labels: Sequence[str], rule: Heuristic, column: str = "features", clip: float = 2.5) -> tuple[Column, list[str]]:
    """(score, names not found): mean of the features cut off at +-clip, those against it negated; NaN if none is found."""
    place = {name: j for j, name in enumerate(labels)}
    cut = lambda j, sign: F.greatest(F.lit(-clip), F.least(F.lit(clip), sign * F.col(column)[j]))
    terms = [cut(place[n], 1) for n in rule.high if n in place] + [cut(place[n], -1) for n in rule.low if n in place]
    missing = [n for n in (*rule.high, *rule.low) if n not in place]
    return (sum(terms[1:], terms[0]) / len(terms) if terms else F.lit(float("nan"))), missing


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``place``, the row's position from 1 in the order given (nulls first); equal rows share nothing but their neighbourhood, so a constant score is dealt out by the further columns. A table."""
    return numbered(rows, *order, name="_place").withColumn("place", (F.col("_place") + 1).cast("long")).drop("_place")


def selected(labels: Sequence[str], category: str) -> list[int]:
    """Positions of the labels of a category: those that begin with it or hold it between underscores."""
    return [j for j, name in enumerate(labels) if name.startswith(f"{category}_") or f"_{category}_" in name]


@dataclass(frozen=True)
class Pca:
    """Components (columns) of one category's features, largest first; the largest loading of each is positive."""

    positions: list[int]
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float


def gram(frames: DataFrame, positions: Sequence[int], mean: np.ndarray, column: str = "features") -> tuple[np.ndarray, int]:
    """Sum of outer products of the centred rows and their number: one partial matrix for each task, added up by key."""
    own, centre = list(positions), np.asarray(mean)
    d = len(own)

    def partial(batches):  # noqa: ANN001, ANN202
        total, n = np.zeros((d, d)), 0
        for rows in batches:
            if len(rows):
                x = np.stack(rows[column])[:, own] - centre
                total += x.T @ x
                n += len(x)
        yield pd.DataFrame({"i": np.arange(d), "row": list(total), "n": n})

    parts = frames.select(column).mapInPandas(partial, "i int, row array<double>, n long")
    sums = parts.groupBy("i").agg(F.array(*(F.sum(F.col("row")[k]) for k in range(d))).alias("row"), F.sum("n").alias("n")).orderBy("i").collect()
    return np.array([r["row"] for r in sums], float).reshape(d, d), (sums[0]["n"] if sums else 0)


def fit_pca(frames: DataFrame, positions: Sequence[int], n: int, column: str = "features", sample: DataFrame | None = None) -> Pca:
    """Fits on ``sample`` (default: all rows). Means are of all rows; the sample is centred on its own as well."""
    own = list(positions)
    means = lambda df: moments(df.select(F.array(*(F.col(column)[j] for j in own)).alias(column)), column)[0]
    mean = means(frames)
    g, rows = gram(sample if sample is not None else frames, own, mean if sample is None else means(sample), column)
    values, vectors = np.linalg.eigh(g / max(rows, 1))
    vectors = vectors[:, ::-1][:, :n]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Pca(own, mean, vectors, np.maximum(values[::-1][:n], 0), float(np.trace(g) / max(rows, 1)))


def project(frames: DataFrame, model: Pca, column: str = "features", name: str = "scores") -> DataFrame:
    """Adds the scores: the centred features times the components, a matrix product for each batch."""
    shared = frames.sparkSession.sparkContext.broadcast((model.positions, model.mean, model.components))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mean, components = shared.value
        for batch in batches:
            x = _rows(batch.column(column))
            y = (x[:, own] - mean) @ components if len(x) else np.zeros((0, components.shape[1]))
            yield batch.append_column(name, pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.array(y.ravel())))

    return frames.mapInArrow(scored, StructType([*frames.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def pca(frames: DataFrame, labels: Sequence[str], categories: Sequence[str] = ("vel", "ego_euc", "ang", "avel"), n: int = 10, stride: int = 1, column: str = "features", frame: str = "frame", method: str = "exact") -> tuple[DataFrame, list[str]]:
    """Adds ``scores`` of all categories in a row, with labels {category}_pc{i}; fitted on every ``stride``-th frame.

    ``method`` is exact (a matrix of all pairs of a category's columns),
    randomised (for thousands of columns) or incremental (on all frames).
    """
    from gaitlake.operators import components

    if method not in ("exact", "randomised", "incremental"):
        raise ValueError(f"unknown method {method}")
    names, parts = [], []
    for c in categories:
        own = selected(labels, c)
        if not own:
            raise ValueError(f"no feature of category {c}")
        some = frames.where(F.pmod(F.col(frame), F.lit(stride)) == 0) if stride > 1 else None
        model = components.fit_incremental(frames, own, n, column) if method == "incremental" else (fit_pca if method == "exact" else components.fit_randomised)(frames, own, n, column, some)
        frames = project(frames, model, column, f"_s{len(parts)}")
        parts.append(f"_s{len(parts)}")
        names += [f"{c}_pc{i}" for i in range(model.components.shape[1])]
    return frames.withColumn("scores", F.concat(*parts)).drop(*parts), names


def density_histogram(values: DataFrame, column: str, low: float, high: float, bins: int = 1000) -> DataFrame:
    """(bin, density) of the values within [low, high], the last bin closed."""
    width = (high - low) / bins
    found = values.where(F.col(column).between(low, high)).groupBy(F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / (high - low) * bins).cast("int")).alias("bin")).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(found.agg(F.sum("n").alias("total")))).select("bin", (F.col("n") / (F.col("total") * width)).alias("density"))
