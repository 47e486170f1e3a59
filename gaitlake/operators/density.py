"""Two-dimensional densities and their segmentation: counts in Spark, the bounded grid on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.functions.numbers import bin_of
from gaitlake.operators import kernels


def padded_range(points: DataFrame, pad: float = 0.025) -> tuple[tuple[float, float], tuple[float, float]]:
    """Smallest and largest x and y, with a margin of ``pad`` times the width between the next whole numbers."""
    a, b, c, d = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    margin = lambda low, high: int(math.ceil(high) - math.floor(low)) * pad
    return (a - margin(a, b), b + margin(a, b)), (c - margin(c, d), d + margin(c, d))


@dataclass
class Density:
    """Gaussian density on an n x n grid; row 0 is the largest y."""

    sigma: float = 15.0
    bins: int = 1000
    most: float = 0.75
    log: bool = False
    pad: float = 0.025
    range: tuple[tuple[float, float], tuple[float, float]] | None = None
    grid: np.ndarray | None = field(default=None, repr=False)

    def cells(self, points: DataFrame) -> DataFrame:
        """Adds ``row`` and ``col``, null outside the range."""
        (a, b), (c, d) = self.range
        return points.withColumns({"row": F.lit(self.bins - 1) - bin_of(F.col("y"), c, d, self.bins), "col": bin_of(F.col("x"), a, b, self.bins)})

    def histogram(self, points: DataFrame, new: bool = True) -> DataFrame:
        """(row, col, n) of the cells with points; ``new`` takes the range from the points."""
        if new or self.range is None:
            self.range = padded_range(points, self.pad)
        return self.cells(points).where("row is not null and col is not null").groupBy("row", "col").agg(F.count("*").alias("n"))

    def fit(self, points: DataFrame, new: bool = True) -> np.ndarray:
        """Filtered counts, optionally ln(1 + d), cut off at ``most`` times the largest."""
        grid = np.zeros((self.bins, self.bins))
        for r, c, n in self.histogram(points, new).collect():  # at most bins * bins cells
            grid[r, c] = n
        grid = self.smoothed(grid)
        if new:
            self.grid = grid
        return grid

    def smoothed(self, counts: np.ndarray) -> np.ndarray:
        grid = kernels.gaussian(counts, self.sigma)
        if self.log:
            grid = np.log1p(grid)
        return np.minimum(grid, grid.max() * self.most)

    def lookup(self, axis: str, low: float, high: float, shifted: bool = False) -> Column:
        """Row or column to look a point up in. ``shifted`` is the historical rule: rows one less than the histogram's, and -1 at the upper end."""
        if not shifted:
            b = bin_of(F.greatest(F.lit(low), F.least(F.lit(high), F.col(axis))), low, high, self.bins)
            return F.lit(self.bins - 1) - b if axis == "y" else b
        k = F.floor((F.col(axis) - low) / (high - low) * self.bins).cast("int")
        b = F.when(F.col(axis) < low, F.lit(-1)).when(F.col(axis) >= high, F.lit(-1)).otherwise(k)
        return F.lit(self.bins - 2) - b if axis == "y" else b

    def mapped(self, points: DataFrame, shifted: bool = False) -> DataFrame:
        (a, b), (c, d) = self.range
        return points.withColumns({"row": self.lookup("y", c, d, shifted), "col": self.lookup("x", a, b, shifted)})


@dataclass
class Watershed(Density):
    """Basins of the density; label 0 where it is below the threshold."""

    most: float = 1.0
    log: bool = True
    pad: float = 0.0
    least: float = 1e-3
    labels: np.ndarray | None = field(default=None, repr=False)

    def segment(self, points: DataFrame) -> np.ndarray:
        grid = self.fit(points)
        self.labels = kernels.watershed(grid, grid > self.least)
        return self.labels

    def predict(self, points: DataFrame, shifted: bool = False) -> DataFrame:
        """Adds ``cluster`` by a join with the labelled cells, of which there are bins * bins at most."""
        spark = points.sparkSession
        cells = [(int(r), int(c), int(self.labels[r, c])) for r, c in np.argwhere(self.labels > 0)]
        table = spark.createDataFrame(cells or [(-9, -9, 0)], "row int, col int, cluster int")
        return self.mapped(points, shifted).join(F.broadcast(table), ["row", "col"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))

    def fit_predict(self, points: DataFrame) -> DataFrame:
        self.segment(points)
        return self.predict(points)


def masked(density: np.ndarray, labels: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """Density, at least ``least`` within labelled cells and 0 elsewhere."""
    return np.where(labels > 0, np.maximum(density, least), 0.0)


def density_by(points: DataFrame, by: str | Sequence[str], fitted: Watershed) -> DataFrame:
    """(*by, row, col, density) of each category, or combination of them, on the fitted axes, masked by the fitted labels.

    Counted in one pass; a category's grid is one task's work, of bins * bins cells at most.
    """
    by = [by] if isinstance(by, str) else list(by)
    counts = fitted.cells(points).where("row is not null and col is not null").groupBy(*by, "row", "col").agg(F.count("*").alias("n"))

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((fitted.bins, fitted.bins))
        grid[rows["row"], rows["col"]] = rows["n"]
        grid = masked(fitted.smoothed(grid), fitted.labels, fitted.least)
        row, col = np.nonzero(grid > 0)
        return pd.DataFrame({**{k: [rows[k].iloc[0]] * len(row) for k in by}, "row": row, "col": col, "density": grid[row, col]})

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in by)
    return counts.groupBy(*by).applyInPandas(smooth, f"{kinds}, row int, col int, density double")


def feature_grid(points: DataFrame, value: str, density: Density) -> DataFrame:
    """(row, col, value): mean of a feature in each cell, the smallest value of all in cells without points."""
    found = density.cells(points).where("row is not null and col is not null").groupBy("row", "col").agg(F.avg(value).alias("v"))
    low = points.agg(F.min(value).alias("low"))
    n = density.bins
    spine = points.sparkSession.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    return spine.join(found, ["row", "col"], "left").join(F.broadcast(low)).select("row", "col", F.coalesce("v", "low").alias("value"))
