"""Embedding of a template, of all frames on it, and its validation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.functions.shared import written
from gaitlake.operators import kernels, layout
from gaitlake.operators.density import Watershed
from gaitlake.operators.forest import near, near_parts
from gaitlake.operators.neighbors import knn_regress

#: Up to this many rows, t-SNE works on all pairs of them, in one process; beyond, through an index and a grid.
EXACT_ROWS = 2000
#: Large batches that are embedded at a time: tasks of one use the cores that few tasks of the other leave.
LARGE_BATCHES = 2


def sample_per_cluster(points: DataFrame, cluster: str | Sequence[str] = "cluster", n: int = 20, seed: int = 0, key: str = "frame") -> DataFrame:
    """``n`` rows of each cluster in an order given by a hash; clusters with fewer rows are left out. ``cluster`` may be several columns."""
    by = cluster if isinstance(cluster, str) else ", ".join(cluster)
    w = F.expr(f"row_number() over (partition by {by} order by pmod({key} * 7919 + {seed}, 10007), {key})")
    size = F.expr(f"count(1) over (partition by {by})")
    return points.withColumns({"_r": w, "_n": size}).where((F.col("_n") >= n) & (F.col("_r") <= n)).drop("_r", "_n")


@dataclass
class Embedding:
    """A template in feature space and on the plane; all else is placed by its nearest template rows.

    ``method`` is tsne or umap. The template is a table (frame, features, y).
    """

    method: str = "tsne"
    perplexity: float = 30.0
    neighbors: int = 15
    min_dist: float = 0.5
    spread: float = 1.0
    rounds: int = 500
    seed: int = 0
    template: DataFrame | None = field(default=None, repr=False)

    def fit(self, template: DataFrame, key: str = "frame", column: str = "features") -> Embedding:
        rows = template.select(F.col(key).cast("long").alias("frame"), F.col(column).cast("array<double>").alias("features"))
        if self.method == "umap":
            self.template = layout.umap(rows, neighbors=self.neighbors, min_dist=self.min_dist, spread=self.spread, epochs=min(self.rounds, 200), seed=self.seed)
        elif self.method == "tsne":
            some = rows.limit(EXACT_ROWS + 1).collect()
            if len(some) > EXACT_ROWS:
                self.template = layout.tsne(rows, perplexity=self.perplexity, rounds=self.rounds, early=self.rounds // 4, seed=self.seed)
            else:
                some = sorted(some, key=lambda r: r[0])
                plane = kernels.tsne(np.array([r[1] for r in some], float).reshape(len(some), len(some[0][1]) if some else 0), self.perplexity, self.rounds, self.seed)
                self.template = written(template.sparkSession.createDataFrame([(r[0], r[1], y.tolist()) for r, y in zip(some, plane, strict=True)], "frame long, features array<double>, y array<double>"))
        else:
            raise ValueError(f"unknown method {self.method}")
        return self

    def plane(self) -> DataFrame:
        """(frame, x, y) of the template."""
        return self.template.select("frame", F.col("y")[0].alias("x"), F.col("y")[1].alias("y"))

    def predict(self, points: DataFrame, method: str = "knn", k: int = 5, weights: str = "distance") -> DataFrame:
        """(frame, x, y) of every row: from its nearest template rows (knn), from two random forests (forest), or moved by UMAP's edges to its nearest template rows (umap)."""
        held = self.template
        if method == "knn":
            out = knn_regress(points, held, held, k, weights, found=near(points, held, k, skip_self=False, seed=self.seed))
        elif method == "umap":
            out = layout.umap_transform(points, held, neighbors=self.neighbors, min_dist=self.min_dist, spread=self.spread, seed=self.seed)
        elif method == "forest":
            from pyspark.ml.functions import array_to_vector
            from pyspark.ml.regression import RandomForestRegressor

            train = held.select(array_to_vector("features").alias("v"), F.col("y")[0].alias("a"), F.col("y")[1].alias("b"))
            out = points.select("frame", array_to_vector(F.col("features").cast("array<double>")).alias("v"))
            for label, name in (("a", "x"), ("b", "y")):
                out = RandomForestRegressor(featuresCol="v", labelCol=label, predictionCol=name, seed=self.seed).fit(train).transform(out)
            return out.select("frame", "x", "y")
        else:
            raise ValueError(f"unknown method {method}")
        return out.select("frame", F.col("y")[0].alias("x"), F.col("y")[1].alias("y"))

    def save(self, path: str) -> None:
        """Template and parameters as tables, wherever Spark writes."""
        spark = self.template.sparkSession
        self.template.write.mode("overwrite").parquet(f"{path}/template")
        held = {k: v for k, v in self.__dict__.items() if k not in ("template", "picked")}
        spark.createDataFrame([(json.dumps(held),)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedding:
        model = cls(**json.loads(spark.read.text(f"{path}/model").first()[0]))
        model.template = spark.read.parquet(f"{path}/template")
        return model


def batch_clusters(points: DataFrame, batch: str, sigma: float = 15.0, bins: int = 1000, perplexity: float = 30.0, rounds: int = 500, seed: int = 0, key: str = "frame", column: str = "features", most: int = EXACT_ROWS) -> DataFrame:
    """(batch, key, cluster): every row's basin in the embedding of its own batch. Batches of at most ``most`` rows are a task each; larger ones are embedded LARGE_BATCHES at a time, each by all tasks. A null batch is one of its own."""
    rows = points.select(batch, F.col(key).cast("long").alias("_key"), F.col(column).cast("array<double>").alias("_x"))
    sizes = rows.groupBy(F.col(batch).alias("_b")).agg(F.count("*").alias("_n"))
    rows = written(rows.join(sizes, F.col(batch).eqNullSafe(F.col("_b"))).drop("_b"))

    def own(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_key")
        plane = kernels.tsne(np.stack(group["_x"]), perplexity, rounds, seed)
        return pd.DataFrame({batch: group[batch], key: group["_key"], "cluster": kernels.segmented(plane, bins, sigma)})

    kind = points.schema[batch].dataType.simpleString()
    out = rows.where(F.col("_n") <= most).select(batch, "_key", "_x").groupBy(batch).applyInPandas(own, f"`{batch}` {kind}, `{key}` long, cluster long")

    def large(one: object) -> DataFrame:
        mine = rows.where(F.col(batch).eqNullSafe(F.lit(one))).select(F.col("_key").alias("frame"), F.col("_x").alias("features"))
        plane = Embedding("tsne", perplexity, rounds=rounds, seed=seed).fit(mine).plane()
        found = Watershed(sigma=sigma, bins=bins).fit_predict(plane)
        return found.select(F.lit(one).cast(kind).alias(batch), F.col("frame").alias(key), F.col("cluster").cast("long").alias("cluster"))

    many = [r[0] for r in rows.where(F.col("_n") > most).select(batch).distinct().orderBy(batch).collect()]  # a line each
    with ThreadPoolExecutor(LARGE_BATCHES) as pool:
        for found in pool.map(large, many):
            out = out.unionByName(found)
    return out


def batch_template(points: DataFrame, batch: str, n: int = 20, sigma: float = 15.0, bins: int = 1000, perplexity: float = 30.0, rounds: int = 500, seed: int = 0) -> DataFrame:
    """Rows of every batch that stand for its clusters: each batch is embedded, segmented, and sampled by cluster; adds ``cluster``. Frames differ between batches."""
    labelled = batch_clusters(points, batch, sigma, bins, perplexity, rounds, seed)
    picked = written(sample_per_cluster(labelled, (batch, "cluster"), n, seed)).select("frame", "cluster")
    return points.join(picked, "frame")


@dataclass
class BatchEmbedding(Embedding):
    """An embedding whose template is sampled from the clusters of batches; ``picked`` has the frames of the template and their batches and clusters."""

    sampled: int = 20
    sigma: float = 15.0
    bins: int = 1000
    picked: DataFrame | None = field(default=None, repr=False)

    def fit_batches(self, points: DataFrame, batch: str) -> BatchEmbedding:
        template = written(batch_template(points, batch, self.sampled, self.sigma, self.bins, self.perplexity, self.rounds, self.seed))
        self.picked = template.select(batch, "frame", "cluster")
        self.fit(template)
        return self

    def fit_predict(self, points: DataFrame, batch: str, **how: object) -> DataFrame:
        """(frame, x, y) of every row on the template of all batches."""
        return self.fit_batches(points, batch).predict(points, **how)


def kfold_errors(model: Embedding, ks: Sequence[int], folds: int = 5, seed: int = 0, sigma: float = 2.0, bins: int = 100) -> DataFrame:
    """(k, mse, distance, accuracy, best) of the template's rows, each placed by those of the other folds, and the k up to each that has the smallest mse.

    Folds are given by a hash of the frame. Errors are relative to the
    diagonal of the template's bounding box; accuracy is the share of rows
    that fall into their own segment. Neighbours are sought once, for the
    largest k and for all folds.
    """
    from gaitlake.operators.recording import best_so_far

    held = model.template.withColumn("fold", F.pmod(F.xxhash64("frame", F.lit(seed)), F.lit(folds)))
    found = near_parts(held, "fold", max(ks), seed=seed).withColumn("fold", F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(folds)))
    plane, spark = model.plane(), held.sparkSession
    tried = spark.createDataFrame([(int(k),) for k in ks], "k int")
    each = written(found).join(F.broadcast(tried), F.col("rank") <= F.col("k"))
    floor = F.coalesce(F.min(F.when(F.col("d2") > 0, F.col("d2"))) * 0.5, F.lit(1.0))
    each = each.join(F.broadcast(each.groupBy("k", "fold").agg(floor.alias("floor"))), ["k", "fold"]).withColumn("w", 1 / F.greatest("d2", "floor"))
    each = each.join(plane.withColumnRenamed("frame", "dst"), "dst")
    placed = written(each.groupBy("k", F.col("src").alias("frame")).agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "xy")))
    shed = Watershed(sigma=sigma, bins=bins)
    truth = shed.fit_predict(plane).select("frame", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("cluster").alias("_cluster"))
    extent = plane.agg(F.sqrt(F.pow(F.max("x") - F.min("x"), 2) + F.pow(F.max("y") - F.min("y"), 2)).alias("extent"))
    both = shed.predict(placed).join(truth, "frame").join(F.broadcast(extent))
    off = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    errors = both.groupBy("k").agg((F.avg(off) / F.pow(F.first("extent"), 2)).alias("mse"), (F.avg(F.sqrt(off)) / F.first("extent")).alias("distance"), F.avg((F.col("cluster") == F.col("_cluster")).cast("double")).alias("accuracy"))
    return best_so_far(errors, "k", "mse")
