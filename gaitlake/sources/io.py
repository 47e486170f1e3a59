"""Reading and writing: configurations, metadata, poses, features."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.operators.reduce import Heuristic
from gaitlake.operators.skeleton import Skeleton, skeleton_from_config
from gaitlake.sources.mat5 import variables


def read_config(path: str) -> dict[str, Any]:
    with open(path) as f:
        return yaml.safe_load(f)


def read_skeleton(path: str) -> Skeleton:
    return skeleton_from_config(read_config(path))


def read_heuristics(path: str) -> dict[str, Heuristic]:
    """From YAML or JSON: behaviour to {high: [...], low: [...]}."""
    return {name: Heuristic(tuple(rule.get("high", ())), tuple(rule.get("low", ()))) for name, rule in read_config(path).items()}


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Session metadata from CSV with a header; ``id`` is the row's position: files by name, then pieces of a file by where they begin, then rows."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    if "id" in rows.columns:
        raise ValueError("the metadata already has a column id")
    held = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_piece")).withColumn("_at", F.monotonically_increasing_id())
    # One row for each piece of a file.
    sizes = held.groupBy("_file", "_piece").agg(F.count("*").alias("_n"))
    before = sizes.select("_file", "_piece", F.expr("coalesce(sum(_n) over (order by _file, _piece rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    place = F.col("_before") + F.expr("row_number() over (partition by _file, _piece order by _at)") - 1
    return held.join(before, ["_file", "_piece"]).select(*rows.columns, place.cast("int").alias("id"))


def read_behaviours(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(cluster, label) lines of a CSV with the columns Cluster and Label, in the order of the file: one line for each cluster, as ``motifs.labelled`` takes them."""
    return [(r["Cluster"], r["Label"]) for r in read_meta(spark, path).orderBy("id").select(F.col("Cluster").cast("int"), "Label").collect()]


def meta_by_frame(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Each frame with its session's metadata; an error if a session has none."""
    orphans = frames.select("id").distinct().join(meta.select("id"), "id", "left_anti")
    if not orphans.isEmpty():
        raise ValueError("some sessions have no metadata")
    return frames.join(meta, "id", "left")


def shifted_ids(frames: DataFrame) -> DataFrame:
    """Session ids from 0."""
    low = frames.agg(F.min("id").alias("_low"))
    return frames.join(F.broadcast(low)).withColumn("id", F.col("id") - F.col("_low")).drop("_low")


def write_pose(pose: DataFrame, path: str) -> None:
    pose.write.mode("overwrite").partitionBy("id").parquet(path)


def read_pose(spark: SparkSession, path: str) -> DataFrame:
    """A pose table; id 0 where the files have none."""
    pose = spark.read.parquet(path)
    return pose if "id" in pose.columns else pose.withColumn("id", F.lit(0))


def write_features(features: DataFrame, labels: Sequence[str], path: str, **extra: DataFrame) -> None:
    """Features with their labels beside them; further tables by name."""
    features.write.mode("overwrite").parquet(f"{path}/features")
    spark = features.sparkSession
    spark.range(1).select(F.from_json(F.lit(json.dumps(list(labels))), "array<string>").alias("labels")).coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")
    for name, table in extra.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    return spark.read.parquet(f"{path}/features"), list(spark.read.parquet(f"{path}/labels").first()[0])


#: Up to this number of files and sessions, files are joined by broadcast.
FEW_FILES = 10_000


def _plain(path: Column) -> Column:
    """Without scheme and closing slash."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), "(?<=.)/+$", "")


def pose_from_meta(spark: SparkSession, meta: DataFrame, column: str = "path") -> DataFrame:
    """All sessions' poses, each from the file or folder that its metadata names, in one scan.

    Names are resolved as Spark's readers do, relative ones from the working
    folder. A file belongs to the sessions named by it or by the nearest
    folder above it, so sessions that name the same folder each have its
    frames, and a folder named within another is read once. A file that no
    name leads to is an error.
    """
    names = [r[0] for r in meta.select(column).distinct().collect()]  # the reader takes a list of them
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = {}
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        whole[name] = path.getFileSystem(conf).makeQualified(path).toString()
    every = set(whole.values())
    roots = sorted(q for q in every if not any(q[:k] in every for k in range(1, len(q)) if q[k] == "/"))
    found = spark.createDataFrame(list(whole.items()), "_name string, _whole string")
    sessions = meta.select(F.col(column).alias("_name"), "id").join(found, "_name").select(_plain(F.col("_whole")).alias("_folder"), "id")
    pose = spark.read.option("recursiveFileLookup", "true").parquet(*roots).drop("id")
    few = max(len(pose.inputFiles()), meta.count()) <= FEW_FILES
    # File names come percent-encoded.
    pose = pose.withColumn("_file", _plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))))
    parts = F.split("_file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("folder")))
    owners = pose.select("_file").distinct().select("_file", F.explode(above).alias("a")).join(sessions, F.col("a.folder") == F.col("_folder"))
    deepest = F.expr("max(a.depth) over (partition by _file)")
    owners = owners.withColumn("_deepest", deepest).where("a.depth = _deepest").select("_file", "id")
    held = pose.join(F.broadcast(owners) if few else owners, "_file", "left")
    return held.withColumn("id", F.coalesce("id", F.raise_error(F.concat(F.lit("no session names "), "_file")).cast(meta.schema["id"].dataType))).drop("_file")


def read_extended(spark: SparkSession, path: str, *extra: str) -> tuple[DataFrame, list[str], dict[str, DataFrame]]:
    """Features, labels and the further tables that ``write_features`` wrote beside them."""
    features, labels = read_features(spark, path)
    return features, labels, {name: spark.read.parquet(f"{path}/{name}") for name in extra}


def stage(spark: SparkSession, path: str, made: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if an earlier run has finished it, otherwise made and written there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _h5(content: bytes) -> dict[str, Any]:
    """Datasets by name, those of groups by ``group/name``."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py") from e
    found: dict[str, Any] = {}
    with h5py.File(io.BytesIO(content)) as f:
        f.visititems(lambda name, held: found.update({name: held[()]}) if isinstance(held, h5py.Dataset) else None)
    return found


def _mat(content: bytes) -> dict[str, Any]:
    """Variables by name, fields of a struct by ``variable/field``; the newer format is HDF5, with axes reversed."""
    if content[:8] == b"\x89HDF\r\n\x1a\n" or content[512:520] == b"\x89HDF\r\n\x1a\n":
        return {k: np.asarray(v).T for k, v in _h5(content).items()}
    found: dict[str, Any] = {}
    for name, value in variables(content).items():
        found |= {f"{name}/{k}": v for k, v in value.items()} if isinstance(value, dict) else {name: value}
    return found


def frames_of(arrays: dict[str, Any], kind: str, joints: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(frames x joints x 3, session of each frame) out of a file's arrays.

    ``h5``: ``pose`` and perhaps ``id``. ``dannce``: ``pred``, frames x 3 x
    joints. ``predictions``: ``predictions/<joint>``, frames x 3 for each joint,
    in the order of ``joints``; joints that the file lacks are left out.
    """
    if kind == "h5":
        pose = np.asarray(arrays["pose"], float)
        ids = np.asarray(arrays["id"], int).reshape(-1) if "id" in arrays else np.zeros(len(pose), int)
        return pose, ids
    if kind == "dannce":
        pose = np.moveaxis(np.asarray(arrays["pred"], float), 1, 2)
    elif kind == "predictions":
        pose = np.stack([np.asarray(arrays[f"predictions/{j}"], float) for j in joints if f"predictions/{j}" in arrays], axis=1)
    else:
        raise ValueError(f"no such kind of pose file: {kind}")
    return pose, np.zeros(len(pose), int)


POSE = "id int, t long, frame long, kp array<struct<x:double,y:double,z:double>>"
#: Frames in a row group that a reader hands on at once.
READ_FRAMES = 4096


def pose_files(spark: SparkSession, path: str | Sequence[str], kind: str, joints: Sequence[str] = ()) -> DataFrame:
    """(path, id, t, frame, kp) of HDF5 or MATLAB files, each read by one task, in whatever store Spark reads; ``kind`` as in ``frames_of``. HDF5, and MATLAB files that are HDF5, need h5py on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                pose, ids = frames_of((_h5 if kind == "h5" else _mat)(content), kind, joints)
                t = pd.Series(ids).groupby(ids).cumcount().to_numpy()
                for a in range(0, len(pose), READ_FRAMES):
                    part = pose[a : a + READ_FRAMES]
                    kp = [[{"x": x, "y": y, "z": z} for x, y, z in frame.tolist()] for frame in part]
                    yield pd.DataFrame({"path": name, "id": ids[a : a + READ_FRAMES], "t": t[a : a + READ_FRAMES], "frame": np.arange(a, a + len(part)), "kp": kp})

    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content")
    return files.mapInPandas(read, f"path string, {POSE}")


def pose_h5(spark: SparkSession, path: str) -> DataFrame:
    """(id, t, frame, kp) from HDF5 with datasets ``pose`` (frames, joints, 3) and perhaps ``id``; needs h5py."""
    return pose_files(spark, path, "h5").drop("path")


def mat_variable(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(k, v): the rows of a variable, from 0; a vector, whichever way it lies, has a number in each, and of a cell array the first cell that holds numbers counts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                value = _mat(content)[name]
                if isinstance(value, np.ndarray) and value.dtype == object:
                    value = next(v for v in value.ravel(order="F") if isinstance(v, np.ndarray) and v.size)
                value = np.atleast_2d(np.asarray(value, float))
                value = value.reshape(-1, 1) if 1 in value.shape else value
                for a in range(0, len(value), READ_FRAMES):
                    part = value[a : a + READ_FRAMES]
                    yield pd.DataFrame({"k": np.arange(a, a + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "k long, v array<double>")


def features_mat(spark: SparkSession, analysis: str, pose: str, session: str, downsample: int = 1) -> tuple[DataFrame, int]:
    """((frame, id, features), step) of a MATLAB analysis: ``jt_features`` of the frames in ``frames_with_good_tracking`` (from 1), every ``downsample``-th of them, with the sessions that variable ``session`` of the pose file gives to all frames, their ids shifted to 0; ``step`` is the recording frames between two features."""
    kept = F.col("k") % downsample == 0
    features = mat_variable(spark, analysis, "jt_features").where(kept).select("k", F.col("v").alias("features"))
    frames = mat_variable(spark, analysis, "frames_with_good_tracking").where(kept).select("k", (F.col("v")[0].cast("long") - 1).alias("frame"))
    ids = mat_variable(spark, pose, session).select(F.col("k").alias("frame"), F.col("v")[0].cast("int").alias("id"))
    ids = ids.join(F.broadcast(ids.agg(F.min("id").alias("_low")))).select("frame", (F.col("id") - F.col("_low")).alias("id"))
    step = int(mat_variable(spark, analysis, "tsnegranularity").first()["v"][0])
    return features.join(frames, "k").join(ids, "frame").select("frame", "id", "features"), downsample * step


def good_frames(features: DataFrame, frames: Sequence[int], step: int = 20, frame: str = "frame") -> DataFrame:
    """Features of the recording frames given by their numbers from 1, every ``step``-th of them; ``frame`` counts features from 0 and becomes the recording's frame."""
    spark = features.sparkSession
    kept = [(k, int(f) - 1) for k, f in enumerate(frames) if k % step == 0]
    picked = spark.createDataFrame(kept, "_k long, _frame long")
    return features.join(picked, F.col(frame) == F.col("_k")).withColumn(frame, F.col("_frame")).drop("_k", "_frame")
