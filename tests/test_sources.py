"""Files with awkward names, and the operators on recordings."""

import os

import pytest
from pyspark.sql import functions as F

from gaitlake.operators import recording, reduce
from gaitlake.sources import io


def test_a_session_is_not_another_whose_name_begins_alike(spark, tmp_path):
    """s1 and s10, a name with a space, nested folders, and a file named itself."""
    for k, name in enumerate(("s1", "s10", "s 1", "deep/s1/part")):
        spark.range(k + 1).select(F.col("id").alias("t"), F.lit(k).alias("k"), F.lit(9).alias("id")).coalesce(1).write.parquet(str(tmp_path / name))
    (single,) = (tmp_path / "s10").glob("*.parquet")
    meta = spark.createDataFrame([(5, str(tmp_path / "s1")), (6, f"file://{single}"), (7, str(tmp_path / "s 1") + "/"), (8, str(tmp_path / "deep"))], "id int, path string")
    got = io.pose_from_meta(spark, meta).groupBy("id", "k").count().collect()
    assert {(r["id"], r["k"]): r["count"] for r in got} == {(5, 0): 1, (6, 1): 2, (7, 2): 3, (8, 3): 4}


def test_sessions_by_relative_shared_and_nested_folders(spark, tmp_path):
    """Two sessions on one folder both get its frames; a folder within a named one goes to its own session alone."""
    for k, name in enumerate(("s1", "s1/inner", "a+b%20c")):
        spark.range(k + 1).select(F.col("id").alias("t"), F.lit(k).alias("k")).coalesce(1).write.parquet(str(tmp_path / name))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(".").getFileSystem(conf).getWorkingDirectory().toString().removeprefix("file:")
    relative = os.path.relpath(tmp_path / "s1", base)
    meta = spark.createDataFrame([(0, relative), (1, str(tmp_path / "s1")), (2, str(tmp_path / "s1" / "inner")), (3, str(tmp_path / "a+b%20c"))], "id int, path string")
    got = io.pose_from_meta(spark, meta)
    assert got.schema["id"].dataType.simpleString() == "int"
    assert {(r["id"], r["k"]): r["count"] for r in got.groupBy("id", "k").count().collect()} == {(0, 0): 1, (1, 0): 1, (2, 1): 2, (3, 2): 3}


def test_rolling_windows_hold_nulls(spark):
    frames = spark.createDataFrame([(0, t, None if t == 2 else float(t)) for t in range(5)], "id int, t int, v double")
    got = {r["t"]: r["window"] for r in recording.rolling(frames, "v", 3).collect()}
    assert got == {0: [0.0, 0.0, 1.0], 1: [0.0, 1.0, None], 2: [1.0, None, 3.0], 3: [None, 3.0, 4.0], 4: [3.0, 4.0, 4.0]}


def test_positions_in_metadata_follow_files_and_pieces(spark, tmp_path):
    lines = [f"{k},{'x' * 50}" for k in range(4000)]
    for a, name in ((0, "a.csv"), (2500, "b.csv")):
        (tmp_path / name).write_text("\n".join(["number,text", *lines[a : 2500 if not a else 4000]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = io.read_meta(spark, str(tmp_path)).select("number", "id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 4000
    assert all(r["number"] == r["id"] for r in got)


def test_places_are_those_of_one_global_order(spark):
    rows = [(k, float(k * 7919 % 501)) for k in range(2000)] + [(k, 3.0) for k in range(2000, 2600)]
    got = reduce.placed(spark.createDataFrame(rows, "frame long, score double").repartition(7), "score", "frame").collect()
    want = {f: p + 1 for p, (_, f) in enumerate(sorted((s, f) for f, s in rows))}
    assert {r["frame"]: r["place"] for r in got} == want
    assert reduce.placed(spark.createDataFrame([], "frame long, score double"), "score", "frame").count() == 0


def test_recording_is_kept(spark, tmp_path):
    frames = spark.createDataFrame([(k % 3, k, [float(k), 1.0]) for k in range(12)], "id int, frame long, features array<double>")
    meta = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "id int, kind string")
    recording.Recording(frames, ["x", "y"], meta).save(str(tmp_path / "r"))
    held = recording.Recording.load(spark, str(tmp_path / "r"))
    assert held.labels == ["x", "y"]
    assert held.shape().first()[:] == (12, 2)
    assert {r[0] for r in held.meta_unique("kind").collect()} == {"a", "b"}
    assert sorted(r["frame"] for r in held.of(F.col("kind") == "b").every(2).frames.collect()) == [2, 8]


def test_rolling_windows_repeat_ends(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7)], "id int, t int, v int")
    assert {(r["id"], r["t"]): r["window"] for r in recording.rolling(df, "v", 5).collect()} == {(1, 0): [5, 5, 5, 6, 6], (1, 1): [5, 5, 6, 6, 6], (2, 0): [7] * 5}
    with pytest.raises(ValueError, match="odd"):
        recording.rolling(df, "v", 4)
