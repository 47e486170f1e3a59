import numpy as np
import pytest

from pyspark.sql import functions as F

from gaitlake.operators import motifs
from gaitlake.operators.density import Watershed, masked
from gaitlake.operators.skeleton import Skeleton, skeleton_from_module
from gaitlake.sources import io


def greedy(frames, n, length, apart, total):
    order = sorted((f for f in frames if length / 2 <= f <= total - length / 2), key=lambda f: (f * 7919 % 10007, f))
    picks = []
    for f in order:
        if len(picks) < n and all(abs(f - p) >= apart for p in picks):
            picks.append(f)
    return picks


@pytest.mark.parametrize(("n", "apart"), [(9, 3), (4, 25), (1, 1)])
def test_centres_equal_greedy_over_all_frames(spark, n, apart):
    frames = [(k, k * k % 3) for k in range(400)]
    found = motifs.motif_centres(spark.createDataFrame(frames, "frame long, cluster int"), n=n, frames=10, apart=apart).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["cluster"], r["sample"])):
        got.setdefault(r["cluster"], []).append(r["frame"])
    assert got == {c: greedy([f for f, k in frames if k == c], n, 10, apart, 400) for c in {k for _, k in frames}}


def test_frames_around_a_centre(spark):
    centres = spark.createDataFrame([(1, 0, 50)], "cluster int, sample int, frame long")
    assert sorted(r["frame"] for r in motifs.motif_frames(centres, 4).collect()) == [48, 49, 50, 51]
    assert sorted(r["frame"] for r in motifs.motif_frames(centres, 4, centred=False).collect()) == [50, 51, 52, 53]


def test_later_labels_win():
    assert motifs.label_codes([(1, "a"), (2, "b"), (3, "a"), (1, "c"), (3, "b")]) == {1: 2, 2: 1, 3: 1}


def test_ridge_integrates_to_one(spark):
    rows = [("a", float(k % 7)) for k in range(50)] + [("b", 1.0), ("c", 2.0), ("c", 2.0), ("d", None), ("d", float("nan"))]
    found = motifs.ridge(spark.createDataFrame(rows, "label string, v double"), "v", "label").toPandas().sort_values("at")
    assert set(found["label"]) == {"a"} and len(found) == 200
    assert abs(np.trapezoid(found["density"], found["at"]) - 1) < 0.01


def test_layouts_of_pose_files():
    pose = np.arange(24.0).reshape(4, 2, 3)
    assert np.array_equal(io.frames_of({"pose": pose, "id": np.array([0, 0, 1, 1])}, "h5")[1], [0, 0, 1, 1])
    assert np.array_equal(io.frames_of({"pose": pose}, "h5")[1], [0, 0, 0, 0])
    assert np.array_equal(io.frames_of({"pred": np.moveaxis(pose, 1, 2)}, "dannce")[0], pose)
    assert np.array_equal(io.frames_of({"predictions/b": pose[:, 1], "predictions/a": pose[:, 0]}, "predictions", ["a", "none", "b"])[0], pose)
    with pytest.raises(ValueError, match="no such kind"):
        io.frames_of({}, "other")


def test_stage_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert io.stage(spark, f"{tmp_path}/held", make).count() == 3
    assert made == [1]


def test_good_frames(spark):
    features = spark.range(6).select("id").withColumnRenamed("id", "frame")
    assert sorted(r["frame"] for r in io.good_frames(features, [3, 4, 7, 8, 9, 12], 2).collect()) == [2, 6, 8]


def test_density_of_sampled_frames_on_the_fitted_axes(spark):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(size=(400, 2)))], "frame long, x double, y double")
    shed = Watershed(sigma=1.0, bins=12)
    shed.segment(points)
    frames = spark.createDataFrame([(c, 50 * c + k) for c in (1, 3) for k in range(20)], "cluster int, frame long")
    got = {(r["cluster"], r["row"], r["col"]): r["density"] for r in motifs.motif_density(points, frames, shed).collect()}
    for c in (1, 3):
        fresh = Watershed(sigma=1.0, bins=12, range=shed.range)
        want = masked(fresh.fit(points.where(F.col("frame").between(50 * c, 50 * c + 19)), new=False), shed.labels)
        assert all(np.isclose(got.get((c, i, j), 0.0), want[i, j]) for i in range(12) for j in range(12))


def test_colours_by_category(spark):
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "frame int, kind string")
    assert {r["frame"]: r["color"] for r in motifs.coloured(rows, "kind").collect()} == {1: 2, 2: 0, 3: 1, 4: 2}


def test_skeleton_presets_of_a_module(tmp_path):
    (tmp_path / "s.py").write_text("import numpy as np\nJOINT_NAME_DICT = {'a': ['x', 'y', 'z']}\nCOLOR_DICT = {'a': [(1, 0, 0, 1)]}\nCONNECTIVITY_DICT = {'a': np.array([[0, 1.0]])}\nJOINT_ANGLES_DICT = {'a': [[0, 1, 2]]}\n")
    got = skeleton_from_module(str(tmp_path / "s.py"), "a")
    assert got == Skeleton(("x", "y", "z"), ((0, 1),), ((0, 1, 2),), ((1.0, 0.0, 0.0, 1.0),))
    assert type(got.links[0][1]) is int and type(got.colors[0][0]) is float
    with pytest.raises(ValueError, match="no skeleton"):
        skeleton_from_module(str(tmp_path / "s.py"), "b")
    with pytest.raises(ValueError, match="joint number"):
        Skeleton(("x", "y"), ((0, 0.5),))
