import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitlake.operators import augment, density, embed, geometry, grouped, neighbors, reduce, stats
from gaitlake.operators import timeseries as ts
from gaitlake.operators.skeleton import MOUSE18, Skeleton, skeleton_from_config
from gaitlake.sources import io


@pytest.fixture(scope="module")
def pose(spark):
    rng = np.random.default_rng(0)
    rows = [(i, t, 10 * i + t, [tuple(map(float, p)) for p in rng.normal(size=(6, 3))]) for i in range(2) for t in range(8 + i)]
    return spark.createDataFrame(rows, "id int, t long, frame long, kp array<struct<x:double,y:double,z:double>>").cache()


def points(df):
    return {(r["id"], r["t"]): np.array(r["kp"], float) for r in df.collect()}


def test_rotation_keeps_distances_and_points_along_x(pose):
    before, after = points(pose), points(geometry.rotate_to_x(geometry.center(pose), level=True))
    for key, p in before.items():
        q = after[key]
        assert np.allclose(np.linalg.norm(p[:, None] - p, axis=2), np.linalg.norm(q[:, None] - q, axis=2))
        assert np.allclose(q[4], 0)
        assert np.allclose(q[3, 1:], 0, atol=1e-12)
        assert q[3, 0] > 0


def test_align_heading_scales_to_the_unit_box(pose):
    p = np.concatenate(list(points(geometry.align_heading(pose, with_z=True)).values()))
    assert p.min() == pytest.approx(-1)
    assert p.max() == pytest.approx(1)


def test_angles_and_lengths(spark):
    df = spark.createDataFrame([(0, 0, [(1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 0.0)])], "id int, t long, kp array<struct<x:double,y:double,z:double>>")
    row = geometry.joint_angles(df, [(0, 1, 2), (0, 1, 3)]).first()["angles"]
    assert row[0] == pytest.approx(math.pi / 2)
    assert math.isnan(row[1])
    assert geometry.link_lengths(df, [(0, 2)]).first()["lengths"] == [3.0]
    assert geometry.link_lengths(df, [(0, 2)], "l2").first()["lengths"] == [math.sqrt(5)]
    with pytest.raises(ValueError, match="metric"):
        geometry.link_lengths(df, [(0, 2)], "l3")
    assert geometry.is_centred(df)


def trace(spark, values, ids=None):
    ids = ids or [0] * len(values)
    count: dict = {}
    rows = []
    for i, v in zip(ids, values, strict=True):
        rows.append((i, count.setdefault(i, 0), float(v)))
        count[i] += 1
    return spark.createDataFrame(rows, "id int, t long, v double")


def values(df, name="v"):
    return [r[name] for r in df.orderBy("id", "t").collect()]


def test_frame_differences_clamp(spark):
    ramp = trace(spark, range(10))
    assert values(ramp.withColumn("v", ts.frame_diff(F.col("v"), 3))) == [3, 4, 5, 6, 6, 6, 6, 5, 4, 3]
    assert values(trace(spark, [5]).withColumn("v", ts.frame_diff(F.col("v"), 3))) == [0]


def test_sessions_do_not_leak(spark):
    both = trace(spark, [0, 100, 1, 101, 2, 102], [0, 1, 0, 1, 0, 1])
    assert values(both.withColumn("v", ts.frame_diff(F.col("v"), 1, False))) == [0, 1, 1, 0, 1, 1]


@pytest.mark.parametrize("n", [1, 2, 5, 12])
@pytest.mark.parametrize("half", [1, 3])
def test_padded_deviation_equals_numpy(spark, n, half):
    x = np.random.default_rng(n).normal(size=n)
    got = values(trace(spark, x).withColumn("v", ts.padded_std(F.col("v"), half)))
    padded = np.pad(x, half, mode="edge")
    assert np.allclose(got, [padded[k : k + 2 * half + 1].std() for k in range(n)], atol=1e-7)


@pytest.mark.parametrize("length", [5, 6])
def test_median_mirrors_and_takes_the_upper_middle(spark, length):
    x = np.random.default_rng(3).normal(size=11)
    half = length // 2
    padded = np.pad(x, half, mode="symmetric")
    assert np.allclose(values(ts.median_filter(trace(spark, x), "v", length)), [np.sort(padded[k : k + length])[half] for k in range(11)])
    assert values(ts.median_filter(trace(spark, [7] * 6), "v", length)) == [7] * 6


def test_trimming(spark):
    both = trace(spark, range(20), [0] * 12 + [1] * 8)
    assert ts.trimmed(both, 3).count() == 20 - 2 * 2 * 3
    assert ts.trimmed(both, 0).count() == 20


def test_floor_becomes_level(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in range(30):
        x, y = rng.uniform(-5, 5, 2).tolist()
        rows.append((0, t, [(x, y, 0.1 * x - 0.2 * y + 8), (x, y, 0.1 * x - 0.2 * y + 3 + 1e-4 * float(rng.normal()))]))
    df = spark.createDataFrame(rows, "id int, t long, kp array<struct<x:double,y:double,z:double>>")
    out = ts.align_floor(df, foot=1, head=0).collect()
    assert max(abs(r["kp"][1]["z"]) for r in out) < 1e-3
    assert all(r["upright"] for r in out)


def test_repair_reproduces_a_cubic(spark):
    rows = [(0, t, [(float(t**3), float(t), 1000.0 if t in (4, 5, 9) else 0.0)]) for t in range(14)]
    df = spark.createDataFrame(rows, "id int, t long, kp array<struct<x:double,y:double,z:double>>")
    fixed = points(grouped.repaired(df, height=500.0))
    assert all(np.allclose(fixed[0, t], [[t**3, t, 0]]) for t in range(14))


def test_velocity_labels_and_shape(pose):
    out, labels = ts.velocities(pose, [0, 4], ["a", "b", "c", "d", "e", "f"], [1, 2])
    assert labels[:5] == ["abs_vel_norm_a_3", "abs_vel_x_a_3", "abs_vel_y_a_3", "abs_vel_z_a_3", "abs_vel_norm_e_3"]
    assert {len(r["features"]) for r in out.collect()} == {len(labels)}


def test_augmentation(pose):
    twice = augment.mirror(pose, [(0, 1)])
    again = augment.mirror(twice.where("label = 'Mirrored'").drop("old_id", "label").withColumn("id", F.col("id") - 2), [(0, 1)]).where("label = 'Mirrored'")
    first = points(pose)
    assert all(np.allclose(v, first[k[0] - 2, k[1]]) for k, v in points(again).items())
    level0 = augment.pitch(pose, 3).where("pitch = 0")
    assert all(np.allclose(v, first[k]) for k, v in points(level0).items())
    noisy = augment.noise(pose, [0, 1.0])
    assert all(np.allclose(v, first[k]) for k, v in points(noisy.where("noise = 0")).items())
    with pytest.raises(ValueError, match="level"):
        augment.noise(pose, [1.0])
    assert grouped.speed_augmented(pose, [1.0, 2.0]).groupBy("id").count().orderBy("id").collect()[0]["count"] == 8
    gone = augment.joint_ablation(pose, {"a": [0], "b": [1]}, ["a b"])
    assert gone.where("label = 'a b'").select(F.col("kp")[0]).distinct().count() == 1


def test_shares(spark):
    labels = spark.createDataFrame([("a", 0), ("a", 2), ("b", 9)], "cat string, cluster int")
    rows = reduce.cluster_shares_by(labels, "cat", clusters=3).orderBy("cat", "cluster").collect()
    assert [r["freq"] for r in rows[:3]] == [0.5, 0, 0.5]
    assert all(math.isnan(r["freq"]) for r in rows[3:])
    assert [r["freq"] for r in reduce.cluster_shares_by(labels, "cat", clusters=3, empty=0.0).orderBy("cat", "cluster").collect()[3:]] == [0, 0, 0]
    assert sum(r["freq"] for r in reduce.cluster_shares(labels, clusters=3).collect()) == pytest.approx(1)


def test_pca_keeps_the_variance(spark):
    x = np.random.default_rng(0).normal(size=(60, 4)) @ np.diag([3.0, 2, 1, 0.5])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>")
    model = reduce.fit_pca(df, range(4), 4)
    assert np.allclose(model.variances, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    out, names = reduce.pca(df, [f"ang_{k}" for k in range(4)], ["ang"], 2)
    assert names == ["ang_pc0", "ang_pc1"]
    scores = np.array([r["scores"] for r in out.orderBy("frame").collect()])
    assert np.allclose(scores.var(0), model.variances[:2])
    with pytest.raises(ValueError, match="category"):
        reduce.pca(df, ["x"] * 4, ["vel"])


def test_knn_excludes_self_among_duplicates(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [3.0])], "frame long, features array<double>")
    rows = neighbors.knn(df, df, 1).orderBy("src").collect()
    assert [(r["src"], r["dst"], r["d2"]) for r in rows] == [(0, 1, 0.0), (1, 0, 0.0), (2, 0, 9.0)]
    assert neighbors.geodesic(neighbors.knn_graph(df, 1), 2, 1) == [(2, 9.0), (0, 0.0), (1, 0.0)]
    assert neighbors.geodesic(spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, w double"), 0, 7) == []


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 2.0, 0.5)], "frame long, x double, y double")
    d = density.Density(bins=4, range=((0.0, 1.0), (0.0, 1.0)))
    assert {tuple(r) for r in d.histogram(df, new=False).collect()} == {(3, 0, 1), (0, 3, 1)}
    rows = {r["frame"]: (r["row"], r["col"]) for r in d.mapped(df).collect()}
    assert rows[1] == (0, 3)
    old = {r["frame"]: (r["row"], r["col"]) for r in d.mapped(df, shifted=True).collect()}
    assert old[0] == (2, 0)


def test_watershed_predicts_two_clusters(spark):
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(0, 0.3, (100, 2)), rng.normal(5, 0.3, (100, 2))])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "frame long, x double, y double")
    shed = density.Watershed(sigma=3, bins=60)
    got = {r["frame"]: r["cluster"] for r in shed.fit_predict(df).collect()}
    assert not {got[k] for k in range(100)} & {got[k] for k in range(100, 200)} - {0}


def test_divergence_of_equal_categories_is_zero(spark):
    rows = [(c, t, float(t % 7), float(t % 5)) for c in ("a", "b") for t in range(40)]
    df = spark.createDataFrame(rows, "cat string, t long, x double, y double")
    assert [tuple(r) for r in stats.segment_divergence(df, "cat", "a", 4, 5, (0, 0), (7, 5)).collect()] == [("b", 0.0)]


def test_embedding_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(30, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "frame long, features array<double>")
    model = embed.Embedding(perplexity=5).fit(df)
    model.save(str(tmp_path / "m"))
    again = embed.Embedding.load(spark, str(tmp_path / "m"))
    assert again.perplexity == 5
    assert again.plane().orderBy("frame").collect() == model.plane().orderBy("frame").collect()
    assert model.predict(df).count() == 30
    with pytest.raises(ValueError, match="method"):
        model.predict(df, "other")


def test_skeleton_checks_its_indices():
    with pytest.raises(ValueError, match="beyond"):
        Skeleton(("a",), ((0, 1),))
    assert MOUSE18.index["SpineM"] == 4
    s = skeleton_from_config({"LABELS": ["a", "b"], "SEGMENTS": [[0, 1]], "COLORS": [[0, 0, 0, 1]], "KEYPT_COLORS": [[0, 0, 0, 1]] * 2})
    assert s.angles is None


def test_sources(spark, pose, tmp_path):
    csv = tmp_path / "meta.csv"
    csv.write_text("Sex,Age\nF,3\nM,4\n")
    meta = io.read_meta(spark, str(csv))
    assert [tuple(r) for r in meta.select("id", "Sex", "Age").orderBy("id").collect()] == [(0, "F", 3), (1, "M", 4)]
    assert io.meta_by_frame(pose, meta).where("Sex is null").count() == 0
    with pytest.raises(ValueError, match="no metadata"):
        io.meta_by_frame(pose, meta.where("id = 0"))
    io.write_pose(pose, str(tmp_path / "pose"))
    assert points(io.read_pose(spark, str(tmp_path / "pose"))).keys() == points(pose).keys()
    io.write_features(pose.select("frame"), ["a", "b"], str(tmp_path / "f"))
    assert io.read_features(spark, str(tmp_path / "f"))[1] == ["a", "b"]
    assert {r[0] for r in io.shifted_ids(pose.withColumn("id", F.col("id") + 5)).select("id").distinct().collect()} == {0, 1}
