"""Tiles of long sessions against whole sessions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaitlake.operators import grouped, kernels, tiles
from gaitlake.operators import timeseries as ts

LENGTHS = {0: 230, 1: 1, 2: 2, 3: 37, 4: 64, 5: 3}


@pytest.fixture(scope="module")
def pose(spark):
    """Sessions of several lengths; times have gaps, two joints."""
    rng = np.random.default_rng(0)
    rows = []
    for k, n in LENGTHS.items():
        t = np.sort(rng.choice(3 * n + 1, n, replace=False))
        xyz = rng.normal(size=(n, 2, 3)).cumsum(0)
        rows += [(k, int(a), [tuple(map(float, p)) for p in v]) for a, v in zip(t, xyz, strict=True)]
    return spark.createDataFrame(rows, "id int, t long, kp array<struct<x:double,y:double,z:double>>").repartition(3)


def values(df, column):
    flat = lambda v: [a for p in v for a in p] if v and isinstance(v, list) and isinstance(v[0], tuple) else v
    return {(r["id"], r["t"]): np.array(flat(r[column]), float) for r in df.select("id", "t", column).collect()}


def same(a, b, column):
    a, b = values(a, column), values(b, column)
    assert a.keys() == b.keys()
    assert all(np.allclose(a[k], b[k], atol=1e-9, rtol=0, equal_nan=True) for k in a)


def test_positions_are_counted_in_stretches(pose, monkeypatch):
    monkeypatch.setattr(tiles, "STRETCH", 7)
    got = tiles.counted(pose, "n", F.col("t") % 2 == 0).select("id", "t", "n").orderBy("id", "t").collect()
    seen = {}
    for r in got:
        seen[r["id"]] = seen.get(r["id"], 0) + (r["t"] % 2 == 0)
        assert r["n"] == seen[r["id"]]


def test_velocities_on_tiles_equal_whole_sessions(pose):
    run = lambda rows: ts.velocities(pose, [0, 1], ["a", "b"], (1, 5), rows=rows)[0]
    same(run(16), run(10**6), "features")
    angles = pose.select("id", "t", F.array(F.col("kp")[0]["x"]).alias("angles"))
    run = lambda rows: ts.angular_velocities(angles, ["ang"], (2,), rows=rows)[0]
    same(run(10), run(10**6), "features")


def test_velocities_equal_window_functions(pose):
    """The same from DataFrame windows, column by column."""
    got, labels = ts.velocities(pose, [1], ["a", "b"], (2,), rate=10.0, rows=16)
    x = F.col("kp")[1]["x"]
    frames = pose.select("id", "t", x.alias("x")).withColumn("s", ts.frame_diff(F.col("x"), 1, False) * 10.0)
    want = frames.select("id", "t", F.array(ts.frame_diff(F.col("x"), 2) * 2.0, ts.padded_std(F.col("s"), 2)).alias("features"))
    places = [labels.index("abs_vel_x_b_5"), labels.index("abs_vel_std_x_b_5")]
    same(got.withColumn("features", F.array(*(F.col("features")[p] for p in places))), want, "features")


def test_means_on_tiles_equal_whole_sessions(pose):
    run = lambda p: p.withColumn("m", ts.zero_padded_mean(F.col("kp")[0]["x"], 6)).select("id", "t", F.array("m").alias("m"))
    same(tiles.over(pose, run, 6, rows=16), run(pose), "m")


@pytest.mark.parametrize("rule", [{"speed": 2.0}, {"height": 1.0}, {"error": 0.8}])
def test_flags_on_tiles_equal_whole_sessions(pose, rule):
    run = lambda p: ts.outlier_flags(p, **rule)
    got, want = ({(r["id"], r["t"]): (r["value"], r["bad"]) for r in x.collect()} for x in (tiles.over(pose, run, 7, rows=9), run(pose)))
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in got)


def test_tiles_do_not_grow_with_a_session(spark):
    for n in (1000, 4000):
        frames = spark.range(n).select(F.lit(0).alias("id"), F.col("id").alias("t"))
        cut = tiles.tiled(frames, 10, 100, "t", F.lit(n)).groupBy("tile").count().agg(F.max("count"), F.count("*")).first()
        assert tuple(cut) == (120, n // 100)


@pytest.mark.parametrize("length", [5, 6, 150, 301])
def test_medians_of_any_length(spark, pose, length):
    frames = pose.select("id", "t", F.when(F.col("t") % 11 != 0, F.round(F.col("kp")[0]["x"], 1)).alias("v"), F.lit("kept").alias("other"))
    rows = frames.orderBy("id", "t").collect()
    got = {(r["id"], r["t"]): r["v"] for r in grouped.long_medians(frames, "v", length, rows=1).collect()}
    assert len(got) == len(rows)
    for k in LENGTHS:
        own = [r for r in rows if r["id"] == k]
        x = np.array([np.nan if r["v"] is None else r["v"] for r in own])
        n, half = len(x), length // 2
        for p, r in enumerate(own):
            near = [-1 - i if i < 0 else 2 * n - 1 - i if i >= n else i for i in range(p - half, p + length - half)]
            held = sorted(x[i] for i in near if 0 <= i < n and not np.isnan(x[i]))
            assert got[k, r["t"]] == (held[len(held) // 2] if held else None)
    if length > ts.SORTED_FRAMES:
        again = ts.median_filter(frames, "v", length)
        assert {(r["id"], r["t"]): r["v"] for r in again.collect()} == got and "other" in again.columns


def test_running_medians_take_two_heaps():
    x = np.random.default_rng(1).normal(size=3000)
    assert np.array_equal(kernels.running_median(x, 501)[250:-250], [np.median(x[i - 250 : i + 251]) for i in range(250, 2750)])


def test_wavelets_on_tiles_equal_whole_sessions(pose):
    frames = pose.select("id", "t", F.array(F.col("kp")[0]["x"], F.col("kp")[1]["y"]).alias("features"))
    freqs = [20.0, 30.0]
    small, names = grouped.wavelets(frames, ["a", "b"], freqs=freqs, rows=1)
    whole, _ = grouped.wavelets(frames, ["a", "b"], freqs=freqs, rows=10**6)
    same(small, whole, "features")
    assert names == ["wlet_a_20.0", "wlet_a_30.0", "wlet_b_20.0", "wlet_b_30.0"]
    # By convolution, column by column.
    rows = [r for r in frames.orderBy("id", "t").collect() if r["id"] == 0]
    x, got = np.array([r["features"] for r in rows]), values(small, "features")
    for c in range(2):
        for f, freq in enumerate(freqs):
            width = 5 * 90 / (2 * np.pi * freq)
            wave = np.conj(kernels.morlet(int(min(10 * width, len(x))), width)[::-1])
            full = np.convolve(x[:, c], wave)
            want = np.abs(full[(len(full) - len(x)) // 2 :][: len(x)])
            assert np.allclose([got[0, r["t"]][2 * c + f] for r in rows], want)


@pytest.mark.parametrize("rule", [{"height": 1.0}, {"speed": 3.0}])
def test_repairs_on_tiles_equal_one_spline(pose, rule):
    fixed = grouped.repaired(pose, rows=8, **rule)
    got, flags = values(fixed, "kp"), {(r["id"], r["t"]): r["repaired"] for r in fixed.collect()}
    rows = ts.outlier_flags(pose, **rule).orderBy("id", "t").collect()
    assert len(got) == len(rows) and sum(flags.values()) > 20
    for k in LENGTHS:
        own = [r for r in rows if r["id"] == k]
        t, v, bad = np.array([r["t"] for r in own]), np.array([np.array(r["kp"]).ravel() for r in own]), np.array([r["bad"] for r in own])
        if bad.any() and (~bad).sum() >= 2:
            v[bad] = kernels.cubic_spline(t[~bad], v[~bad], t[bad])
        else:
            bad[:] = False
        assert all(np.allclose(got[k, a], b, atol=1e-9, rtol=1e-9) and flags[k, a] == c for a, b, c in zip(t, v, bad, strict=True))


def test_speeds_on_tiles_equal_one_spline(pose):
    levels = [1.0, 0.5, 2.0, 3.7]
    made = grouped.speed_augmented(pose, levels, rows=8)
    got = values(made, "kp")
    want = {}
    rows = pose.orderBy("id", "t").collect()
    for k in LENGTHS:
        v = np.array([np.array(r["kp"]).ravel() for r in rows if r["id"] == k])
        for number, level in enumerate(levels):
            at = np.linspace(0, len(v) - 1, int(len(v) / level))
            for j, new in enumerate(kernels.cubic_spline(np.arange(len(v)), v, at) if len(at) else []):
                want[k * len(levels) + number, j] = new
    assert got.keys() == want.keys()
    assert all(np.allclose(got[key], want[key], atol=1e-9, rtol=1e-9) for key in got)


def test_groups_in_a_stream(spark):
    frames = spark.range(5000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("b"), F.col("id").alias("t"))

    def first(table: pa.Table) -> pa.Table:
        t = table["t"].to_numpy()
        assert (np.diff(t) > 0).all()
        return pa.table({"a": table["a"].slice(0, 1), "b": table["b"].slice(0, 1), "n": pa.array([len(t)])})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = tiles.grouped_arrow(frames, ("a", "b"), ("t",), first, "a long, b long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 21 and sum(r["n"] for r in got) == 5000
