"""MATLAB files that are made here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from gaitlake.sources import io
from gaitlake.sources.mat5 import variables

KINDS = {"f8": (9, 6), "f4": (7, 7), "i1": (1, 8), "u1": (2, 9), "i2": (3, 10), "u2": (4, 11), "i4": (5, 12), "u4": (6, 13), "i8": (12, 14), "u8": (13, 15)}


def element(kind, data, o="<", small=True):
    if small and 0 < len(data) <= 4:
        return struct.pack(f"{o}I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(f"{o}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, value, o="<", stored=None):
    """A matrix element; ``stored`` is a smaller type that the numbers are written in, as MATLAB does."""
    head = lambda form, shape: element(6, struct.pack(f"{o}II", form, 0), o) + element(5, np.array(shape, f"{o}i4").tobytes(), o) + element(1, name.encode(), o)
    if isinstance(value, dict):
        width = max(map(len, value)) + 1
        body = head(2, (1, 1)) + element(5, struct.pack(f"{o}i", width), o) + element(1, b"".join(k.encode().ljust(width, b"\0") for k in value), o)
        body += b"".join(array("", v, o) for v in value.values())
    elif isinstance(value, list):
        body = head(1, (1, len(value))) + b"".join(array("", v, o) for v in value)
    elif isinstance(value, str):
        body = head(4, (1, len(value))) + element(4, np.array([ord(c) for c in value], f"{o}u2").tobytes(), o)
    else:
        kind = value.dtype.str[1:]
        body = head(KINDS[kind][1], value.shape) + element(KINDS[stored or kind][0], value.astype(f"{o}{stored or kind}").tobytes("F"), o)
    return element(14, body, o, small=False)


def file(o="<", packed=False, **held):
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(f"{o}H", 0x0100) + (b"IM" if o == "<" else b"MI")
    parts = [array(k, v, o) for k, v in held.items()]
    if packed:
        parts = [struct.pack(f"{o}II", 15, len(z)) + z for z in map(zlib.compress, parts)]
    return head + b"".join(parts)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packed", [False, True])
def test_variables_come_back(order, packed):
    rng = np.random.default_rng(0)
    held = {f"v{k}": (rng.random((3, 2, 4)) * 100).astype(k) for k in KINDS}
    held |= {"one": np.array([[7.0]]), "none": np.zeros((0, 3)), "text": "Säule", "s": {"a": held["vf8"], "long_name": "x", "in": {"b": held["vi2"]}}, "c": [held["vu1"], "cell", [np.array([[1.5]])]]}
    got = variables(file(order, packed, **held))
    assert got.keys() == held.keys()

    def same(a, b):
        if isinstance(b, dict):
            return a.keys() == b.keys() and all(same(a[k], b[k]) for k in b)
        if isinstance(b, list):
            return a.shape == (1, len(b)) and all(same(x, y) for x, y in zip(a[0], b, strict=True))
        return a == b if isinstance(b, str) else np.array_equal(a, b) and a.dtype.kind == b.dtype.kind

    assert all(same(got[k], held[k]) for k in held)


def test_numbers_stored_in_a_smaller_type():
    data = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + array("x", np.array([[1.0, 2], [3, 255]]), stored="u1")
    assert variables(data)["x"].dtype == float and variables(data)["x"].tolist() == [[1, 2], [3, 255]]


@pytest.mark.parametrize("content", [b"", b"x" * 200, file(a=np.ones((5, 5)))[:-16]])
def test_what_is_no_file_is_an_error(content):
    with pytest.raises(ValueError, match="MATLAB"):
        variables(content)


def test_pose_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    pose = rng.random((5000, 3, 4))
    (tmp_path / "d.mat").write_bytes(file(packed=True, pred=pose, other="x"))
    got = io.pose_files(spark, str(tmp_path / "d.mat"), "dannce").orderBy("frame").collect()
    assert np.array_equal([[tuple(k) for k in r["kp"]] for r in got], np.moveaxis(pose, 1, 2)) and [r["t"] for r in got] == list(range(5000))
    joints = {"Snout": rng.random((9, 3)).astype("f4"), "Tail": rng.random((9, 3)).astype("f4")}
    (tmp_path / "p.mat").write_bytes(file(">", predictions=joints))
    got = io.pose_files(spark, str(tmp_path / "p.mat"), "predictions", ["Tail", "Missing", "Snout"]).orderBy("frame").collect()
    assert np.array_equal([[tuple(k) for k in r["kp"]] for r in got], np.stack([joints["Tail"], joints["Snout"]], 1).astype(float))


def test_features_of_an_analysis(spark, tmp_path):
    rng = np.random.default_rng(2)
    features, good = rng.random((40, 6)), np.sort(rng.choice(200, 40, replace=False)) + 1
    ids = np.repeat([3, 4, 5, 6], 50).astype("u2")
    (tmp_path / "a.mat").write_bytes(file(packed=True, jt_features=features, frames_with_good_tracking=[np.zeros((0, 0)), good.astype("f8")[None]], tsnegranularity=np.array([[25.0]])))
    (tmp_path / "p.mat").write_bytes(file(exp=ids[:, None]))
    found, step = io.features_mat(spark, str(tmp_path / "a.mat"), str(tmp_path / "p.mat"), "exp", downsample=2)
    rows = found.orderBy("frame").collect()
    assert step == 50 and [r["frame"] for r in rows] == (good[::2] - 1).tolist()
    assert np.array_equal([r["features"] for r in rows], features[::2]) and [r["id"] for r in rows] == (ids[good[::2] - 1] - 3).tolist()
