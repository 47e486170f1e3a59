"""Variables of MATLAB files of version 5 (the format before HDF5): numbers, text, structs and cells, compressed or not."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np

# Fixed values of the format: numpy types of its data types, and the classes of its arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, bytes) of successive data elements; up to four bytes may lie within the tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            if at + 8 + size > len(data):
                raise ValueError("the MATLAB file is cut off")
            yield kind, data[at + 8 : at + 8 + size]
            # Elements end at multiples of eight bytes, but for compressed ones.
            at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def _numbers(kind: int, data: memoryview, order: str) -> np.ndarray:
    if kind not in NUMBERS:
        raise ValueError(f"unknown data type {kind} in a MATLAB file")
    return np.frombuffer(data, np.dtype(NUMBERS[kind]).newbyteorder(order))


def _array(data: memoryview, order: str) -> tuple[str, Any]:
    """(name, value) of a matrix element: an array, text, a dict of fields (for several elements, lists of values), or an object array of cells. Complex arrays give their real part."""
    parts = _elements(data, order)
    flags = _numbers(*next(parts), order)
    shape = tuple(int(n) for n in _numbers(*next(parts), order))
    name = bytes(next(parts)[1]).decode("ascii")
    form, count = int(flags[0]) & 0xFF, int(np.prod(shape))
    inner = lambda: next(parts, (MATRIX, memoryview(b"")))[1]
    nested = lambda held: _array(held, order)[1] if len(held) else np.zeros((0, 0))
    if form == CELL:
        cells = np.empty(count, object)
        for k in range(count):
            cells[k] = nested(inner())
        return name, cells.reshape(shape, order="F")
    if form == STRUCT:
        width = int(_numbers(*next(parts), order)[0])
        text = bytes(next(parts)[1])
        fields = [text[k : k + width].split(b"\0")[0].decode("ascii") for k in range(0, len(text), width)]
        rows = [[nested(inner()) for _ in fields] for _ in range(count)]
        return name, {f: rows[0][k] if count == 1 else [r[k] for r in rows] for k, f in enumerate(fields)}
    if form == SPARSE:
        raise ValueError(f"{name}: sparse matrices are not read")
    if form != CHAR and form not in CLASSES:
        raise ValueError(f"{name}: arrays of class {form} are not read")
    values = _numbers(*next(parts), order) if count else np.zeros(0)
    if form == CHAR:
        held = np.array([chr(int(c)) for c in values]).reshape(shape, order="F") if count else np.zeros((0, 0), str)
        return name, "\n".join("".join(line) for line in held)
    return name, values.astype(CLASSES[form]).reshape(shape, order="F")


def variables(content: bytes) -> dict[str, Any]:
    """Every variable of a file by name."""
    if len(content) < 128:
        raise ValueError("not a MATLAB file")
    mark = content[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB file of version 5")
    order, found = "<" if mark == b"IM" else ">", {}
    for kind, data in _elements(memoryview(content)[128:], order):
        held = [(kind, data)] if kind != COMPRESSED else _elements(memoryview(zlib.decompress(data)), order)
        for inner, part in held:
            if inner == MATRIX:
                name, value = _array(part, order)
                found[name] = value
    return found
