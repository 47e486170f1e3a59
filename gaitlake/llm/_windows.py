"""Super-windows: runs of fixed-length byte windows that share their minimal k-gram."""

from __future__ import annotations

import numpy as np

from gaitlake.llm import _text

#: Bits of a place within a block; longer blocks are cut up, which cuts runs but no window.
PLACE_BITS = 24


def super_windows(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cuts all ``length``-byte windows of each document into runs with one anchor.

    A window's anchor is its ``anchor``-byte gram with the smallest hash, the
    leftmost of equal ones, so equal windows have equal anchors at equal
    places. Returns for each run its document, first window's start, number of
    windows, anchor's start (all in bytes of the block) and anchor's hash.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - anchor + 1
    if n >= 1 << PLACE_BITS:
        step = 1 << (PLACE_BITS - 1)
        parts = []
        for at in range(0, len(data) - length + 1, step):
            to = min(len(data), at + step + length - 1)
            document, start, count, place, own = super_windows(data[at:to], np.clip(offsets - at, 0, to - at), length, anchor)
            parts.append((document, start + at, count, place + at, own))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    prefix = _text.prefix_hash(data)
    grams = np.arange(n)
    _, inverse = _text.powers(len(prefix))
    hashes = _text.mix((prefix[anchor:] - prefix[:n]) * inverse[:n])
    # The hash's upper bits decide, then the place; how many bits must not depend on the block.
    bits = PLACE_BITS
    low = (hashes >> np.uint64(bits) << np.uint64(bits)) | grams.astype(np.uint64)
    span, width = length - anchor + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
    starts = np.arange(len(place))
    document = np.searchsorted(offsets, starts, "right") - 1
    valid = starts + length <= offsets[document + 1]
    starts, place, document = starts[valid], place[valid], document[valid]
    if not len(starts):
        return none, none, none, none, np.zeros(0, np.uint64)
    head = np.ones(len(starts), bool)
    head[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(starts)))
    return document[at], starts[at], count, place[at], hashes[place[at]]
