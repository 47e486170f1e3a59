"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round j inserts, for every string at once, the symbol before its suffix of
length j - 1, which puts the suffix of length j in its place. No suffix array
of the collection is ever sorted: the transform after a round is the one
before it with the new symbols inserted, the places follow from counting
symbols, and each new common prefix is one more than the smallest between two
successive occurrences of a symbol. The two columns are read and written in
sequence once a round; they stay in memory, or lie in files of a folder given.
"""

from __future__ import annotations

import os

import numpy as np


class _Column:
    """An array that is replaced once a round: in memory, or in a file written and read in sequence.

    The file stays open and is overwritten in place, as columns only grow;
    emptying it first makes some file systems wait for the disk every round.
    """

    def __init__(self, kind: type, folder: str | None, name: str) -> None:
        self.kind, self.held = kind, np.zeros(0, kind)
        self.file = open(os.path.join(folder, name), "w+b", buffering=0) if folder else None  # noqa: SIM115
        self.size = 0

    def get(self) -> np.ndarray:
        if not self.file:
            return self.held
        self.file.seek(0)
        return np.fromfile(self.file, self.kind, self.size)

    def put(self, values: np.ndarray) -> None:
        values = values.astype(self.kind, copy=False)
        if self.file:
            self.file.seek(0)
            values.tofile(self.file)
            self.size = len(values)
        else:
            self.held = values

    def last(self) -> np.ndarray:
        """The array, after which the file is closed."""
        values = self.get()
        if self.file:
            self.file.close()
        return values


def _minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest value of each non-empty range [low, high)."""
    if not len(low):
        return np.zeros(0, values.dtype)
    n = high - low
    first = np.cumsum(n) - n
    return np.minimum.reduceat(values[np.arange(first[-1] + n[-1]) + np.repeat(low - first, n)], first)


def columnwise(strings: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(transform, common prefixes) of the collection, each string with an end mark of its own.

    The transform has 0 where a string begins; strings must be free of byte
    0xFF, which UTF-8 never has and which stands for byte 0 here. Entry k of
    the common prefixes is the length that the k-th smallest suffix shares with
    the one before it.
    """
    m = len(strings)
    length = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8).copy()
    text[text == 0] = 0xFF
    end = np.cumsum(length)
    transform, common = _Column(np.uint8, folder, "transform"), _Column(np.uint16, folder, "common")
    begin = np.zeros(m, np.uint8)
    begin[length > 0] = text[end[length > 0] - 1]
    transform.put(begin)
    common.put(np.zeros(m, np.uint16))
    # Strings whose suffix of length j - 1 is in place and not yet the whole, in order of its place.
    active = np.flatnonzero(length > 0)
    place = active.copy()
    for j in range(1, int(length.max(initial=0)) + 1):
        bwt, lcp = transform.get(), common.get()
        order = np.argsort(bwt, kind="stable")
        order = order[np.searchsorted(bwt[order], 1) :] if (bwt == 0).any() else order
        fresh = np.zeros(len(bwt), bool)
        fresh[place] = True
        fresh = fresh[order]
        # All suffixes there are now: the empty ones, then by first symbol and place of the rest.
        symbol = bwt[order]
        at = np.flatnonzero(fresh)
        by_symbol = np.argsort(bwt[place], kind="stable")
        active = active[by_symbol]
        before = end[active] - j - 1
        more = length[active] > j
        new = np.zeros(len(active), np.uint8)
        new[more] = text[before[more]]
        column = np.zeros(m + len(order), np.uint8)
        shared = np.zeros(m + len(order), np.uint16)
        column[:m] = bwt[:m]
        stays = ~fresh
        column[m:][stays], shared[m:][stays] = bwt[m:], lcp[m:]
        column[m + at] = new
        # Common prefixes change for new suffixes and for those right after one, where the first symbol is the same.
        touched = fresh[1:] | fresh[:-1]
        same = np.flatnonzero(touched & (symbol[1:] == symbol[:-1])) + 1
        shared[m + at] = 0
        shared[m + same] = _minima(lcp, order[same - 1] + 1, order[same] + 1) + 1
        transform.put(column)
        common.put(shared)
        active, place = active[more], m + at[more]
    return transform.last(), common.last()


def repeated(strings: list[bytes], window: int, folder: str | None = None) -> list[np.ndarray]:
    """For each string, whether the ``window`` bytes from each place also start at another place of the collection.

    A suffix shares its first ``window`` bytes with another one exactly if it
    does with a neighbour in sorted order. Places come from a walk through the
    transform, from the end of all strings at once.
    """
    length = np.array([len(s) for s in strings], np.int64)
    out = [np.zeros(max(0, n - window + 1), bool) for n in length.tolist()]
    if not len(strings) or length.max() < window:
        return out
    bwt, lcp = columnwise(strings, folder)
    m = len(strings)
    found = lcp >= window
    found[:-1] |= lcp[1:] >= window
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt)) + m - np.count_nonzero(bwt == 0)
    flat = np.zeros(int(np.maximum(length - window + 1, 0).sum()), bool)
    first = np.cumsum(np.maximum(length - window + 1, 0)) - np.maximum(length - window + 1, 0)
    string, place = np.arange(m), np.arange(m)
    for j in range(1, int(length.max()) + 1):
        keep = length[string] >= j
        string, place = string[keep], rank[place[keep]]
        if j >= window:
            flat[first[string] + length[string] - j] = found[place]
    return np.split(flat, first[1:]) if m > 1 else [flat]
