"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items, one table for each
window length. A block is two successive words. The shift table tells for a
block how far the next possible window end lies, so most words are never
looked at; where it is zero, the window's last block picks a bucket of test
strings, a hash of the whole window its place in the bucket, and direct
comparison of the words' bytes confirms the occurrence. So a frequent last
block costs no more than a rare one, and the work is linear in the text and its
occurrences. Cursors over many pieces of text advance in step, as NumPy vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _text

WINDOW = 10
TABLE_BITS = 20
#: Words that one cursor walks over.
LANE = 64
#: Most bytes of benchmark text that one search holds; a larger benchmark is searched in several.
CHUNK_BYTES = 4 << 20


def _blocks(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block that ends at each word (``width`` 1 or 2); the first of two has none of its own."""
    if width == 1:
        return hashes
    out = hashes.copy()
    out[1:] = _text.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    return out


@dataclass(frozen=True)
class Table:
    """Wu-Manber tables of all windows of one length."""

    length: int
    width: int
    shift: np.ndarray
    #: Hashes of each pattern's last block and of all of it, ascending, and the patterns in that order.
    suffix: np.ndarray
    whole: np.ndarray
    patterns: list[tuple[bytes, ...]]
    #: Items of each pattern.
    owners: list[tuple[str, ...]]

    @classmethod
    def build(cls, windows: dict[tuple[bytes, ...], set[str]]) -> Table:
        patterns = sorted(windows)
        length = len(patterns[0])
        width = min(2, length)
        flat = b" ".join(w for p in patterns for w in p)
        data = np.frombuffer(flat, np.uint8)
        hashes, _, _, _ = _text.word_hashes(data, np.array([0, len(data)]), _text.ALNUM)
        blocks = np.stack([_blocks(row, width) for row in hashes.reshape(len(patterns), length)])
        shift = np.full(1 << TABLE_BITS, length - width + 1, np.uint8)
        for j in range(width - 1, length):
            np.minimum.at(shift, (blocks[:, j] >> np.uint64(64 - TABLE_BITS)).astype(np.int64), np.uint8(length - 1 - j))
        whole = _whole(hashes.reshape(len(patterns), length), np.full(len(patterns), length - 1), length, np.arange(len(patterns)))
        order = np.lexsort((whole, blocks[:, -1]))
        return cls(length, width, shift, blocks[order, -1], whole[order], [patterns[i] for i in order], [tuple(sorted(windows[patterns[i]])) for i in order])

    def search(self, hashes: np.ndarray, first: np.ndarray, word: Callable[[int], bytes]) -> list[tuple[int, int]]:
        """(index of the window's last word, pattern) of every occurrence; ``first`` has each document's first word."""
        if not len(hashes):
            return []
        blocks = _blocks(hashes, self.width)
        cell = (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        low, high = first[:-1] + self.length - 1, first[1:]
        low, high = low[low < high], high[low < high]
        lanes = -(-(high - low) // LANE)
        begin = np.repeat(low, lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(begin + LANE, np.repeat(high, lanes))
        ends = []
        while len(begin):
            jump = self.shift[cell[begin]]
            ends.append(begin[jump == 0])
            begin = begin + np.maximum(jump, 1)
            keep = begin < stop
            begin, stop = begin[keep], stop[keep]
        at = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        left, right = np.searchsorted(self.suffix, blocks[at], "left"), np.searchsorted(self.suffix, blocks[at], "right")
        at, left, right = (x[left < right] for x in (at, left, right))
        whole = _whole(hashes, at, self.length)
        low, high = left.copy(), right.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = self.whole[np.minimum(middle, len(self.whole) - 1)] < whole
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        found = []
        for e, p, b, h in zip(at.tolist(), low.tolist(), right.tolist(), whole.tolist(), strict=True):
            if p < b and self.whole[p] == h:
                own = tuple(word(k) for k in range(e - self.length + 1, e + 1))
                while p < b and self.whole[p] == h:
                    if self.patterns[p] == own:
                        found.append((e, p))
                    p += 1
        return found


def _whole(hashes: np.ndarray, last: np.ndarray, length: int, row: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``length`` words up to each ``last`` (in its row, if there are rows)."""
    out = np.zeros(len(last), np.uint64)
    for k in range(length):
        at = last - length + 1 + k
        out = out * np.uint64(_text.MULTIPLIER) + (hashes[at] if row is None else hashes[row, at])
    return _text.mix(out)


def tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Table]:
    """Tables over (id, text) items: every ``window`` successive words, or all of an item with fewer; one without words has none."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for name, text in items:
        data = _text.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
        start, end, _ = _text.words(data, np.array([0, len(data)]), _text.ALNUM)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if words:
            n = min(window, len(words))
            for k in range(len(words) - n + 1):
                by_length.setdefault(n, {}).setdefault(tuple(words[k : k + n]), set()).add(name)
    return [Table.build(w) for _, w in sorted(by_length.items())]


def _scan(shared: object, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds n_words, hits (pairs of first and last word) and items to what a search before has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _text.blocks(batches, "_text"):
            low = _text.LOWER[data]
            raw = low.tobytes()
            hashes, start, end, first = _text.word_hashes(low, offsets, _text.ALNUM)
            hits: list[list[int]] = batch.column("_hits").to_pylist()
            items = [set(x) for x in batch.column("_items").to_pylist()]
            for table in shared.value:
                found = table.search(hashes, first, lambda k: raw[start[k] : end[k]])
                last, pattern = np.array(found, np.int64).reshape(-1, 2).T
                row = np.searchsorted(first, last, "right") - 1
                for d, a, b in _runs(row, last - table.length + 1, last):
                    hits[d] += (a - int(first[d]), b - int(first[d]))
                for d, p in np.unique(np.stack([row, pattern]), axis=1).T.tolist():
                    items[d].update(table.owners[p])
            items = [sorted(x) for x in items]
            columns = {c: batch.column(c) for c in keep} | {"_n": pa.array(np.diff(first)), "_hits": pa.array(hits, pa.list_(pa.int64())), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of the spans' unions, from spans of one length in any order."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1)
    at = np.flatnonzero(fresh)
    return zip(row[at].tolist(), first[at].tolist(), last[np.append(at[1:], len(row)) - 1].tolist() if len(at) else [], strict=True)


def covered(hits: list[int]) -> int:
    """Number of words within the spans, given as successive pairs of first and last word."""
    total, upto = 0, -1
    for a, b in sorted(zip(hits[::2], hits[1::2], strict=True)):
        total += max(0, b - max(a - 1, upto))
        upto = max(upto, b)
    return total


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [covered(h) for h in batch.column("_hits").to_pylist()]
        items = batch.column("_items").to_pylist()
        names = [c for c in batch.schema.names if c not in ("_hits", "_items", "_n")]
        digest = [sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
        new = {"n_words": batch.column("_n"), "n_hit": pa.array(n, pa.int64()), "n_items": pa.array([len(i) for i in items], pa.int64()), "items_sha256": pa.array(digest), "contaminated": pa.array([x > 0 for x in n], pa.bool_())}
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new.values()], names=[*names, *new])


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(*keep, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Words are runs of a-z (after lower-casing A-Z), digits and all beyond
    ASCII. ``n_hit`` words lie within occurrences of item windows, ``n_items``
    items have one. Null and empty texts have no words; a very long text is
    searched like any other; items without words match nothing; repeated items and rows do no harm; a null item id counts as
    empty text; other columns, whatever their names, are ignored. An empty
    table of items leaves every row clean. No shuffle: the benchmark is read
    in chunks of at most ``chunk_bytes`` bytes (or one item), and each is sent
    to the executors once.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    chunks = max(1, -(-2 * total // chunk_bytes)) if total > chunk_bytes else 1
    out = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("_text"), F.array().cast("array<long>").alias("_hits"), F.array().cast("array<string>").alias("_items"))
    for k in range(chunks):
        some = items if chunks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(chunks)) == k)
        shared = spark.sparkContext.broadcast(tables([tuple(r) for r in some.collect()], window))
        kept = [c for c in out.columns if c not in ("_hits", "_items", "_n") and (c != "_text" or k < chunks - 1)]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in kept)
        out = out.mapInArrow(_scan(shared, kept), f"{schema}{', ' if schema else ''}_n long, _hits array<long>, _items array<string>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name.startswith("_k"))
    out = out.mapInArrow(_summary, f"{schema}{', ' if schema else ''}n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})
