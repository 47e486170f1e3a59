"""Exact substring dedup over the sorted suffixes of a collection.

Every window of ``length`` bytes has an anchor, its minimal gram, so that equal
windows meet under one anchor. Windows with one anchor that follow each other
form a run; a run whose anchor occurs once in the corpus repeats nothing and is
done. Equal runs are counted rather than moved, and runs that differ go, as
short strings, to collections of bounded size. There the Burrows-Wheeler
transform and the common prefixes are built column by column, and a window
whose suffix shares ``length`` bytes with a neighbour in sorted order is
repeated. An anchor with very many different runs is split: its windows are
dealt by where the anchor lies in them, into stretches that share more bytes
than the anchor, and those bytes tell groups apart anew, in narrower steps
while a group is too large. A stretch that several runs have goes on once, and
to a collection in two copies, whose verdict then holds for all of them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _text, _windows, _work
from gaitlake.llm._windows import super_windows
from gaitlake.llm.collection import repeated

LENGTH, ANCHOR = 200, 120
#: Bytes of runs in a collection, on average.
COLLECTION_BYTES = 1 << 20
#: An anchor with more different runs than this is split into stretches of windows, and so are groups of stretches.
MOST_RUNS = 1000

#: Bytes that UTF-8 never has: one opens an anchor's number, the others are its digits.
_OPEN, _DIGITS, _PLACES = 0xFE, bytes([0xC0, 0xC1, *range(0xF5, 0xFE)]), 5


def _key(text: Column) -> Column:
    return F.xxhash64("id", text)


def _runs(length: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(anchor hash, run hash, key, start, n) of every run of (key, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _text.blocks(batches):
            doc, start, n, _, hashes = super_windows(data, offsets, length, anchor)
            own = _text.span_hash(_text.prefix_hash(data), start, start + n + length - 1) if len(start) else hashes
            key = batch.column(0).to_numpy(zero_copy_only=False)[doc] if len(doc) else np.zeros(0, np.int64)
            columns = (hashes.view(np.int64), own.view(np.int64), key, start - offsets[doc] if len(doc) else start, n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "own", "key", "start", "n"])

    return run


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(h, own, split, bytes) of the runs wanted from each (runs, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _text.blocks(batches):
            rows: list[tuple[int, int, bool, bytes]] = []
            for runs, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                raw = data[a:b].tobytes()
                rows += [(r["h"], r["own"], r["split"], raw[r["start"] : r["start"] + r["n"] + length - 1]) for r in runs]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["h", "own", "split", "piece"])

    return run


def _places(pieces: list[bytes], length: int, anchor: int) -> Iterator[int]:
    """Where each piece has its anchor. Pieces are taken in buffers that ``super_windows`` does not cut."""
    offsets = np.cumsum([0, *map(len, pieces)])
    at = 0
    while at < len(pieces):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << _windows.PLACE_BITS), "left")) - 1)
        data = np.frombuffer(b"".join(pieces[at:to]), np.uint8)
        doc, _, _, place, _ = super_windows(data, offsets[at : to + 1] - offsets[at], length, anchor)
        if not np.array_equal(doc, np.arange(to - at)):
            raise ValueError("a piece is not one run of windows")
        yield from (place - offsets[at:to] + offsets[at]).tolist()
        at = to


def _widths(most: int) -> list[int]:
    """Most windows of a stretch, step by step, where a run has up to ``most``: powers of two, so that stretches lie within those before, and 1 at last."""
    found = [1 << max(0, most.bit_length() - 2)]
    while found[-1] > 1:
        found.append(max(1, found[-1] // 4))
    return found


def _stretches(length: int, anchor: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(near, part, one, two, at, weight, piece) of the stretches of every (one, two, weight, piece).

    A stretch has the windows whose anchor lies in one range of ``width``
    places; it begins ``at`` windows into its piece. ``near`` is of the bytes
    that all windows of that range have, so equal windows share it; ``part`` is
    of the stretch itself. No piece has a window twice, nor a stretch.
    """
    number = lambda raw: int.from_bytes(sha256(raw).digest()[:8], "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            pieces = batch.column(3).to_pylist()
            for one, two, weight, piece, place in zip(*(batch.column(i).to_pylist() for i in range(3)), pieces, _places(pieces, length, anchor), strict=True):
                n = len(piece) - length + 1
                for low in range((place - n + 1) // width * width, place + 1, width):
                    first = place - low - width + 1
                    a, b = max(0, first), min(n, place - low + 1)
                    part = piece[a : b + length - 1]
                    rows.append((number(b"%d " % low + piece[place - low : first + length]), number(part), one, two, a, weight, part))
            kinds = (*[pa.int64()] * 6, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["near", "part", "one", "two", "at", "weight", "piece"])

    return run


def _split(runs: DataFrame, length: int, anchor: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each step (links, stretches for collections) of (one, two, weight, piece) runs.

    ``links`` (near, part, one, two, at) has the pieces that a stretch is in: runs
    or stretches of the step before. ``stretches`` (near, part, times, piece) are
    those of groups of bounded size that have a rival or are in several runs
    (``times`` > 1); those of larger groups make the next step. One piece is
    never in stretches of two steps, as its windows' groups are larger or not.
    """
    for width in _widths(length - anchor + 1):
        found = _work.table(runs.mapInArrow(_stretches(length, anchor, width), "near long, part long, one long, two long, at long, weight long, piece binary"), "stretches")
        kinds = _work.table(found.groupBy("near", "part").agg(F.sum("weight").alias("times"), F.first("piece").alias("piece")), "stretch-kinds")
        kinds = kinds.join(_work.table(kinds.groupBy("near").agg(F.count("*").alias("rivals")), "rivals"), "near")
        large = (F.col("rivals") > MOST_RUNS) & F.lit(width > 1)
        yield found.drop("weight", "piece"), kinds.where(~large & ((F.col("rivals") > 1) | (F.col("times") > 1))).drop("rivals")
        runs = kinds.where(large).select(F.col("near").alias("one"), F.col("part").alias("two"), F.least("times", F.lit(2)).alias("weight"), "piece")
        if runs.isEmpty():
            return


def _numbered(k: int) -> bytes:
    out = []
    for _ in range(_PLACES):
        k, d = divmod(k, len(_DIGITS))
        out.append(_DIGITS[d])
    return bytes([_OPEN, *out])


def repeats(pieces: list[bytes], length: int, anchor: int, folder: str | None = None) -> list[np.ndarray]:
    """Which windows of each piece (a run, so with one anchor) start elsewhere among the pieces too.

    A window holds all of its anchor, so pieces are compared with the anchor
    replaced by its number, which leaves far fewer columns to build.
    """
    number: dict[bytes, bytes] = {}
    short = []
    for piece, at in zip(pieces, _places(pieces, length, anchor), strict=True):
        gram = piece[at : at + anchor]
        if gram not in number:
            if len(number) == len(_DIGITS) ** _PLACES:
                return repeated(pieces, length, folder)
            number[gram] = _numbered(len(number))
        short.append(piece[:at] + number[gram] + piece[at + anchor :])
    return repeated(short, length - anchor + 1 + _PLACES, folder)


def _collect(length: int, anchor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(one, two, step, a, b): windows a to b - 1 of a piece are repeated; rows lie in order of their collection.

    A collection's columns are external files of the task, in its own temporary
    folder, which goes with it: nothing outside the task ever reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def done() -> pa.RecordBatch:
            out = []
            with tempfile.TemporaryDirectory(prefix="columns-") as folder:
                found = repeats([r[3] for r in rows], length, anchor, folder) if rows else []
            for (one, two, step, _), flags in zip(rows, found, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                out += [(one, two, step, a, b) for a, b in edge.reshape(-1, 2).tolist()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["one", "two", "step", "a", "b"])

        for batch in batches:
            for collection, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if collection != last:
                    yield done()
                    last, rows = collection, []
                rows.append(row)
        yield done()

    return run


def _remove(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text, starts, ends) to the digest of what is left; spans [start, end) are of window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _text.blocks(batches):
            removed, spans, digest, kept = [], [], [], []
            for found, a, b in zip(batch.column(2).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                change = np.zeros(b - a + 1, np.int32)
                for s in found or []:
                    change[s["start"]] += 1
                    change[s["end"] + length - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edge = np.diff(np.concatenate([[0], gone.view(np.int8)]))
                removed.append(int(gone.sum()))
                spans.append(int((edge == 1).sum()))
                left = data[a:b][~gone].tobytes()
                digest.append(sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row.

    A byte goes if a ``length``-byte string over it also starts elsewhere, in
    this or another row; strings are judged on the input, never across rows.
    Null texts are empty; rows that repeat each other, ids included, lose all
    that is long enough; ids may be null or shared; other columns are ignored;
    an empty table gives an empty result. ``kept`` has the bytes left, which a
    cut within a character need not leave as UTF-8.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = docs.where(F.octet_length("text") >= length)
    runs = long.select(_key(F.col("text")).alias("key"), "text").mapInArrow(_runs(length, anchor), "h long, own long, key long, start long, n long")
    runs = runs.select("h", "own", "key", F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"))
    # A table, like the spans below: Spark splits what very many rows share only in a join of two tables as they are.
    twice = _work.table(runs.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "shared-anchors")
    _work.release(spark)
    shared = _work.table(runs.join(twice, "h"), "shared-runs")
    _work.release(spark)

    kinds = _work.table(shared.groupBy("h", "own").agg(F.count("*").alias("times"), F.min(F.struct("key", "start", "n")).alias("at")), "kinds")
    # Anchors whose runs are not all equal: only there can windows repeat beyond equal runs.
    mixed = kinds.groupBy("h").agg(F.count("*").alias("runs")).where("runs > 1")
    wanted = kinds.join(mixed, "h").select("at.*", "h", "own", (F.col("runs") > MOST_RUNS).alias("split"))
    size, split = wanted.agg(F.coalesce(F.sum(F.when(~F.col("split"), F.col("n") + length)), F.lit(0)), F.count(F.when(F.col("split"), 1))).first()
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "own", "start", "n", "split")).alias("runs"))
    texts = long.select(_key(F.col("text")).alias("key"), "text")
    cut = wanted.join(texts, "key").select("runs", "text").mapInArrow(_cut(length), "h long, own long, split boolean, piece binary")
    # Repeated rows (id and text) give the same runs more than once; they count as equal runs already.
    cut = _work.table(cut.dropDuplicates(["h", "own"]), "cut-runs")
    _work.release(spark)
    # A piece is named by two numbers: a run by its anchor's hash and its own, a stretch likewise, by its group's. Step 0 has the runs.
    pieces = cut.where(~F.col("split")).select(F.col("h").alias("one"), F.col("own").alias("two"), F.lit(0).alias("step"), "piece")
    links: list[DataFrame] = []
    if split:
        whole = cut.where("split").select(F.col("h").alias("one"), F.col("own").alias("two"), F.lit(1).cast("long").alias("weight"), "piece")
        for step, (link, stretches) in enumerate(_split(whole, length, anchor), 1):
            links.append(link)
            # Both copies of a stretch that several runs have are found; the first one's verdict is taken.
            copies = F.when(F.col("times") > 1, F.array(F.lit(step), F.lit(-1))).otherwise(F.array(F.lit(step)))
            stretches = stretches.select(F.col("near").alias("one"), F.col("part").alias("two"), F.explode(copies).alias("step"), "piece")
            pieces, size = pieces.union(stretches), size + stretches.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
        _work.release(spark)
    collections = max(1, -(-size // COLLECTION_BYTES))
    pieces = pieces.select(F.pmod(F.xxhash64("one"), F.lit(collections)).alias("collection"), "one", "two", "step", "piece")
    pieces = pieces.repartition(F.col("collection")).sortWithinPartitions("collection")
    differing = _work.table(pieces.mapInArrow(_collect(length, anchor), "one long, two long, step int, a long, b long"), "repeats")
    _work.release(spark)

    equal = kinds.where("times > 1").select("h", "own", F.lit(0).cast("long").alias("a"), F.col("at.n").cast("long").alias("b"))
    single = kinds.where("times = 1").select("h", "own")
    # What is repeated in a stretch is so in all pieces that have it, step by step back to the runs.
    verdict = lambda step: differing.where(F.col("step") == step).select("one", "two", "a", "b")
    differs = verdict(len(links))
    for step in reversed(range(len(links))):
        held = differs.select(F.col("one").alias("near"), F.col("two").alias("part"), "a", "b").join(links[step], ["near", "part"])
        differs = verdict(step).union(held.select("one", "two", F.col("a") + F.col("at"), F.col("b") + F.col("at")))
    differs = differs.withColumnsRenamed({"one": "h", "two": "own"})
    spans = _work.table(equal.union(differs.join(single, ["h", "own"], "left_semi")), "run-spans")
    found = shared.join(spans, ["h", "own"]).select("key", (F.col("start") + F.col("a")).cast("int").alias("start"), (F.col("start") + F.col("b")).cast("int").alias("end"))
    found = found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = _work.table(found, "spans")
    _work.release(spark)
    out = docs.withColumn("key", _key(F.col("text"))).join(found, "key", "left").select("id", "text", "spans")
    out = out.mapInArrow(_remove(length), f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("id", id_col)
    return out if with_kept else out.drop("kept")
