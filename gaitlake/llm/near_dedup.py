"""Near-duplicate groups by min-max hashing.

Each document becomes the set of its word shingles. Every permutation gives
two signature lanes, the smallest and the largest permuted value, so ``p``
evaluations yield ``2p`` lanes; both agree between two documents with a
probability that equals their Jaccard similarity. Lanes are cut into bands,
and documents that share a band are candidates.

The nodes of the graph are the distinct sets, whatever ids their documents
have. Links are confirmed on the full sets. A band's bucket is not expanded
into pairs: its members are first compared with three leaders (a number of
rows linear in the bucket), linked sets are merged, and only buckets that
still hold several components go on, in blocks of bounded bytes compared inside
a task, which give back no more links than join components. So the components
are those of *all* confirmed links between candidates, at any bucket size.

Buckets, leaders, components and copies may be very large. What belongs to
those above a size that leaves at most HOT_KEYS of them is broadcast, all else
is joined by key, so no task gets a large group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _text, _work
from gaitlake.llm.components import components

#: Lanes in a band and number of bands. A pair at similarity 0.8 shares no band with a probability of (1 - 0.8**4)**32, 5e-8.
ROWS, BANDS = 4, 32
#: Shingles of either side that one block comparison holds, on average.
BLOCK = 1 << 18
#: Most groups that are broadcast for being large, and the size from which on a group may be one of them.
HOT_KEYS, HOT_ROWS = 100_000, 500

Sets = Callable[[pa.Array], list[np.ndarray]]


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text with fewer words is one shingle, none gives the empty set."""
    data, offsets = _text.utf8(column)
    out = []
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _text.BLOCK_BYTES, "right")) - 1)
        held = _text.LOWER[data[offsets[at] : offsets[to]]]
        hashes, _, _, first = _text.word_hashes(held, offsets[at : to + 1] - offsets[at], _text.SPACED)
        runs = _text.shingles(hashes, width)
        for i in range(to - at):
            n = first[i + 1] - first[i]
            if n >= width:
                run = np.sort(runs[first[i] : first[i + 1] - width + 1])
                keep = np.empty(len(run), bool)
                keep[0] = True
                np.not_equal(run[1:], run[:-1], out=keep[1:])
                out.append(run[keep])
            elif n:
                own = hashes[first[i] : first[i + 1]]
                out.append(_text.mix(_text.shingles(own, n) ^ np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def _multipliers(n: int) -> np.ndarray:
    odd = _text.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_text.MULTIPLIER))
    return (odd >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def lanes(members: np.ndarray, n: int = ROWS * BANDS) -> np.ndarray:
    """Min-max signature: the smallest values under ``n`` / 2 permutations, then the largest."""
    low = (members >> np.uint64(32)).astype(np.uint32)
    factors = _multipliers(n // 2)
    smallest, largest = np.full(n // 2, 0xFFFFFFFF, np.uint32), np.zeros(n // 2, np.uint32)
    for at in range(0, len(low), 4096):
        permuted = low[at : at + 4096] * factors[:, None]
        np.minimum(smallest, permuted.min(1), out=smallest)
        np.maximum(largest, permuted.max(1), out=largest)
    return np.concatenate([smallest, largest])


def band_keys(members: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of the signature; lanes of one permutation go to different bands."""
    low, high = np.split(lanes(members, rows * bands).astype(np.uint64), 2)
    held = _text.mix(np.concatenate([low, np.roll(high, 1)]).reshape(rows, bands) + np.uint64(1))
    return _text.mix(held.sum(0) * np.uint64(_text.MULTIPLIER) + np.arange(bands, dtype=np.uint64))


def _signatures(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The columns before the text, and each text's set: its size, digest and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in _text.blocks(batches):
            sets = shingle_sets(batch.column(3), width)
            keys = [band_keys(s).astype(np.int64) if len(s) else None for s in sets]
            digest = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "k1", "k2", "n", "digest", "bands"])

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b|, on sorted distinct hashes."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _check_pairs(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (a, b, text_a, text_b), equal ones of a together: keeps the linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch, _, _ in _text.blocks(batches, "text_b"):
            a = batch.column(0).to_pylist()
            new = [i for i, x in enumerate(a) if x != (a[i - 1] if i else last)]
            own = dict(zip(new, shingle_sets(batch.column(2).take(pa.array(new, pa.int64())), width), strict=True))
            keep = []
            for i, other in enumerate(shingle_sets(batch.column(3), width)):
                held = own.get(i, held)
                keep.append(linked(held, other, percent))
            last = a[-1]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def block_links(sets: list[np.ndarray], ids: np.ndarray, component: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows of unlike component, one of them on side 0, as many as join components.

    Counts the shared shingles of a row with all others at once over an
    inverted list; exact, and bounded by two blocks of rows.
    """
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    group = component.copy()
    found = []
    for i in np.flatnonzero(side == 0):
        if (group == group[i]).all():
            continue
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero((100 * both >= percent * (size + size[i] - both)) & (group != group[i])):
            if group[j] != group[i]:
                found.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]
    return found


def _check_blocks(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (block, id, component, side, text) that lie in order of block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def done() -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            ids, component, side, sets = zip(*rows, strict=True)
            return block_links(list(sets), np.array(ids), np.array(component), np.array(side), percent)

        for batch, _, _ in _text.blocks(batches):
            found = []
            sets = shingle_sets(batch.column(4), width)
            for block, *row, own in zip(*(batch.column(i).to_pylist() for i in range(4)), sets, strict=True):
                if block != last:
                    found += done()
                    last, rows = block, []
                rows.append((*row, own))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        found = done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _with(rows: DataFrame, facts: DataFrame, key: str, most: int) -> DataFrame:
    """Joins what ``facts`` has of each ``key``; keys of more than ``most`` rows (its column ``m``) are broadcast: by the choice of ``most`` they are few, and none is gathered in a task."""
    large = F.broadcast(facts.where(F.col("m") > most))
    small = rows.join(large.select(key), key, "left_anti").join(facts.where(F.col("m") <= most), key)
    return rows.join(large, key).unionByName(small)


def _most(rows: int) -> int:
    """Size above which there are HOT_KEYS groups at most."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def _leader_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links of bucket members with their buckets' leaders."""
    pairs = members.select("own", F.explode("leaders").alias("leader"))
    near = 100 * F.least("own.n", "leader.n") >= percent * F.greatest("own.n", "leader.n")
    pairs = _work.table(pairs.where((F.col("own.id") != F.col("leader.id")) & near).select(F.col("leader.id").alias("a"), F.col("own.id").alias("b")).distinct(), "pairs")
    most = _most(pairs.count())
    # A leader of very many pairs is dealt out, with its text, to as many places as it needs.
    dealt = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("places")).where("places > 1"))
    places = F.coalesce("places", F.lit(1).cast("long"))
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(dealt, "a", "left").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"))
    second = pairs.join(dealt, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), places).alias("place")).join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = second.join(first, ["a", "place"]).select("a", "b", "text_a", "text_b").sortWithinPartitions("a")
    return _work.table(pairs.mapInArrow(_check_pairs(width, percent), "a long, b long"), "links")


def _block_links(members: DataFrame, joined: DataFrame, texts: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """Confirmed links within buckets that hold several components, in blocks."""
    rest = members.where("m > 2 and not array_contains(leaders, own)").select("key", "own.id", "own.n")
    rest = _work.table(rest.join(joined.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component")), "rest")
    parts = rest.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("giant")).where("parts > 1")
    mixed = _work.table(mixed.select("key", "m", F.col("giant.component").alias("giant"), F.ceil(F.col("giant.n") / BLOCK).alias("blocks1"), F.ceil((F.col("all") - F.col("giant.n")) / BLOCK).alias("blocks0")), "mixed")
    # Side 1: blocks of the bucket's largest component, which need no comparison with each other. Side 0: blocks of all other rows.
    rest = _with(rest, mixed, "key", most).withColumn("side", (F.col("component") == F.col("giant")).cast("int"))
    rest = rest.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 1, F.col("blocks1")).otherwise(F.col("blocks0"))))
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_first = F.transform(every(F.col("blocks1")), lambda k: F.struct(F.col("own").alias("i"), (-k - 1).alias("j"), F.lit(0).alias("side")))
    as_first = F.concat(as_first, F.transform(every(F.col("blocks0")), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"), F.lit(0).alias("side"))))
    as_other = F.transform(every(F.col("blocks0")), lambda k: F.struct(k.alias("i"), (-F.col("own") - 1).alias("j"), F.lit(1).alias("side")))
    work = rest.select("key", "id", "component", F.explode(F.when(F.col("side") == 0, as_first).otherwise(as_other)).alias("w"))
    work = work.select(F.xxhash64("key", "w.i", "w.j").alias("block"), "id", "component", F.col("w.side").alias("side"))
    work = work.join(texts, "id").select("block", "id", "component", "side", "text")
    work = work.repartition(F.col("block")).sortWithinPartitions("block")
    return _work.table(work.mapInArrow(_check_blocks(width, percent), "a long, b long"), "links")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, text): two hashes of the text tell the texts of one id (or of none) apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, k1, k2, n, component_id, group) for every row; ``group`` numbers the components and is null for the empty set."""
    docs = _keyed(docs, id_col, text_col)
    signed = _work.table(docs.mapInArrow(_signatures(width), "id long, k1 long, k2 long, n long, digest binary, bands array<long>"), "signatures")
    # Equal sets stand for each other from here on: for one of the rows, that with the smallest id.
    row = F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2"))
    alike = signed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("m"), row.alias("row"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    alike = _work.table(alike.select(F.monotonically_increasing_id().alias("node"), "digest", "m", "row.id", "row.k1", "row.k2", "bands", "n"), "sets")
    nodes, rows = alike.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    most = _most(BANDS * nodes)

    bands = alike.select(F.posexplode("bands").alias("band", "hash"), F.struct(F.col("node").alias("id"), "n").alias("own")).select(F.xxhash64("band", "hash").alias("key"), "own")
    third = F.min(F.struct(F.xxhash64("own.id").alias("h"), "own"))["own"]
    buckets = bands.groupBy("key").agg(F.count("*").alias("m"), F.array_distinct(F.array(F.min("own"), F.max("own"), third)).alias("leaders")).where("m > 1")
    members = _work.table(_with(bands, _work.table(buckets, "buckets"), "key", most), "members")
    wanted = alike.select("node", F.col("id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).join(members.select(F.col("own.id").alias("node")).distinct(), "node", "left_semi")
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).groupBy("node").agg(F.first("text").alias("text"))
    texts = _work.table(texts.withColumnRenamed("node", "id"), "texts")

    links = _leader_links(members, texts, width, percent)
    joined = _work.table(components(links), "joined")
    more = _block_links(members, joined, texts, width, percent, most)
    ends = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    ends = alike.select("node", "digest", "m", "id").join(ends, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component", "node")
    ends = _work.table(ends, "ends")
    least = ends.groupBy("group").agg(F.count("*").alias("m"), F.min("id").alias("component_id"))
    ends = _with(ends.select("digest", "group", F.col("m").alias("copies")), least, "group", _most(nodes)).select("digest", "group", "component_id", F.col("copies").alias("m"))
    full = _with(signed.where("digest is not null").drop("bands"), _work.table(ends, "ends"), "digest", _most(rows)).select("id", "k1", "k2", "n", "component_id", "group")
    return full.unionByName(signed.where("digest is null").select("id", "k1", "k2", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("group")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    A document is the set of its ``width``-word shingles (words between white
    space, A-Z lower-cased); one with fewer words is a single shingle; one
    without words, or null, is empty and linked with nothing. Two documents
    are linked if 100 * shared >= percent * all shingles; a very long text is
    a large set like any other. ``component_id`` is the smallest id that links
    lead to, the row's own included, and ``kept`` marks the rows that carry it.
    Repeated rows stay repeated and get the same component. Rows that share an
    id but not their text are documents of their own, with their own links;
    ids may be null: such rows link like others, and where no row of a
    component has an id, ``component_id`` is null and its rows are kept. Other
    columns, whatever their names, are ignored. An empty table gives an empty
    result.
    """
    found = groups(docs, id_col, text_col, width, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group one row, that with the smallest id (null last), and every row without words."""
    found = _work.table(groups(docs, id_col, text_col, width, percent).where("group is not null").select("group", F.col("id").isNull().alias("none"), "id", "k1", "k2"), "groups")
    rows = found.groupBy("none", "id", "k1", "k2").agg(F.count("*").alias("times"), F.first("group").alias("group"))
    rows = _work.table(rows, "rows")
    kept = rows.groupBy("group").agg(F.count("*").alias("m"), F.min(F.struct("none", "id", "k1", "k2")).alias("kept"))
    rows = _with(rows, kept, "group", _most(rows.count())).withColumn("first", F.struct("none", "id", "k1", "k2") == F.col("kept"))
    names = docs.columns
    keyed = docs.withColumns({"_k1": F.xxhash64(F.col(text_col).cast("string")), "_k2": F.xxhash64(F.lit(1), F.col(text_col).cast("string"))})
    of = lambda d: keyed[id_col].cast("long").eqNullSafe(d["id"]) & (keyed["_k1"] == d["k1"]) & (keyed["_k2"] == d["k2"])
    lost = _work.table(rows.where("not first or times > 1").select("id", "k1", "k2", "first"), "lost")
    out = keyed.join(lost, of(lost), "left_anti")
    again = lost.where("first")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, of(again), "left_semi").dropDuplicates([id_col, "_k1", "_k2"]))
    return out.select(*names)
