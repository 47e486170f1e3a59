"""Sharding by fixed virtual slots.

Records hash into thousands of slots, far more than there are shards. Bytes
and rows are counted per slot, and a small versioned map gives each slot its
shard. The first map deals slots out in turn, before anything is counted; each
later version is the one before it, edited: slots move from shards above the
mean to shards below it until sizes are level, and all others stay. Versions
are kept as tables in one folder. DataFrame operations only; the driver sees
one row for each slot.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.llm import _work
from gaitlake.llm._rows import numbered_copies

SLOTS = 4096


@dataclass(frozen=True)
class Slot:
    """One line of the slot map."""

    virtual: int
    shard: int
    version: int
    bytes: int
    rows: int


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(virtual slot, bytes, rows) of every slot, from columns ``virtual`` and ``size``; never more than ``slots`` lines."""
    found = {r[0]: (r[1], r[2]) for r in records.groupBy("virtual").agg(F.sum("size"), F.count("*")).collect()}
    return [(k, *found.get(k, (0, 0))) for k in range(slots)]


def first_map(shards: int, slots: int = SLOTS) -> list[Slot]:
    """Version 1: slots to shards in turn."""
    return [Slot(k, k % shards, 1, 0, 0) for k in range(slots)]


#: Loads that differ by less than this share of their mean are level.
LEVEL = 1e-4


def rebalance(slots: list[Slot], sizes: list[tuple[int, int, int]], shards: int) -> list[Slot]:
    """Next version of the map for new sizes or more shards.

    First, slots move from shards above the mean to the emptiest one, largest
    first, as long as the giver stays above the mean. Then, unless shards were
    added, which take slots and give none, the fullest and the emptiest shard
    swap the slots (or the one gives a slot) that bring them closest to each
    other, until loads are level or no swap helps. All other slots keep their
    shard, but for those of shards that there are no more, which come first.
    """
    version = max(s.version for s in slots) + 1
    size = {v: (b, r) for v, b, r in sizes}
    now = [replace(s, version=version, bytes=size[s.virtual][0], rows=size[s.virtual][1]) for s in slots]
    bytes_of = {s.virtual: s.bytes for s in now}
    held: dict[int, set[int]] = {k: set() for k in range(shards)}
    for s in now:
        if s.shard < shards:
            held[s.shard].add(s.virtual)
    load = {k: sum(bytes_of[v] for v in held[k]) for k in held}
    mean = sum(bytes_of.values()) / shards

    def move(v: int, giver: int, taker: int) -> None:
        held[giver].remove(v)
        held[taker].add(v)
        load[giver] -= bytes_of[v]
        load[taker] += bytes_of[v]

    lightest = lambda: min(load, key=lambda k: (load[k], k))
    for s in sorted((s for s in now if s.shard >= shards), key=lambda s: (-s.bytes, s.virtual)):
        taker = min(load, key=lambda k: (load[k], len(held[k]), k))
        held[taker].add(s.virtual)
        load[taker] += s.bytes
    for giver in sorted(load, key=lambda k: (-load[k], k)):
        for v in sorted(held[giver], key=lambda v: (-bytes_of[v], v)):
            taker = lightest()
            if bytes_of[v] and load[giver] - bytes_of[v] >= mean and load[taker] + bytes_of[v] < load[giver]:
                move(v, giver, taker)
    added = max(s.shard for s in slots) + 1 < shards
    for _ in range(0 if added else 16 * shards):
        giver, taker = max(load, key=lambda k: (load[k], -k)), lightest()
        gap = load[giver] - load[taker]
        if gap <= LEVEL * mean:
            break
        back = [(0, -1), *sorted((bytes_of[v], v) for v in held[taker])]
        best = (gap, -1, -1)
        for v in sorted(held[giver]):
            at = bisect.bisect_left(back, (bytes_of[v] - gap / 2, -1))
            best = min(best, *((abs(gap - 2 * (bytes_of[v] - b)), v, u) for b, u in back[max(0, at - 1) : at + 1]))
        if best[0] >= gap:
            break
        move(best[1], giver, taker)
        if best[2] >= 0:
            move(best[2], taker, giver)
    place = {v: k for k in held for v in held[k]}
    return [replace(s, shard=place[s.virtual]) for s in now]


def stored(spark: SparkSession, slots: list[Slot], folder: str) -> DataFrame:
    """Writes a version of the map beside those before it, with each slot's first position in its shard. What a lost driver has left of the same version is overwritten."""
    after: dict[int, int] = {}
    lines = []
    for s in slots:
        lines.append([s.virtual, s.shard, s.version, s.bytes, s.rows, after.get(s.shard, 0)])
        after[s.shard] = after.get(s.shard, 0) + s.rows
    held = F.from_json(F.lit(json.dumps(lines)), "array<array<long>>")
    line = spark.range(1).select(F.explode(held).alias("x"))
    path = f"{folder}/version-{slots[0].version:06d}"
    line.select(*(F.col("x")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(MAP))).write.mode("overwrite").parquet(path)
    return spark.read.schema(", ".join(map(" ".join, MAP))).parquet(path)


MAP = (("virtual", "int"), ("shard", "int"), ("version", "int"), ("bytes", "long"), ("rows", "long"), ("base", "long"))


def newest(spark: SparkSession, folder: str) -> list[Slot] | None:
    """The last whole version in the folder, if there is one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return None
    paths = sorted(p.getPath().toString() for p in store.listStatus(hadoop))
    whole = [p for p in paths if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))]
    if not whole:
        return None
    return [Slot(*r) for r in spark.read.parquet(whole[-1]).orderBy("virtual").select("virtual", "shard", "version", "bytes", "rows").collect()]


#: Rows of a virtual slot that are numbered together, on average.
NUMBERED_ROWS = 100_000


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual, map_version, *keep) for every row.

    ``size`` is the text's UTF-8 bytes plus 1 (a null text has none, and crc32
    0), however long. The law is ``bytes``: shards hold nearly equal sizes, as
    far as no one record is larger than a shard should be. ``folder`` keeps
    the versions of the map: the newest there, or else the first map, is
    edited for the sizes found and written as the next version, so rows stay in
    their shards but for the slots that move; the map of a folder keeps its
    number of slots, another is an error. Without one, both versions lie in
    the shared folder until the application ends.

    ``slot`` numbers the rows of a shard from 0 without gaps: by virtual slot,
    part of it, id, crc and size; equal rows come in any order, which no column
    shows. A virtual slot is numbered in parts of about NUMBERED_ROWS rows, so
    no task handles a whole shard or slot. Rows that share id and crc, null ids
    among them, hash with their number among these, so that they spread over
    slots, as many to each whenever they are dealt out again. ``keep`` names columns to carry along; others,
    whatever their names, are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.struct(*(F.col(c) for c in keep) if keep else [F.lit(0).alias("_")]).alias("_kept"))
    records = _work.table(records.withColumn("row", F.monotonically_increasing_id()), "rows")
    records = numbered_copies(records, "_id", "crc").drop("row")
    # A null is no part of a hash, so rows without copies hash by id and crc alone.
    records = _work.table(records.withColumn("hash", F.xxhash64("_id", "crc", "nth")).withColumn("virtual", F.pmod("hash", F.lit(slots)).cast("int")), "records")
    folder = folder or _work.place(spark, "slot-maps")
    sizes = slot_sizes(records, slots)
    before = newest(spark, folder)
    if before is not None and len(before) != slots:
        raise ValueError(f"the map in {folder} has {len(before)} slots, not {slots}")
    if before is None:
        before = first_map(shards, slots)
        stored(spark, before, folder)
    slot_map = stored(spark, rebalance(before, sizes, shards), folder)
    parts = max(1, -(-sum(r for _, _, r in sizes) // (slots * NUMBERED_ROWS)))
    records = records.withColumn("part", F.pmod(F.shiftright("hash", 20), F.lit(parts)).cast("int"))
    counts = records.groupBy("virtual", "part").agg(F.count("*").alias("n"))
    offset = counts.select("virtual", "part", F.expr("coalesce(sum(n) over (partition by virtual order by part rows between unbounded preceding and 1 preceding), 0)").alias("offset"))
    # The map has `slots` lines whatever the input, hence the broadcast.
    placed = records.join(F.broadcast(slot_map.select("virtual", "shard", "version", "base")), "virtual")
    placed = placed.join(offset, ["virtual", "part"]) if parts > 1 else placed.withColumn("offset", F.lit(0).cast("long"))
    rank = F.expr("row_number() over (partition by virtual, part order by _id, crc, size) - 1").cast("long")
    return placed.select(
        F.col("_id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("offset") + rank).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual", F.col("version").alias("map_version"), *(F.col("_kept")[c].alias(c) for c in keep),
    )
