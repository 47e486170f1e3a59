"""Exact nearest neighbours, regression on them, and shortest paths over their graph."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.functions.shared import folder, got, put, replaced, written

#: Rows of the base that meet a batch of queries at a time.
BASE_ROWS = 1024
#: Queries that meet a block at a time, and rows of a block that are measured for them at a time.
QUERY_ROWS, HIT_ROWS = 512, 1 << 16
#: A base of at most this many bytes goes to every executor; a larger one lies in files of half of it.
BROADCAST_BYTES = 64 << 20


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _parts(rows: pa.Table | pa.RecordBatch) -> np.ndarray | None:
    return rows.column("part").to_numpy() if "part" in rows.schema.names else None


def _sorted(keys: np.ndarray, x: np.ndarray, parts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    order = np.argsort(keys, kind="stable")
    return keys[order], x[order], None if parts is None else parts[order]


def _single(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows around ``centre`` as 32-bit numbers, with a place for one more; squares of their lengths)."""
    x = x - centre
    square = np.einsum("nd,nd->n", x, x)
    return np.concatenate([x, square[:, None]], 1, dtype=np.float32, casting="same_kind"), square


def _true(flags: np.ndarray) -> np.ndarray:
    """Places of the few that are true: eight at a time, then one by one."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    eight = np.flatnonzero(flags.view(np.uint64))
    return (eight[:, None] * 8 + np.arange(8))[flags.reshape(-1, 8)[eight]]


def nearest(src: np.ndarray, q: np.ndarray, bound: np.ndarray, keys: np.ndarray, x: np.ndarray, k: int, skip_self: bool, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, squared distances) of each query's k nearest of the sorted base rows and of the ``best`` among rows of smaller keys, ties by key, none beyond its ``bound``; distances are infinite where there are fewer.

    Blocks of the base are met in order; of each, only rows that a product of
    32-bit numbers, with what it may be off by, puts within the k best so far
    are measured exactly. Vectors whose squares those numbers do not hold are
    all measured. What is found is ranked when there are some k / 2 rows a
    query of it.
    """
    dst, far = best or _none(len(src), k)
    with np.errstate(over="ignore", invalid="ignore"):
        centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
        base, square = _single(x, centre)
        asked, size = _single(q, centre)
        asked *= np.float32(-2)
        asked[:, -1] = 1
        held = max(square.max(initial=0), size.max(initial=0)) < 1e30
        # Rounding of each term and of their sum, and of the way to the centre.
        off = 1.1 * (x.shape[1] + 8) * 2.0**-24
        shift = 1e-12 * (np.einsum("nd,nd->n", q, q) + np.einsum("nd,nd->n", x, x).max(initial=0)) + 1e-30
    for low in range(0, len(src), QUERY_ROWS):
        own = slice(low, low + QUERY_ROWS)
        one, queries, near, d2, most = src[own], q[own], dst[own], far[own], np.minimum(bound[own], far[own, -1])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(keys), BASE_ROWS):
            # Later rows have larger keys, so a query that has k copies of itself is done.
            open_ = d2[:, -1] > 0
            if not open_.any():
                break
            ids, rows = keys[at : at + BASE_ROWS], x[at : at + BASE_ROWS]
            place = np.searchsorted(ids, one).clip(0, len(ids) - 1)
            skip = np.flatnonzero((ids[place] == one) & skip_self)
            if held:
                fast = asked[own] @ base[at : at + BASE_ROWS].T
                fast[skip, place[skip]] = np.inf
                slack = off * (size[own] + 2 * square[at : at + BASE_ROWS].max()) + shift[own]
                if k <= len(ids) and np.isinf(most).any():
                    most = np.minimum(most, np.partition(fast, k - 1, 1)[:, k - 1] + size[own] + slack)
                limit = np.where(open_, most - size[own] + slack, -np.inf).astype(np.float32)
                hit = fast <= np.nextafter(limit, np.float32(np.inf))[:, None]
                hit[~open_] = False
            else:
                hit = np.broadcast_to(open_[:, None], (len(one), len(ids))).copy()
            hit[skip, place[skip]] = False
            i, j = np.divmod(_true(hit.ravel()), len(ids))
            # A few numbers a query as a rule; where many rows are alike, queries are taken in turn.
            ends = np.searchsorted(i, np.arange(len(one) + 1))
            first = 0
            while first < len(one):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + HIT_ROWS, "right")) - 1)
                part = slice(ends[first], ends[last])
                found.append((i[part], ids[j[part]], ((queries[i[part]] - rows[j[part]]) ** 2).sum(1)))
                if 2 * sum(len(f[0]) for f in found) >= k * len(one):
                    _kept(near, d2, found, most)
                first = last
            most = np.minimum(most, d2[:, -1])
        _kept(near, d2, found, most)
    return dst, far


def _none(queries: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((queries, k), np.iinfo(np.int64).max), np.full((queries, k), np.inf)


def nearest_apart(src: np.ndarray, q: np.ndarray, bound: np.ndarray, part: np.ndarray, keys: np.ndarray, x: np.ndarray, parts: np.ndarray, k: int, skip_self: bool, best: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest``, with rows of the query's own part (if that is not -1) left out."""
    dst, far = best or _none(len(src), k)
    for p in np.unique(part):
        asked, others = np.flatnonzero(part == p), slice(None) if p == -1 else parts != p
        dst[asked], far[asked] = nearest(src[asked], q[asked], bound[asked], keys[others], x[others], k, skip_self, (dst[asked], far[asked]))
    return dst, far


def _found(batch: pa.RecordBatch, width: int, blocks: Iterable[tuple], k: int, skip_self: bool) -> pa.RecordBatch:
    """(src, dst, d2, rank) of a batch of queries, which meet one block of the base after another."""
    src, q, bound, part = batch.column("src").to_numpy(), _matrix(batch.column("q"), width), batch.column("bound").to_numpy(), _parts(batch)
    dst, far = _none(len(src), k)
    for keys, x, parts in blocks:
        dst, far = nearest(src, q, bound, keys, x, k, skip_self, (dst, far)) if part is None else nearest_apart(src, q, bound, part, keys, x, parts, k, skip_self, (dst, far))
    real = np.isfinite(far)
    rank = np.broadcast_to(np.arange(1, k + 1), far.shape)
    return pa.record_batch({"src": np.repeat(src, real.sum(1)), "dst": dst[real], "d2": far[real], "rank": rank[real]})


def _stored(rows: DataFrame, width: int, size: int, groups: int) -> list[str]:
    """Files of at most ``size`` rows (key, x, part) each, in order of the keys, in the shared folder."""
    path = folder(rows.sparkSession)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, number = [], 0, 0

        def file() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            name = f"{table['group'][0].as_py():06d}-{number:06d}"
            put(f"{path}/{name}", b"".join(np.ascontiguousarray(v).tobytes() for v in (table["key"].to_numpy(), _matrix(table["x"], width), _parts(table)) if v is not None))
            return pa.record_batch({"name": [name]})

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - count))
                batch = batch.slice(size - count)
                count += held[-1].num_rows
                if count == size:
                    yield file()
                    held, count, number = [], 0, number + 1
        if count:
            yield file()

    dealt = rows.repartitionByRange(groups, "key").sortWithinPartitions("key").withColumn("group", F.spark_partition_id())
    return sorted(f"{path}/{r[0]}" for r in dealt.mapInArrow(stored, "name string").collect())  # a line for each file


def _read(path: str, width: int, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(keys, vectors, parts) of a file of ``_stored``."""
    data = got(path)
    n = len(data) // (8 + 8 * width + 4 * apart)
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, float, n * width, 8 * n).reshape(n, width), np.frombuffer(data, np.int32, n, 8 * n * (1 + width)) if apart else None


def _kept(near: np.ndarray, d2: np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], most: np.ndarray) -> None:
    """Puts rows found (query, key, distance) among the k nearest so far, in place, and empties the list."""
    if not found:
        return
    i, ids, d = (np.concatenate(c) for c in zip(*found, strict=True))
    found.clear()
    within = d <= most[i]
    i, ids, d = i[within], ids[within], d[within]
    if not len(i):
        return
    k = near.shape[1]
    who = np.flatnonzero(np.bincount(i, minlength=len(near)))
    i, ids, d = (np.concatenate(c) for c in ((i, np.repeat(who, k)), (ids, near[who].ravel()), (d, d2[who].ravel())))
    order = np.lexsort((ids, d, i))
    i, ids, d = i[order], ids[order], d[order]
    at = np.searchsorted(i, who)[:, None] + np.arange(k)
    near[who], d2[who] = ids[at], d[at]


def knn(queries: DataFrame, base: DataFrame, k: int = 5, key: str = "frame", column: str = "features", skip_self: bool = True, bound: str | None = None, part: str | None = None) -> DataFrame:
    """(src, dst, rank, d2): the k rows of ``base`` nearest to each query in squared Euclidean distance, ties by key.

    ``skip_self`` leaves out the row with the query's own key, wherever it
    ranks; ``bound`` names a column of distances beyond which a query seeks
    nothing, ``part`` one of numbers from 0: a query seeks among rows of other
    parts alone. Rows travel singly, once, so that a Python worker holds a
    batch of queries and the base, or one file of a larger one, which every
    batch reads in turn.
    """
    n, width = base.select(F.count("*"), F.max(F.size(column))).first()
    width = width or 0
    own = [F.col(part).cast("int").alias("part")] if part else []
    rows = base.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("x"), *own)
    within = F.coalesce(F.col(bound).cast("double"), F.lit(float("inf"))) if bound else F.lit(float("inf"))
    left = queries.select(F.col(key).cast("long").alias("src"), F.col(column).cast("array<double>").alias("q"), within.alias("bound"), *own)
    tasks = 4 * base.sparkSession.sparkContext.defaultParallelism
    if n * width * 8 <= BROADCAST_BYTES:
        held = rows.toArrow()
        shared = base.sparkSession.sparkContext.broadcast(_sorted(held["key"].to_numpy(), _matrix(held["x"], width), _parts(held)) if n else None)
        blocks = lambda: [shared.value] if shared.value else []
    else:
        size = max(BROADCAST_BYTES // (16 * width), 1)
        files = _stored(rows, width, size, -(-n // size))
        blocks = lambda: (_read(file, width, bool(part)) for file in files)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _found(batch, width, blocks(), k, skip_self)

    return left.repartition(tasks, "src").mapInArrow(against, "src long, dst long, d2 double, rank long").select("src", "dst", "rank", "d2")


def knn_graph(points: DataFrame, k: int = 5, weighted: bool = True, key: str = "frame", column: str = "features") -> DataFrame:
    """(src, dst, w): directed edges to the k nearest other rows; w is the squared distance, or 1."""
    return knn(points, points, k, key, column).select("src", "dst", (F.col("d2") if weighted else F.lit(1.0)).alias("w"))


def knn_regress(queries: DataFrame, base: DataFrame, targets: DataFrame, k: int = 5, weights: str = "distance", key: str = "frame", column: str = "features", target: str = "y", found: DataFrame | None = None) -> DataFrame:
    """(key, y) from ``found`` neighbours, by default those of ``knn``: mean of the neighbours' target arrays, uniform or by 1 / d2, d2 cut off below at half the smallest d2 above 0 of the whole batch."""
    found = knn(queries, base, k, key, column, skip_self=False) if found is None else found
    if weights == "distance":
        low = found.where("d2 > 0").agg((F.min("d2") * 0.5).alias("low"))
        found = found.join(F.broadcast(low)).withColumn("w", 1 / F.greatest("d2", "low"))
    elif weights == "uniform":
        found = found.withColumn("w", F.lit(1.0))
    else:
        raise ValueError(f"unknown weights {weights}")
    held = found.join(targets.select(F.col(key).alias("dst"), F.col(target).alias("v")), "dst")
    n = targets.select(F.size(target)).first()[0]
    means = [(F.sum(F.col("w") * F.col("v")[i]) / F.sum("w")) for i in range(n)]
    return held.groupBy(F.col("src").alias(key)).agg(F.array(*means).alias("y"))


#: Edges up to which a path is sought in one process.
HELD_EDGES = 200_000


def geodesic(edges: DataFrame, start: int, end: int, held: int = HELD_EDGES) -> list[tuple[int, float]]:
    """[(key, distance to the end)] along the shortest path over the undirected graph; empty if there is none.

    A graph of at most ``held`` edges is searched with a heap; a larger one
    by ``shortest_paths``. Only the path itself is collected. Where several
    paths are equally short, either way may give another. Edges are made once,
    as seeking them may be most of the work.
    """
    edges = written(edges.select("src", "dst", "w"))
    if edges.limit(held + 1).count() <= held:
        return _by_heap(edges.collect(), start, end)
    far = shortest_paths(edges, end, start)
    if not far.where(F.col("key") == start).limit(1).count():
        return []
    return along(far, start, end)


def shortest_paths(edges: DataFrame, source: int, until: int | None = None) -> DataFrame:
    """(key, d, towards): distances to ``source`` over the undirected graph (src, dst, w), and the next key on the way there; a table.

    Delta-stepping: keys whose distance has changed are relaxed by a join with
    the edges, those within the nearest bucket first, so that most keys are
    relaxed once; distances are joined with the edges by key, and nothing is
    collected but a line a round. With ``until``, rounds end when its distance
    is final; keys beyond may be missing, or further than they are.
    """
    both = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    both = both if hasattr(edges, "_written_to") else written(both)
    both = written(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    low, step = both.agg(F.min("w"), F.avg("w")).first()
    if low is not None and low < 0:
        raise ValueError("weights must not be negative")
    step = step or 1.0
    spark = edges.sparkSession
    far = written(spark.range(1).select(F.lit(source).cast("long").alias("key"), F.lit(0.0).alias("d"), F.lit(source).cast("long").alias("towards"), F.lit(True).alias("open")))
    limit = step
    while True:
        best, target = far.agg(F.min(F.when(F.col("open"), F.col("d"))), F.min(F.when(F.col("key") == (source if until is None else until), F.col("d")))).first()
        if best is None or (until is not None and target is not None and best >= target):
            return far.drop("open")
        if best >= limit:
            limit = (best // step + 1) * step
        now = F.col("open") & (F.col("d") < limit)
        reached = far.where(now).join(both, F.col("key") == F.col("src")).select(F.col("dst").alias("key"), (F.col("d") + F.col("w")).alias("d"), F.col("src").alias("towards"), F.lit(True).alias("new"))
        held = far.select("key", "d", "towards", F.lit(False).alias("new"), (F.col("open") & (F.col("d") >= limit)).alias("still"))
        # A key's own entry comes before an equal new one.
        both_ways = held.union(reached.withColumn("still", F.lit(True))).groupBy("key").agg(F.min(F.struct("d", "new", "towards", "still")).alias("m"))
        far = replaced(far, both_ways.select("key", "m.d", "m.towards", F.col("m.still").alias("open")))


def along(far: DataFrame, start: int, end: int) -> list[tuple[int, float]]:
    """[(key, d)] from ``start`` over ``towards`` to ``end``: ways of 1, 2, 4, ... steps are joined from those before them, so that a long path takes few rounds."""
    ways = written(far.select("key", F.col("towards").alias("to")))
    path = written(far.where(F.col("key") == start).select("key", F.lit(0).cast("long").alias("step")))
    length = 1
    while not path.where(F.col("key") == end).limit(1).count():
        next_ = path.join(ways, "key").select(F.col("to").alias("key"), (F.col("step") + length).alias("step"))
        path = replaced(path, path.union(next_).groupBy("key").agg(F.min("step").alias("step")))
        ways = replaced(ways, ways.join(ways.select(F.col("key").alias("to"), F.col("to").alias("then")), "to").select("key", F.col("then").alias("to")))
        length *= 2
    return [(r["key"], r["d"]) for r in path.join(far, "key").orderBy("step").collect()]


def _by_heap(rows: list, start: int, end: int) -> list[tuple[int, float]]:
    near: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for a, b, w in rows:
        near[a].append((b, w))
        near[b].append((a, w))
    far, next_, queue = {end: 0.0}, {}, [(0.0, end)]
    while queue:
        d, a = heapq.heappop(queue)
        if d > far[a]:
            continue
        if a == start:
            break
        for b, w in near[a]:
            if d + w < far.get(b, np.inf):
                far[b], next_[b] = d + w, a
                heapq.heappush(queue, (d + w, b))
    if start not in far:
        return []
    path = [start]
    while path[-1] != end:
        path.append(next_[path[-1]])
    return [(p, far[p]) for p in path]
