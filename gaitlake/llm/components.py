"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _work


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) over the edges a-b."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        for side in (left, right):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label[label] != label).any():
            label = label[label]
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
        if not len(left) or (before == label).all():
            break
    return nodes, nodes[label]


#: Most edges that one task contracts at once.
LOCAL_EDGES = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the edges of a partition, LOCAL_EDGES at a time, by stars with the same components."""

    def stars(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        node, root = roots(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        keep = node != root
        return node[keep], root[keep]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        if sum(len(x) for x, _ in held) > 2 * LOCAL_EDGES:
            held = [stars(held)]
            if len(held[0][0]) > LOCAL_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["src", "dst"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(held)], names=["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge, component being its smallest reachable node.

    ``edges`` has two BIGINT columns; direction, repeats and self-loops do not
    matter. Edges are first contracted to stars in tasks of at most
    ``LOCAL_EDGES`` edges; if one such task holds all, that is the result.
    Otherwise alternating star steps run: every node points its larger
    neighbours, then its smaller ones, to the smallest node it sees, which
    keeps the components and ends in one star for each. A step is an
    aggregation with partial minima and a join that adaptive execution can
    split, so a node with very many neighbours needs no task of its own. Edges
    with a null end are dropped. An empty edge list gives an empty result.
    """
    a, b = edges.columns[:2]
    edges = _work.table(edges.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).where("src is not null and dst is not null and src <> dst"), "edges")
    parts = max(1, -(-edges.count() // LOCAL_EDGES))
    raw, edges = edges, _work.table(edges.coalesce(parts).mapInArrow(_contract, "src long, dst long"), "edges")
    _work.drop(raw)
    while parts > 1:
        both = edges.union(edges.select("dst", "src"))
        low = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.join(low, both.src == low.node).where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low"))
        small = down.join(low, down.src == low.node).select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct(F.col("node").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.*")
        new = _work.table(small.where("src <> dst").distinct(), "edges")
        # Done when no node is both above one node and below another, and none has two lower neighbours: all edges form stars.
        odd = new.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src").union(new.join(new.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src"))
        done = odd.isEmpty()
        _work.drop(edges)
        edges = new
        if done:
            break
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(edges.select("dst", F.col("dst").alias("component")).distinct())
