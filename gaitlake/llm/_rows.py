"""Telling equal rows apart, without a task for a large group of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _work


def _same(keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys))


def numbered_copies(rows: DataFrame, *keys: str, name: str = "nth") -> DataFrame:
    """Adds ``name``: for rows that share all ``keys`` (nulls are alike) 1, 2, ... in no order that matters, null for one of them and for rows that share them with none.

    ``rows`` is a table with ``row`` from ``monotonically_increasing_id``. Copies
    are counted for each of its partitions first and numbered within one, so a
    group that holds a third of all rows is as many tasks as the table had.
    The numbers of copies are a table of their own.
    """
    renamed = {k: f"_{k}_" for k in keys}
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n").withColumnsRenamed(renamed)
    again = rows.join(groups, _same(keys), "left_semi").select(*keys, "row", F.shiftright("row", 33).alias("_part"))
    by = ", ".join(f"_{k}_" for k in keys)
    before = again.groupBy(*keys, "_part").agg(F.count("*").alias("_c")).withColumnsRenamed(renamed | {"_part": "_p"})
    before = before.withColumn("_before", F.expr(f"coalesce(sum(_c) over (partition by {by} order by _p rows between unbounded preceding and 1 preceding), 0)"))
    own = F.expr(f"row_number() over (partition by {', '.join(keys)}, _part order by row) - 1")
    found = again.withColumn("_own", own).join(before, _same(keys) & (F.col("_part") == F.col("_p")))
    found = found.select(F.col("row").alias("_row"), (F.col("_before") + F.col("_own")).alias(name)).where(F.col(name) > 0)
    # Copies alone are written, so that whoever reads the rows again does not number them again.
    found = _work.table(found, "copies")
    return rows.join(found, F.col("row") == F.col("_row"), "left").drop("_row")
