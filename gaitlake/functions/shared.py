"""Tables between steps, in the folder that the driver and all executors reach."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new folder where driver and executors both reach it; it goes when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="gaitlake-")
    path = f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once and read from there: steps behind it neither repeat nor lose them."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` written; the table ``old``, from ``written``, is deleted once that is done, so that rounds of a loop do not pile up. No other plan may still read it."""
    out = written(new)
    _delete(old.sparkSession, old._written_to)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder from ``folder``, or one below it, that no task reads any more."""
    _delete(spark, path)


def put(path: str, data: bytes) -> None:
    """Writes a file of a folder from ``folder`` in a task. It appears as a whole, and a task that runs again puts the same in its place."""
    files, at = pyarrow.fs.FileSystem.from_uri(path)
    above = at.rpartition("/")[0]
    files.create_dir(above)
    part = f"{above}/_{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, at)


def got(path: str) -> bytes:
    """What ``put`` wrote, in a task of any executor."""
    files, at = pyarrow.fs.FileSystem.from_uri(path)
    with files.open_input_stream(at) as held:
        return held.read()


def numbered(df: DataFrame, *order: str, name: str = "i") -> DataFrame:
    """Adds the row's place from 0 in the order given; a table. Places are those within a range of the order's values, after the rows of all ranges before it: no task orders all rows, and rows that share their first values are parted by the others."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    held = df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_k"))
    held = written(held)
    before = held.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.expr("coalesce(sum(_n) over (order by _p rows between unbounded preceding and 1 preceding), 0)").alias("_before"))  # one row for each partition
    return held.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        _delete(spark, path)
