"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gaitlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, held in the shared folder until nothing refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: cheap to read in part, and safe from lost executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes a table made by ``table`` that no remaining plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for made in [m for m in _made if path.rstrip("/").endswith(m.partition(":")[2].lstrip("/") if ":" in m else m.lstrip("/"))]:
            _delete(_made.pop(made), made)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        _delete(spark, path)
    _made.clear()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, rather than when its driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
