"""The corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all its predecessor kept and returns the columns of ``documents``,
but the last, which adds the shard. ``run`` applies them to ``documents``,
each stage written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.llm import _work
from gaitlake.llm.classifier import quality_model, scored
from gaitlake.llm.decontaminate import decontaminate
from gaitlake.llm.mixing import mix
from gaitlake.llm.near_dedup import one_of_each
from gaitlake.llm.sharding import shard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labelled ones among ``docs``.

    Whole texts are scored, however long. Null and empty texts get the
    model's bias as their score and stay or go together; repeated rows are
    treated alike; null ids and null labels teach nothing; further columns are
    ignored; an empty table stays empty.
    """
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select(*COLUMNS), model, keep_text=True).where("_score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates (five-word shingles, similarity 0.8).

    A repeated row is a group; rows of one id with unlike texts are groups of
    their own; rows without an id are kept if no row of their group has one,
    one of them. Null, empty and blank texts have no shingles and all stay.
    Further columns are ignored; an empty table stays empty.
    """
    return one_of_each(docs.select(*COLUMNS), width=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item, anywhere in the whole text.

    Null and empty texts hold none and stay; repeated rows stay or go
    together; further columns are ignored; an empty table stays empty.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where("not contaminated").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as many times as the mix says; a copy is a row.

    A null source is a source. Documents without words count for nothing and
    are kept or left as their id draws; rows that repeat each other draw
    alike; further columns are ignored; an empty table stays empty.
    """
    taken = mix(docs.select(*COLUMNS), keep=("text", "lang", "source", "n_chars")).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every row its shard and its slot there: all rows stay, null ids and texts included; copies are rows of their own; an empty table stays empty."""
    return shard(docs, keep=("text", "lang", "source", "n_chars"))


STAGES = [("quality classifier", quality), ("near dedup", near_dedup), ("decontamination", leaks), ("source mix", source_mix), ("sharding", shards)]

#: The classifier and the mix have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = _work.table(stage(spark, docs, sf_dir), "stage")
    return docs
