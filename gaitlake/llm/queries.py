"""The corpus operators over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitlake.llm import oracles
from gaitlake.llm.chats import chat_windows, read_back
from gaitlake.llm.classifier import quality_scores
from gaitlake.llm.collocations import collocations
from gaitlake.llm.decontaminate import decontaminate
from gaitlake.llm.fill_middle import fill_in_middle, restored
from gaitlake.llm.mixing import mix
from gaitlake.llm.near_dedup import near_duplicates
from gaitlake.llm.pii import find_pii
from gaitlake.llm.quality_rules import quality_rules
from gaitlake.llm.secrets import scan_secrets
from gaitlake.llm.sharding import shard
from gaitlake.llm.substrings import remove_repeats
from gaitlake.llm.tokens import tokenise

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_columnwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), width=4)


def op3_frequency_ranked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenise(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_documents(spark, sf_dir))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_documents(spark, sf_dir))


def op6_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which rule is named depends on their order, and so on the sample; the verdict does not.
    return quality_rules(_documents(spark, sf_dir)).drop("failed_rule")


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir))


def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op10_ngram_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(ok)
    back = read_back(chat_windows(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_columnwise_suffix_dedup, op2_minhash_near_dedup, op3_frequency_ranked_tokens, op4_skip_chain_pii, op5_secret_ownership, op6_wu_manber_decontamination, op7_quality_cascade, op8_virtual_slots, op9_entropy_balancing, op10_ngram_ftrl, op11_budgeted_chat_windows, op12_phrase_collocations, op13_fill_in_middle)}

ORACLES: dict[str, str] = {
    "op1_columnwise_suffix_dedup": oracles.REPEATS,
    "op2_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op5_secret_ownership": oracles.SECRETS,
    "op6_wu_manber_decontamination": oracles.DECONTAMINATION,
    "op7_quality_cascade": oracles.QUALITY,
    "op11_budgeted_chat_windows": oracles.CHATS,
    "op12_phrase_collocations": oracles.COLLOCATIONS,
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
