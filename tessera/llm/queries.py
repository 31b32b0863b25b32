"""The queries opN_<name> of the subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import round_trip_digests
from .chat import DIGESTS_SQL, EXTRA, digests, windows
from .common import table
from .embeddings import LINKS_SQL, near_duplicates
from .mixing import mixture, mixture_sql
from .orderhash import near_copies
from .quality import quality_rules
from .secrets import secret_scan
from .substring import DEDUP_SQL, substring_dedup
from .suffix import suffix_dedup
from .tokencount import token_counts


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, looked up where it is used so that imports don't need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of the labelled documents of good quality that aren't toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(windows(turns.unionByName(extra)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixture(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))
    cell = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang")]
    return found.select("doc_id", *cell, "topic", "n_tokens", "probability", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_chat_windows": op3_chat_windows,
    "op4_mixing": op4_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": LINKS_SQL,
    "op3_chat_windows": DIGESTS_SQL,
    "op4_mixing": mixture_sql(),
    "op8_substring_dedup": DEDUP_SQL,
}
