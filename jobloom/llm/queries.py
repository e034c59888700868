"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontaminate as contamination
from jobloom.llm import jaccard_join, minhash_join, mixing, ppm, quality, secretscan, spotsigs, sql, suffix_dedup, token_align, toxicity, turn_repair, urlfilter

Run = Callable[[SparkSession, str], DataFrame]

# Target weights of the mix: domains are groups of sources, languages weigh by their labels.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_domain(documents: DataFrame) -> DataFrame:
    """Adds the domain of a source: its number modulo 4."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    return documents.withColumn("domain", F.when(number != "", F.concat(F.lit("d"), (number.cast("bigint") % 4).cast("string"))))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copy_classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(with_domain(table(spark, sf_dir, "documents")), MIX_WEIGHTS)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents")).select(
        "kept.doc_id",
        "n_candidates",
        F.size("secrets").cast("bigint").alias("n_secrets"),
        "secrets",
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The groups are hashed before they are stored, being several times longer than the texts.
    aligned = token_align.align_documents(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return token_align.with_counts(aligned.withColumn("groups_sha256", digest).drop("groups"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Run] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard": op4_jaccard,
    "op5_quality": op5_quality,
    "op6_ppm": op6_ppm,
    "op7_spotsigs": op7_spotsigs,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mix": op9_mix,
    "op10_secrets": op10_secrets,
    "op11_token_alignment": op11_token_alignment,
    "op12_turn_repair": op12_turn_repair,
    "op13_minhash": op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": sql.DECONTAMINATE,
    "op4_jaccard": sql.JACCARD,
    "op8_suffix_dedup": sql.SUFFIX_DEDUP,
    "op9_mix": sql.MIX,
    "op13_minhash": sql.MINHASH,
}
