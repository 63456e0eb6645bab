"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadline.llm import bpe, ctw, decontam, kmeans, langid, line_dedup, quality, runs, secrets, sharding, simhash, substring_dedup, trie_bpe


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def over_documents(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(_docs(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op3(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": over_documents(langid.op1),
        "op2_sharding": over_documents(sharding.op2),
        "op3_decontamination": op3,
        "op4_line_dedup": over_documents(line_dedup.op4),
        "op5_substring_dedup": over_documents(substring_dedup.op5),
        "op6_bpe": over_documents(bpe.op6),
        "op7_simhash_near_dedup": over_documents(simhash.op7),
        "op8_quality_rules": over_documents(quality.op8),
        "op9_lm_scoring": over_documents(ctw.op9),
        "op10_secret_scans": over_documents(secrets.op10),
        "op11_periodic_runs": over_documents(runs.op11),
        "op12_word_bpe": over_documents(trie_bpe.op12),
        "op13_centroid_clustering": lambda spark, sf_dir: kmeans.op13(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": substring_dedup.ORACLE, "op8_quality_rules": quality.oracle(), "op10_secret_scans": secrets.oracle(), "op13_centroid_clustering": kmeans.oracle()}
