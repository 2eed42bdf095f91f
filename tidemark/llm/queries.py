"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, fmindex, hdlang, mix, quality, rules, secrets, shards, simhash, tokenbin
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_report(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(table(spark, sf_dir, "documents"))


def op3_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.read(tokenbin.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.deduplicated(table(spark, sf_dir, "documents"))


def op8_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.classify(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdlang.identify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_quality_score, op4_near_copies, op5_decontaminate, op6_token_files, op7_substring_dedup, op8_shard_compaction, op9_secret_scan, op10_language, pipeline)}
ORACLES = {"op1_mix_sources": mix.REPORT_SQL, "op9_secret_scan": secrets.report_sql()}
