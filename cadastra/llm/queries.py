"""The operators' registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm import bpe, exact_dedup, fingerprints, hard_negatives, jaccard_join, language_id, lm_scoring, merkle, mixing, quality, sentencepiece_sampling, suffix_dedup, url_filter
from cadastra.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.train_and_score(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode_samples(documents(spark, sf_dir), k=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judge(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_every_50th(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_lm_scoring, op4_suffix_dedup, op5_sentencepiece, op6_mixing, op7_fingerprints, op8_exact_dedup, op9_url_filter, op10_quality, op11_merkle, op12_hard_negatives, op13_bpe)}
ORACLE = {"op8_exact_dedup": exact_dedup.ORACLE, "op9_url_filter": url_filter.oracle(), "op11_merkle": merkle.oracle(), "op12_hard_negatives": hard_negatives.ORACLE}
