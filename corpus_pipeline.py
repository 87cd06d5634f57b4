"""The corpus pipeline: five stages, each of which works on all that the one before has kept.

language_id drops rows that aren't in a learned language; exact_dedup keeps one
of the rows with equal text, jaccard_join one of each class of near duplicates;
mixing repeats or drops rows to meet the sources' targets; sentencepiece
encodes what is left. All but the last return the columns of their input, also
those with names that an operator uses itself.

Null, empty and letterless texts go in the first stage, as no language is seen
in them. A null id, lang or source is a value like others: a row without an id
is known by its text. Of rows tied in a dedup stage one stays, by the rules of
that operator, and of rows that are the same in all columns one. Texts of any
length are whole throughout. Without any labelled language the first stage keeps
nothing, and a stage of an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadastra.llm import exact_dedup, jaccard_join, language_id, mixing, sentencepiece_sampling
from cadastra.llm.common import documents, stored


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_sampling.encode_samples(docs, k=2)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Learned models, sampled paths and rounding by dual multipliers have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"pipeline-{name}")
    return docs
