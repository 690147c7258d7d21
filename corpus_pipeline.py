"""From raw documents to a training mix, in five stages.

Each stage takes the documents that the one before it kept, as a table in the
shared folder, and returns those it keeps; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import cut, drop_cut, table
from scriptorium.llm.decontam import decontaminate
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.langid import keep_identified
from scriptorium.llm.mixing import mix
from scriptorium.llm.simhash import near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language, among them those without a letter."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are similar by 0.8 or more the smallest doc_id stays."""
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, word for word or with other values."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, finish and taken of what is taken, in order."""
    return mix(docs).filter("taken > 0")


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("mixture", mixture)]

#: Trained and fingerprinting stages are not SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir))
        drop_cut(docs)  # its successor is written, so two copies of the texts exist at most
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
