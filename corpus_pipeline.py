"""From raw documents to packed training sequences in five stages.

Every stage takes all rows that the one before kept and its decisions take effect. All but the last
return the columns of ``documents``, whatever their names; mixing returns a document as often as the mix
takes it. Null and empty texts go in the first stage, as do those without letters; a null doc_id is larger
than any other; of rows that repeat one stays; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, language_crf, mixing, packing, simhash
from tessella.session import table
from tessella.staging import stage_result, unstage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: null, without letters, or with no language in even 0.3 of them."""
    return language_crf.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the one with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The stages train, draw and search; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged before the next reads it and deleted when that is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stage_result(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
