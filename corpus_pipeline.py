"""The training-data pipeline: five stages over documents, each the operator of that number at work.

Every function takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents, whatever columns those are.

Null texts: rejected by the first stage, which keeps what has letters of a learned language.  Of repeated rows
and near copies one row stays.  An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airmon.llm import decontam, langid, mixing, pii, simhash
from airmon.llm.base import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents written in a learned language."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest doc_id, of each group of fingerprints linked at four or fewer differing bits."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain an item of the benchmark."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters the mix of sources: doc_id, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language), ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate), ("pii", redact), ("source_mixing", mix),
]

#: The stages learn models and compare signatures, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
