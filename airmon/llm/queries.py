"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from airmon.llm import conversations, decontam, langid, linktrust, lmscore, merkle, mixing, pii, repeats, secret_scan, simhash, syncmers, toxicity
from airmon.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op9_benchmark_decontamination"] = r"""
WITH
words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark),
grams AS (
    SELECT kind, id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g
    FROM words WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n AS item_shingles, count(*) AS shared, count(*) / n AS containment
FROM grams d JOIN grams i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id, n
HAVING count(*) >= 0.8 * n - 1e-9
"""


@query
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op7_source_mixing"] = mixing.ORACLE.replace("{docs}", "documents")


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linktrust.judge(table(spark, sf_dir, "pages"))


ORACLES["op11_url_filter"] = linktrust.ORACLE


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = merkle.check(docs.withColumn("text_now", merkle.tampered_text()))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLES["op12_merkle_manifest"] = merkle.ORACLE


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    audits, turns = conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))
    sums = conversations.digests(turns).withColumnRenamed("conv_id", "of")
    return audits.join(sums, audits["conv_id"].eqNullSafe(sums["of"])).drop("of")


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
