"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, chunk_store, context_mixing, decontamination, exact_dedup, golden_records, jaccard_join, language_id, licenses, packing, quality, secrets, vector_codes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.read_store(chunk_store.write_store(_docs(spark, sf_dir)))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(_docs(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_docs(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(_docs(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_docs(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir)).drop("ids")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_docs(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_records.golden(spark.read.parquet(f"{sf_dir}/clients.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chunk_store": op1_chunk_store,
    "op2_context_mixing": op2_context_mixing,
    "op3_secrets": op3_secrets,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_quality": op11_quality,
    "op12_golden_records": op12_golden_records,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g ON d.norm = g.norm
""",
    "op12_golden_records": golden_records.ORACLE,
    "op13_vector_codes": vector_codes.oracle_sql(),
}
