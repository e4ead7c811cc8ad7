"""The registered queries of the numbered operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from festa.llm import chat, exact_dedup, fingerprint, html_extract, langid, licenses, merkle, mixing, near_dedup, packing, quality, sharding, whitening
from festa.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(chat.probe_conversation(spark))))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.read_back(sharding.shard_documents(table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def packing_under_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_under_capacities(table(spark, sf_dir, "documents"))


def op7_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_language_id": op2_language_id,
    "op3_fingerprints": op3_fingerprints,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_sharding": op5_sharding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_entropy_mixing": op7_entropy_mixing,
    "op8_order_minhash": op8_order_minhash,
    "op9_html_extraction": op9_html_extraction,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_license_scan": op12_license_scan,
    "op13_merkle_manifest": op13_merkle_manifest,
    "packing_under_capacities": packing_under_capacities,
}

ORACLE_SQL: dict[str, str] = {
    "op5_sharding": """
        SELECT doc_id, lang, source, length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER w AS keep_id, first_value(n_chars) OVER w AS keep_chars
            FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size,
               doc_id IS NOT DISTINCT FROM keep_id AND n_chars = keep_chars AS kept, text_sha256, n_chars FROM g
    """,
    "op12_license_scan": licenses.oracle_sql(),
    "op13_merkle_manifest": merkle.oracle_sql(),
}
