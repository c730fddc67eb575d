"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import oracles
from folio.llm.chat import format_chats
from folio.llm.ctw import lm_scores
from folio.llm.decontaminate import contaminated
from folio.llm.exact_dedup import exact_groups
from folio.llm.hard_negatives import hard_negatives
from folio.llm.line_dedup import line_report
from folio.llm.minhash import minhash_classes
from folio.llm.mixing import mix_sources
from folio.llm.quality import quality_scores
from folio.llm.simhash import simhash_classes
from folio.llm.token_counts import token_counts
from folio.llm.vector_codes import vector_codes
from folio.llm.warc import write_and_read

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(_table(spark, sf_dir, "documents"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = write_and_read(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    return hard_negatives(_table(spark, sf_dir, "embeddings"), vec_id % 50 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_token_counts,
    op2_simhash,
    op3_lm_scores,
    op4_warc,
    op5_mix,
    op6_exact_dedup,
    op7_decontaminate,
    op8_chat_format,
    op9_quality,
    op10_line_dedup,
    op11_vector_codes,
    op12_hard_negatives,
    op13_minhash,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            w AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
                         max(page_id) OVER (PARTITION BY body) AS top FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
            FROM w""",
        "op6_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
            SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
            FROM n""",
        "op11_vector_codes": oracles.VECTOR_CODES,
        "op12_hard_negatives": oracles.HARD_NEGATIVES,
        "op13_minhash": oracles.MINHASH,
    }
