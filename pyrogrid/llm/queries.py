"""Registered queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyrogrid.llm import (
    byte_bpe, exact_dedup, filter_audit, gated_lm, language_id, packing, periodic_runs, quality, simhash, spot_signatures, substring_dedup, surrogates, token_store,
)
from pyrogrid.llm.common import documents, texts_of

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.against_edits(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts_of(documents(spark, sf_dir)), WORD_FILE)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(documents(spark, sf_dir))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(texts_of(documents(spark, sf_dir)), WORD_FILE)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.spans(documents(spark, sf_dir))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(documents(spark, sf_dir))


def op12_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.scored(documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spot_signatures, op2_exact_dedup, op3_byte_bpe, op4_simhash, op5_packing, op6_quality, op7_language, op8_token_store,
        op9_substring_dedup, op10_surrogates, op11_periodic_runs, op12_gated_lm, op13_filter_audit, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op13_filter_audit": filter_audit.audit_sql(),
    "op1_spot_signatures": spot_signatures.edits_sql(),
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
}
