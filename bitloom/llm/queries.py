"""Registered queries of the training-data operators, with DuckDB SQL where SQL expresses the whole result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from bitloom.llm import bpe, dedup, licenses, media, packing, pii, secrets, simhash, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(_documents(spark, sf_dir))


@_query("op2_pii_spans")
def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_documents(spark, sf_dir))


@_query("op3_bpe_tokens")
def op3_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir))


@_query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


@_query("op5_media_column")
def op5_media_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_documents(spark, sf_dir))


@_query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_documents(spark, sf_dir))


@_query("op7_url_filter")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query("op8_toxicity_crf")
def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_query(
    "op9_exact_dedup",
    r"""
    WITH each AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    ), best AS (
        SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size
        FROM each
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_documents(spark, sf_dir))


@_query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir), cache_words=600_000)


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
