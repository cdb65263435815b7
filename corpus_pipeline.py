"""A training-corpus pipeline over `documents`: each stage works on all that its predecessor kept.

Toxic documents go, of equal texts one stays, of each SimHash component one stays, secrets are masked in the text, and
the rest is packed into token sequences.

Defined results: a null text counts as empty, is not toxic, and of all empty texts one stays; rows are decided each by
their own text, so that rows which share a doc_id, or have none, stay where their texts differ, and of rows equal in
both one stays; texts of any length are read whole; columns beyond those of documents are carried to the last stage,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import dedup, packing, secrets, simhash, toxicity
from bitloom.llm.common import keep_ids, materialise


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    field = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, field)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document that the digest index keeps."""
    decisions = dedup.exact_dedup(docs)
    return keep_ids(docs, decisions.select("doc_id", "kept", F.col("text_sha256").alias("key")), F.sha2(dedup.normalised(), 256))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, the document with the smallest doc_id."""
    return simhash.keep_first(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the field's scores nor the packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return stage_result(spark, docs, sf_dir)


def stage_result(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    return STAGES[-1][1](spark, docs, sf_dir)
