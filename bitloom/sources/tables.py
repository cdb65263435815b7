"""Table loaders and long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the embedding as doubles (column `x`)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def long_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, i (from 0), v."""
    return vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
