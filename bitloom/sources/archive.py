"""Segment archives: an index table and a payload table, written in bulk or as a stream.

An archive is a folder with two Parquet tables: `index` (a row per segment, without payload) and `payload` (segment name and
coded bytes, dealt by kind). Reading the index touches no payload; reading one segment filters by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Strategy numbers.
RAW, ADAPTIVE, RLE, GZIP, QUANT, HIERARCHICAL = 0, 1, 2, 3, 4, 5

_WEIGHTS = ("ATTENTION_WEIGHTS", "FEED_FORWARD_WEIGHTS", "EMBEDDING_WEIGHTS", "LAYER_NORM_WEIGHTS")
_TEXTS = ("CONFIG", "TOKENIZER_VOCAB", "TOKENIZER_MODEL")
#: (segment kind, priority, strategy), all options switched on. Fixed values.
REGISTERED = (
    *((k, 1, ADAPTIVE) for k in ("METADATA_JSON", "GRAPH_STRUCTURE_PROTO", *_TEXTS)),
    ("SPARSE_INDICES", 2, ADAPTIVE),
    *((k, 1, HIERARCHICAL) for k in ("WEIGHTS_FP32", *_WEIGHTS)),
    *((k, 2, QUANT) for k in ("WEIGHTS_FP32", *_WEIGHTS)),
    *((k, 3, RLE) for k in ("WEIGHTS_INT8", "WEIGHTS_INT4")),
    *((k, 4, GZIP) for k in ("WEIGHTS_FP32", "WEIGHTS_FP16", "WEIGHTS_INT8", "WEIGHTS_INT4", *_WEIGHTS, *_TEXTS)),
)
#: Segment kinds that hold weights.
WEIGHT_KINDS = ("WEIGHTS_FP32", "WEIGHTS_FP16", "WEIGHTS_INT8", "WEIGHTS_INT4", *_WEIGHTS)


def offsets(df: DataFrame, bucket: Column, order: str, size: str) -> DataFrame:
    """Adds `place`: the sum of the sizes before a row in `order`. `bucket` never falls along that order; only bucket sums
    pass through one task."""
    held = df.withColumn("_bucket", bucket)
    totals = held.groupBy("_bucket").agg(F.sum(size).alias("_n"))
    starts = totals.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).alias("_start"))
    within = F.sum(size).over(W.partitionBy("_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col(size)
    return held.withColumn("_within", within).join(starts, "_bucket").withColumn("place", F.col("_start") + F.col("_within")).drop("_bucket", "_within", "_start")


def skipped(segments: DataFrame, skip: Column) -> DataFrame:
    """Kept and dropped segments and dropped bytes by kind."""
    out = F.coalesce(skip, F.lit(False))
    return segments.groupBy("kind").agg(
        F.count(F.when(~out, 1)).alias("kept"), F.count(F.when(out, 1)).alias("dropped"), F.coalesce(F.sum(F.when(out, F.col("original_size"))), F.lit(0)).cast("long").alias("dropped_bytes")
    )


def write(segments: DataFrame, path: str, skip: Column | None = None, mode: str = "overwrite", compress: bool = True) -> None:
    """Writes segments (name, kind, data binary, and any further index columns) as an archive.

    Each payload is coded by the first strategy of its kind that applies (or stored raw) and dealt into a folder by kind;
    the index holds original and stored sizes, the strategy, and a digest of the stored bytes.
    """
    from bitloom.operators import coding

    kept = segments if skip is None else segments.filter(~F.coalesce(skip, F.lit(False)))
    rest = [c for c in segments.columns if c != "data"]
    if compress:
        coded = coding.compress(kept)
    else:
        coded = kept.withColumn("strategy", F.lit(RAW)).withColumn("original_size", F.octet_length("data").cast("long"))
    # Coded once: the index is made from the payload that was written.
    coded.write.mode(mode).partitionBy("kind").parquet(f"{path}/payload")
    stored = segments.sparkSession.read.parquet(f"{path}/payload")
    stored.select(*rest, "strategy", "original_size", F.octet_length("data").cast("long").alias("stored_size"), F.sha2("data", 256).alias("sha256")).write.mode("overwrite").parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index alone."""
    return spark.read.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, names: list[str] | None = None, kinds: list[str] | None = None, raw: bool = False) -> DataFrame:
    """name, data, kind; names and kinds are pushed down to the payload scan. A name that is missing is an error.

    Payloads are decoded by the strategy that coded them; raw: as they are stored, with their strategy.
    """
    from bitloom.operators import coding

    payload = spark.read.parquet(f"{path}/payload")
    if kinds is not None:
        payload = payload.filter(F.col("kind").isin(kinds))
    if names is not None:
        payload = payload.filter(F.col("name").isin(names))
        there = {r["name"] for r in read_index(spark, path).filter(F.col("name").isin(names)).select("name").collect()}
        if missing := set(names) - there:
            raise KeyError(f"no such segment: {', '.join(sorted(missing))}")
    stored = payload.select("name", "data", "kind", "strategy", "original_size") if "strategy" in payload.columns else payload.select("name", "data", "kind")
    return stored if raw or "strategy" not in stored.columns else coding.decompress(stored)


def extract(spark: SparkSession, path: str, to: str) -> None:
    """One folder for each segment kind."""
    read(spark, path).write.mode("overwrite").partitionBy("kind", "name").parquet(to)


def stream_to(segments: DataFrame, path: str, checkpoint: str):
    """A streaming sink: each batch is coded as in write() and appends payload and index. Returns the started query.

    A batch that is run again replaces what it wrote: batches have folders of their own.
    """
    from bitloom.operators import coding

    def append(batch: DataFrame, number: int) -> None:
        at = f"{path}/payload/batch={number}"
        coding.compress(batch).write.mode("overwrite").parquet(at)
        stored = batch.sparkSession.read.parquet(at)
        rest = [c for c in batch.columns if c != "data"]
        stored.select(*rest, "strategy", "original_size", F.octet_length("data").cast("long").alias("stored_size"), F.sha2("data", 256).alias("sha256")).write.mode("overwrite").parquet(f"{path}/index/batch={number}")

    return segments.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
