"""Queries of block formats, model files, media coders and the piece tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from bitloom.functions import media, pieces
from bitloom.functions import text as T
from bitloom.functions.blocks import decode_segments, quantize_q8
from bitloom.plans.registry import query
from bitloom.sources import gguf
from bitloom.sources.tables import table, vectors

_LONG = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings)"
_Q8 = "least(127, greatest(-127, CASE WHEN v * 64 - floor(v * 64) = 0.5 THEN 2 * round(v * 32) ELSE round(v * 64) END)) / 64.0::DOUBLE"


def _files(spark, d):
    """One small model file for each vector: a block-quantized tensor and a plain one, with metadata."""
    import numpy as np

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [
                gguf.dump(
                    {"general.name": f"m{i}", "llama.block_count": 1, "tokenizer.ggml.tokens": ["<s>", "a"]},
                    [(f"blk.{i % 22}.ffn_up.weight", "q8_0", [64], quantize_q8(np.array(v), 1 / 64)), ("output_norm.weight", "f32", [4], np.array(v[:4], "<f4").tobytes())],
                )
                for i, v in zip(ids, x)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([f"m-{i}.gguf" for i in ids]), pa.array(made, pa.binary())], names=["path", "content"])

    return vectors(spark, d).select("vec_id", "x").mapInArrow(run, "path string, content binary")


@query("gguf_segments", """
    SELECT 'm-' || vec_id || '.gguf' AS path, name, kind, layer, bytes FROM embeddings, LATERAL (SELECT 'blk.' || vec_id % 22 || '.ffn_up.weight' AS name, 'FEED_FORWARD_WEIGHTS' AS kind, CAST(vec_id % 22 AS BIGINT) AS layer, CAST(68 AS BIGINT) AS bytes
    UNION ALL SELECT 'output_norm.weight', 'LAYER_NORM_WEIGHTS', 0, 16 UNION ALL SELECT 'tokenizer_vocab', 'TOKENIZER_VOCAB', 0, 5)""")
def gguf_segments(spark, d):
    """Segments of model files with kinds and layers."""
    s = gguf.with_kinds(gguf.tensors_of(_files(spark, d))).filter(~F.col("name").isin("gguf_metadata", "gguf_config", "tokenizer_model"))
    return s.select("path", "name", "kind", F.col("layer_index").alias("layer"), F.octet_length("data").cast("long").alias("bytes"))


@query("gguf_decode", f"WITH {_LONG} SELECT 'm-' || vec_id || '.gguf' AS path, i, {_Q8} + 0.0 AS v FROM v")
def gguf_decode(spark, d):
    """Values of the block-quantized tensors."""
    s = gguf.tensors_of(_files(spark, d)).filter("data_format = 'q8_0'").select(F.col("path").alias("name"), "data_format", "data")
    return decode_segments(s).select(F.col("name").alias("path"), F.posexplode("x").alias("i", "v")).select("path", F.col("i").cast("long").alias("i"), (F.col("v").cast("double") + 0.0).alias("v"))


@query("gzip_segments", "SELECT item_id, octet_length(encode(text)) AS original, true AS same FROM benchmark")
def gzip_segments(spark, d):
    """Segments through gzip and back; sizes differ between compressors, contents do not."""
    return table(spark, d, "benchmark").select("item_id", F.octet_length("text").cast("long").alias("original"), media.gzip_same(F.col("text").cast("binary")).alias("same"))


@query("dct_top10", f"""WITH {_LONG}, o AS (SELECT p, q, CASE WHEN p = 0 THEN sqrt(1.0/8) ELSE sqrt(2.0/8) END * CASE WHEN q = 0 THEN sqrt(1.0/8) ELSE sqrt(2.0/8) END AS a FROM (SELECT unnest(range(8)) AS p), (SELECT unnest(range(8)) AS q)),
    c AS (SELECT vec_id, p * 8 + q AS idx, a * sum(v * cos(pi() * (2 * (i // 8) + 1) * p / 16) * cos(pi() * (2 * (i % 8) + 1) * q / 16)) AS c FROM v, o GROUP BY vec_id, p, q, a)
    SELECT vec_id, CAST(idx AS INT) AS idx, round(c, 5) + 0.0 AS c FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(round(c, 8)) DESC, idx) <= 10""")
def dct_top10(spark, d):
    """The ten strongest cosine coefficients of 8 x 8 blocks."""
    c = vectors(spark, d).select("vec_id", F.explode(media.dct_codes("x")).alias("c"))
    return c.select("vec_id", "c.idx", (F.round("c.c", 5) + 0.0).alias("c"))


@query("audio_spectrum", f"WITH {_LONG} SELECT vec_id, k, round(sqrt(pow(sum(v * cos(2 * pi() * i * k / 64)), 2) + pow(sum(v * sin(2 * pi() * i * k / 64)), 2)), 5) AS size FROM v, (SELECT CAST(unnest(range(33)) AS BIGINT) AS k) GROUP BY vec_id, k")
def audio_spectrum(spark, d):
    """Fourier magnitudes of vectors as audio."""
    s = vectors(spark, d).select("vec_id", F.posexplode(media.spectrum("x")).alias("k", "size"))
    return s.select("vec_id", F.col("k").cast("long").alias("k"), F.round("size", 5).alias("size"))


@query("image_formats", "SELECT item_id, ['png', 'jpeg', 'bmp', 'unknown'][item_id % 4 + 1] AS format FROM benchmark")
def image_formats(spark, d):
    """Image formats by their first bytes."""
    head = F.get(F.array(*(F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A", "FFD8FFE0", "424D", "00"))), (F.col("item_id") % 4).cast("int"))
    return table(spark, d, "benchmark").select("item_id", media.image_format(F.concat(head, F.col("text").cast("binary"))).alias("format"))


@query("video_coders")
def video_coders(spark, d):
    """Sizes of dictionary, marked-run and pixel-run codes of texts as bytes; each must give the bytes back."""
    return table(spark, d, "conversations").select("conv_id", "turn", media.video_sizes(F.col("text").cast("binary")).alias("s")).select("conv_id", "turn", "s.*")


_PIECES = ["<unk>", "<s>", "</s>", "\n", *(f"<0x{b:02X}>" for b in range(256)), "▁", "▁t", "▁a", "th", "the", "▁the", "er", "on", "an", "in", "en", "▁d", "▁e", "ing", "tion", *"abcdefghijklmnopqrstuvwxyz"]


@query("piece_tokens")
def piece_tokens(spark, d):
    """Greedy longest-match ids of conversation turns (tested against brute force and by decoding)."""
    return table(spark, d, "conversations").select("conv_id", "turn", pieces.encode_column(_PIECES, F.col("text")).alias("ids"))


@query("byte_tokens", "SELECT item_id, CAST(greatest(1, octet_length(encode(text))) AS BIGINT) AS n, CAST(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS INT))) AS BIGINT) AS total FROM benchmark")
def byte_tokens(spark, d):
    """One id a byte, where there is no vocabulary."""
    ids = pieces.encode_column([], F.col("text"))
    t = table(spark, d, "benchmark").select("item_id", ids.alias("ids"))
    return t.select("item_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKEN_SQL = T.TOKEN.replace("'", "''")


@query("vocab_fallback", f"""
    WITH known AS (SELECT DISTINCT unnest(regexp_extract_all({_LOW}, '[a-z0-9]+')) AS tok FROM benchmark),
    t AS (SELECT conv_id, turn, unnest(regexp_extract_all({_LOW}, '{_TOKEN_SQL}')) AS tok FROM conversations)
    SELECT conv_id, turn, count(*) AS tokens, count(known.tok) AS in_vocabulary, CAST(sum(CASE WHEN known.tok IS NOT NULL THEN 1 ELSE octet_length(encode(t.tok)) END) AS BIGINT) AS ids FROM t LEFT JOIN known ON known.tok = t.tok GROUP BY conv_id, turn""")
def vocab_fallback(spark, d):
    """Ids of turns with the benchmark's words as vocabulary: one for a known word, one a byte otherwise."""
    known = table(spark, d, "benchmark").select(F.explode(T.words(F.col("text"))).alias("tok")).distinct().withColumn("known", F.lit(1))
    t = table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.tokens(F.col("text"))).alias("tok"))
    counted = t.groupBy("conv_id", "turn", "tok").agg(F.count(F.lit(1)).alias("n")).join(known, "tok", "left")
    ids = F.when(F.col("known") == 1, F.col("n")).otherwise(F.col("n") * F.octet_length("tok"))
    return counted.groupBy("conv_id", "turn").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)).alias("in_vocabulary"), F.sum(ids).alias("ids"))
