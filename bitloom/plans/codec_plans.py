"""Queries of the codecs: runs, deltas, top-k, quantization, reconstruction, and the archive's bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.operators import codecs as C
from bitloom.operators import coding
from bitloom.plans.registry import query
from bitloom.sources import archive
from bitloom.sources.tables import long_vectors, table

_LONG = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i FROM embeddings)"
_TRUNC = "CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END"

_RUNS = """
    e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    g AS (SELECT *, r - row_number() OVER (PARTITION BY user_id, event_type ORDER BY r) AS island FROM e),
    runs AS (SELECT user_id, event_type AS value, min(r) - 1 AS start, count(*) AS run FROM g GROUP BY user_id, event_type, island)"""


@query("rle_runs", f"WITH {_RUNS} SELECT user_id, value, start, run FROM runs")
def rle_runs(spark, d):
    """Runs of equal event types in each user's order of time."""
    e = table(spark, d, "events")
    return C.runs(e, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", F.date_trunc("month", F.col("ts")))


@query("rle_runs_255", """
    WITH e AS (SELECT l_returnflag AS flag, CAST(l_quantity >= 25 AS INT) AS bit, l_linenumber AS p, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_quantity, l_orderkey) AS r FROM lineitem),
    g AS (SELECT *, r - row_number() OVER (PARTITION BY flag, p, bit ORDER BY r) AS island FROM e),
    runs AS (SELECT flag, p, bit AS value, min(r) - 1 AS start, count(*) AS run FROM g GROUP BY flag, p, bit, island)
    SELECT flag, p, CAST(value AS INT) AS value, start + 255 * k AS start, least(255, run - 255 * k) AS run FROM (SELECT *, unnest(range(0, (run + 254) // 255)) AS k FROM runs)""")
def rle_runs_255(spark, d):
    """Byte runs are stored with at most 255 repeats each. Buckets hold a quantity and 2^20 order keys, so that they grow in
    number with the orders and not in size."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("p"), (F.col("l_quantity") >= 25).cast("int").alias("bit"), "l_quantity", "l_orderkey")
    return C.split_runs(C.runs(rows, ["flag", "p"], [F.col("l_quantity"), F.col("l_orderkey")], "bit", F.struct("l_quantity", F.shiftright("l_orderkey", 20).alias("k"))))


@query("rle_decode", f"WITH {_RUNS} SELECT user_id, value, start + k AS place FROM (SELECT *, unnest(range(0, run)) AS k FROM runs)")
def rle_decode(spark, d):
    """The values that the runs stand for."""
    return C.expand_runs(rle_runs(spark, d)).select("user_id", "value", "place")


_VARINT = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


@query("delta_varint_size", f"""
    WITH t AS (SELECT DISTINCT user_id, event_id AS pos FROM events),
    dl AS (SELECT user_id, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY user_id ORDER BY pos) AS delta FROM t)
    SELECT user_id, count(*) AS n, CAST(sum({_VARINT.format("delta")}) AS BIGINT) AS delta_bytes, CAST(sum({_VARINT.format("pos")}) AS BIGINT) AS direct_bytes FROM dl GROUP BY user_id""")
def delta_varint_size(spark, d):
    """Bytes of each user's sorted event numbers, as differences and directly."""
    deltas = C.deltas(table(spark, d, "events").select("user_id", F.col("event_id").alias("pos")).distinct(), ["user_id"], "pos")
    return deltas.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(C.varint_bytes(F.col("delta"))).alias("delta_bytes"), F.sum(C.varint_bytes(F.col("pos"))).alias("direct_bytes"))


@query("delta_decode", "SELECT DISTINCT user_id, event_id AS pos FROM events")
def delta_decode(spark, d):
    """Positions restored by running sums of the differences."""
    deltas = C.deltas(table(spark, d, "events").select("user_id", F.col("event_id").alias("pos")).distinct(), ["user_id"], "pos")
    numbered = C.ranks(deltas, ["user_id"], [F.col("pos")], F.floor(F.col("pos") / (1 << 20)), "ordinal")
    stored = numbered.select("user_id", "delta", "ordinal")  # what a file of differences holds
    return C.undelta(stored, ["user_id"], "ordinal").select("user_id", "pos")


@query("varint_bytes", f"""
    WITH t AS (SELECT DISTINCT user_id, event_id AS pos FROM events),
    dl AS (SELECT user_id, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY user_id ORDER BY pos) AS delta FROM t)
    SELECT user_id, pos, {"||".join(f"CASE WHEN delta >= {1 << 7 * k if k else 0} THEN printf('%02X', (delta >> {7 * k}) & 127 | CASE WHEN delta >= {1 << 7 * (k + 1)} THEN 128 ELSE 0 END) ELSE '' END" for k in range(5))} AS coded, delta AS decoded FROM dl""")
def varint_bytes(spark, d):
    """The bytes of each difference of a user's sorted event numbers, and what they decode to."""
    deltas = C.deltas(table(spark, d, "events").select("user_id", F.col("event_id").alias("pos")).distinct(), ["user_id"], "pos")
    coded = deltas.select("user_id", "pos", C.varint(F.col("delta")).alias("b"))
    return coded.select("user_id", "pos", F.hex("b").alias("coded"), C.from_varint(F.col("b")).alias("decoded"))


_TOP = f"{_LONG}, top AS (SELECT vec_id, i, v FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) <= 6)"


@query("topk_sparsify", f"WITH {_TOP} SELECT vec_id, i, round(v, 6) AS v FROM top")
def topk_sparsify(spark, d):
    """A tenth of each vector's entries, largest first."""
    kept = C.top_k(C.packed(spark, d), C.active_count(F.lit(64), 0.10))
    return kept.select("vec_id", F.explode("kept").alias("e")).select("vec_id", "e.i", F.round("e.v", 6).alias("v"))


@query("topk_counts", """
    SELECT n, s, CAST(least(greatest(1, floor(n * s)), CASE WHEN s >= 0.1 THEN CASE WHEN n > 10000000 THEN least(greatest(1, floor(n * s)), 1000000) WHEN n > 1000000 THEN least(greatest(1, floor(n * s)), 500000) ELSE greatest(1, floor(n * s)) END
        ELSE floor(CASE WHEN n > 10000000 THEN 10000 WHEN n > 1000000 THEN 5000 ELSE 2000 END * greatest(0.25, 1 + s * 8)) END) AS BIGINT) AS k
    FROM (SELECT DISTINCT CAST(p_size * p_size * p_size * 1000 AS BIGINT) AS n FROM part), (SELECT unnest([0.015625, 0.0625, 0.125, 0.5])::DOUBLE AS s)""")
def topk_counts(spark, d):
    """How many entries stay for tensors of several sizes and sparsities."""
    n = table(spark, d, "part").select((F.col("p_size").cast("long") * F.col("p_size") * F.col("p_size") * 1000).alias("n")).distinct()
    each = n.select("n", F.explode(F.array(*map(F.lit, (0.015625, 0.0625, 0.125, 0.5)))).alias("s"))
    return each.select("n", "s", C.active_count(F.col("n"), F.col("s")).alias("k"))


@query("uniform_select", f"WITH {_LONG} SELECT vec_id, i, round(v, 6) AS v FROM v WHERE i % 10 = 0 AND i // 10 < 6")
def uniform_select(spark, d):
    """Every tenth entry, as types without magnitudes are sampled."""
    return C.uniform(long_vectors(spark, d), 64, 6).select("vec_id", "i", F.round("v", 6).alias("v"))


_IV = f"""{_TOP}, r AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM top GROUP BY vec_id),
    q AS (SELECT vec_id, i, v, lo, CASE WHEN hi > lo THEN (hi - lo) / 65535 ELSE 1 END AS scale, floor((v - lo) / CASE WHEN hi > lo THEN (hi - lo) / 65535 ELSE 1 END) AS q FROM top JOIN r USING (vec_id))"""


@query("index_value_roundtrip", f"WITH {_IV} SELECT vec_id, i, round(q * scale + lo, 4) AS restored, abs(q * scale + lo - v) <= scale * 1.001 AS within FROM q")
def index_value_roundtrip(spark, d):
    """Kept entries coded with 16 bits between the vector's extremes, and restored."""
    coded = C.index_values(C.top_k(C.packed(spark, d), F.lit(6))).select("vec_id", "lo", "scale", F.explode("coded").alias("e"))
    back = F.col("e.q") * F.col("scale") + F.col("lo")
    return coded.select("vec_id", "e.i", F.round(back, 4).alias("restored"), (F.abs(back - F.col("e.v")) <= F.col("scale") * 1.001).alias("within"))


@query("index_value_dense", f"""WITH {_IV} SELECT v.vec_id, v.i, round(coalesce(q.q * q.scale + q.lo, 0.0), 4) + 0.0 AS restored FROM v LEFT JOIN q ON q.vec_id = v.vec_id AND q.i = v.i""")
def index_value_dense(spark, d):
    """The dense vectors of the coded entries, zeros elsewhere."""
    coded = C.index_values(C.top_k(C.packed(spark, d), F.lit(6)))
    kept = coded.select("vec_id", F.transform("coded", lambda e: F.struct(e["i"].alias("i"), (e["q"] * F.col("scale") + F.col("lo")).alias("v"))).alias("kept"))
    dense = C.densify(kept, F.lit(64))
    return dense.select("vec_id", F.posexplode("dense").alias("i", "r")).select("vec_id", F.col("i").cast("long").alias("i"), (F.round("r", 4) + 0.0).alias("restored"))


@query("format_flag", """
    SELECT user_id, n, CASE WHEN n > 100000 THEN 144 WHEN n > 10000 THEN 136 WHEN n > 2000 THEN 208 ELSE 15 END AS flag FROM (SELECT user_id % 7 AS user_id, count(*) * 40 AS n FROM events GROUP BY 1)""")
def format_flag(spark, d):
    """The tag byte of an index list by its length."""
    n = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("user_id")).agg((F.count(F.lit(1)) * 40).alias("n"))
    return n.select("user_id", "n", C.format_flag(F.col("n")).alias("flag"))


@query("codec_accepts", """
    SELECT doc_id, CASE WHEN s >= 0.1 THEN 2.0 WHEN n < 1024 THEN 1.2 ELSE 1.0 END::DOUBLE AS threshold, c <= n * CASE WHEN s >= 0.1 THEN 2.0 WHEN n < 1024 THEN 1.2 ELSE 1.0 END AS accepted
    FROM (SELECT doc_id, octet_length(encode(text)) AS n, octet_length(encode(text)) * (80 + doc_id % 60) // 100 AS c, CASE WHEN doc_id % 5 = 0 THEN 0.2 ELSE 0.02 END AS s FROM documents)""")
def codec_accepts(spark, d):
    """Whether a coded size passes the threshold that its original size and sparsity set."""
    n = F.octet_length("text").cast("long")
    s = F.when(F.col("doc_id") % 5 == 0, 0.2).otherwise(0.02)
    docs = table(spark, d, "documents").select("doc_id", n.alias("n"), F.floor(n * (80 + F.col("doc_id") % 60) / 100).alias("c"), s.alias("s"))
    limit = C.size_limit(F.col("n"), F.col("s"))
    return docs.select("doc_id", limit.alias("threshold"), (F.col("c") <= F.col("n") * limit).alias("accepted"))


@query("adaptive_choice", """
    SELECT doc_id, CASE WHEN n <= 1024 OR kind IN ('TOKENIZER_VOCAB', 'TOKENIZER_MODEL') THEN 'direct' WHEN kind IN ('METADATA_JSON', 'METADATA_TOML', 'CONFIG', 'GRAPH_STRUCTURE_PROTO') THEN 'metadata' ELSE 'tensor' END AS choice
    FROM (SELECT doc_id, octet_length(encode(text)) AS n, ['METADATA_JSON', 'CONFIG', 'WEIGHTS_FP32', 'TOKENIZER_VOCAB', 'SPARSE_INDICES'][doc_id % 5 + 1] AS kind FROM documents)""")
def adaptive_choice(spark, d):
    """Which coder the adaptive strategy takes for segments made of documents."""
    return _segments(spark, d).select("doc_id", C.adaptive_choice(F.col("kind"), F.col("original_size")).alias("choice"))


@query("metadata_bits", """
    WITH c AS (SELECT item_id, length(text) AS n, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM benchmark),
    b AS (SELECT item_id, n, i * 4 + j AS o, ((ascii(ch) * 31 + i) * 17 + j * 257) % 10000 AS pos FROM c, (SELECT unnest(range(4)) AS j) WHERE ch <> ''),
    f AS (SELECT item_id, n, pos, min(o) AS o FROM b GROUP BY ALL)
    SELECT item_id, CAST(pos AS BIGINT) AS pos FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY o) <= greatest(1, floor(8 * n * 0.0625))""")
def metadata_bits(spark, d):
    """Four hashed positions of each character, first come first kept."""
    return C.metadata_bits(table(spark, d, "benchmark"), "item_id", "text", width=10000, sparsity=0.0625)


@query("byte_checksum", "SELECT item_id, CAST(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS INT))) AS BIGINT) AS checksum FROM benchmark")
def byte_checksum(spark, d):
    """Sum of the bytes of a text."""
    return table(spark, d, "benchmark").select("item_id", C.checksum(F.col("text")).alias("checksum"))


@query("sha256_digest", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def sha256_digest(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_ABS = f"{_LONG}, s AS (SELECT vec_id, max(abs(v)) AS a, min(v) AS lo, max(v) AS hi FROM v GROUP BY vec_id)"
_HALF_UP = "CASE WHEN {0} < 0 THEN -floor(-({0}) + 0.5) ELSE floor({0} + 0.5) END"


def _quant(name, bits, doc):
    top = 2 ** (bits - 1) - 1

    @query(name, f"""WITH {_ABS} SELECT vec_id, i, CAST({_HALF_UP.format(f"(v / (CASE WHEN a > 0 THEN a / {top} ELSE 1 END))")} AS INT) AS q FROM v JOIN s USING (vec_id)""")
    def build(spark, d):
        return C.explode_codes(C.quantize_symmetric(C.packed(spark, d), bits))

    build.__doc__ = doc


_quant("quant8_sym", 8, "Symmetric 8-bit codes of each vector.")
_quant("quant4_sym", 4, "Symmetric 4-bit codes of each vector.")


@query("quant8_asym", f"""WITH {_ABS} SELECT vec_id, i, CAST({_HALF_UP.format("((v - lo) / (CASE WHEN hi > lo THEN (hi - lo) / 255 ELSE 1 END))")} AS INT) AS q FROM v JOIN s USING (vec_id)""")
def quant8_asym(spark, d):
    """Unsigned 8-bit codes between each vector's extremes."""
    return C.explode_codes(C.quantize_range(C.packed(spark, d), 8))


@query("quant_error", f"""WITH {_ABS}, q AS (SELECT vec_id, label, v, a / 127 AS scale, {_HALF_UP.format("(v / (a / 127))")} AS q FROM v JOIN s USING (vec_id))
    SELECT label, round(avg((v - q * scale) * (v - q * scale)), 9) AS mse, round(max(abs(v - q * scale)), 9) AS worst FROM q GROUP BY label""")
def quant_error(spark, d):
    """Errors of the 8-bit codes by label."""
    coded = C.quantize_symmetric(C.packed(spark, d), 8)
    e = coded.select("label", F.explode(F.zip_with("x", "q", lambda v, q: v - q * F.col("scale"))).alias("e"))
    return e.groupBy("label").agg(F.round(F.avg(F.col("e") * F.col("e")), 9).alias("mse"), F.round(F.max(F.abs("e")), 9).alias("worst"))


_INT8 = f"""{_LONG}, s AS (SELECT vec_id, CASE WHEN max(v) - min(v) < 1e-8 THEN 1 ELSE (max(v) - min(v)) / 255 END AS scale, min(v) AS lo FROM v GROUP BY vec_id),
    z AS (SELECT vec_id, scale, {_TRUNC.format("(-lo / scale)")} - 128 AS zp FROM s)"""


@query("quant8_affine", f"""WITH {_INT8} SELECT vec_id, i, CAST(least(127, greatest(-128, {_HALF_UP.format("(v / scale)")} + zp)) AS INT) AS q FROM v JOIN z USING (vec_id)""")
def quant8_affine(spark, d):
    """Signed 8-bit codes with a zero point, per vector (dynamic quantization)."""
    return C.explode_codes(C.quantize_affine(C.packed(spark, d)))


@query("quant8_per_channel", f"""
    WITH {_LONG}, s AS (SELECT i, max(abs(v)) AS a FROM v GROUP BY i)
    SELECT v.vec_id, v.i, CAST({_HALF_UP.format("(v.v / (CASE WHEN a > 0 THEN a / 127 ELSE 1 END))")} AS INT) AS q FROM v JOIN s USING (i)""")
def quant8_per_channel(spark, d):
    """8-bit codes with one scale for each dimension; the scales are one row per dimension."""
    v = long_vectors(spark, d)
    scale = v.groupBy("i").agg(F.max(F.abs("v")).alias("a"))
    return v.join(scale, "i").select("vec_id", "i", C.half_up(F.col("v") / F.when(F.col("a") > 0, F.col("a") / 127).otherwise(1.0)).cast("int").alias("q"))


_INT4 = f"""{_LONG}, s AS (SELECT vec_id, i // 16 AS g, CASE WHEN max(v) - min(v) < 1e-8 THEN 1 ELSE (max(v) - min(v)) / 15 END AS scale, min(v) AS lo FROM v GROUP BY ALL),
    z AS (SELECT vec_id, g, scale, least(7, greatest(-8, {_HALF_UP.format("(-lo / scale)")} - 8)) AS zp FROM s),
    q4 AS (SELECT v.vec_id, v.i, v.v, scale, zp, CAST(least(7, greatest(-8, {_HALF_UP.format("(v.v / scale)")} + zp)) AS INT) AS q FROM v JOIN z ON z.vec_id = v.vec_id AND z.g = v.i // 16)"""


@query("quant4_grouped", f"WITH {_INT4} SELECT vec_id, i, q FROM q4")
def quant4_grouped(spark, d):
    """Signed 4-bit codes with scale and zero point for each group of 16."""
    return C.quantize_grouped(C.packed(spark, d), 16).select("vec_id", F.posexplode("codes").alias("i", "c")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("c.q").cast("int").alias("q"))


@query("quant4_dequantized", f"WITH {_INT4} SELECT vec_id, i, round((q - zp) * scale, 6) + 0.0 AS v FROM q4")
def quant4_dequantized(spark, d):
    """Values restored from grouped 4-bit codes."""
    c = C.quantize_grouped(C.packed(spark, d), 16).select("vec_id", F.posexplode("codes").alias("i", "c"))
    return c.select("vec_id", F.col("i").cast("long").alias("i"), (F.round((F.col("c.q") - F.col("c.zp")) * F.col("c.scale"), 6) + 0.0).alias("v"))


@query("nibble_pack", f"""WITH {_INT4} SELECT vec_id, i // 2 AS byte, CAST(sum((q & 15) * CASE WHEN i % 2 = 0 THEN 1 ELSE 16 END) AS BIGINT) AS value FROM q4 GROUP BY ALL""")
def nibble_pack(spark, d):
    """Two 4-bit codes in a byte, low half first; unpacking restores the codes."""
    c = C.quantize_grouped(C.packed(spark, d), 16).select("vec_id", C.nibble_pack(F.transform("codes", lambda x: x["q"].cast("int"))).alias("b"))
    return c.select("vec_id", F.posexplode("b").alias("byte", "value")).select("vec_id", F.col("byte").cast("long").alias("byte"), "value")


@query("quant4_gemv", f"WITH {_INT4} SELECT vec_id, round(sum((q - zp) * scale * ((i % 7) / 7.0::DOUBLE)), 6) AS y FROM q4 GROUP BY vec_id")
def quant4_gemv(spark, d):
    """Grouped 4-bit rows times a fixed vector."""
    c = C.quantize_grouped(C.packed(spark, d), 16)
    terms = F.transform("codes", lambda x, i: (x["q"] - x["zp"]) * x["scale"] * ((i % 7) / F.lit(7.0)))
    return c.select("vec_id", F.round(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t), 6).alias("y"))


@query("quant8_gemv", f"""WITH {_INT8}, q AS (SELECT vec_id, i, least(127, greatest(-128, {_HALF_UP.format("(v / scale)")} + zp)) AS q, scale, zp FROM v JOIN z USING (vec_id))
    SELECT vec_id, round(sum((q - zp) * scale * ((i % 5) / 5.0::DOUBLE)), 6) AS y FROM q GROUP BY vec_id""")
def quant8_gemv(spark, d):
    """8-bit rows times a fixed vector."""
    c = C.quantize_affine(C.packed(spark, d))
    terms = F.transform("q", lambda q, i: (q - F.col("zp")) * F.col("scale") * ((i % 5) / F.lit(5.0)))
    return c.select("vec_id", F.round(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t), 6).alias("y"))


@query("quant8_gemm", f"""WITH {_INT8}, q AS (SELECT vec_id, i, least(127, greatest(-128, {_HALF_UP.format("(v / scale)")} + zp)) - zp AS q, scale FROM v JOIN z USING (vec_id))
    SELECT a.vec_id, a.i // 8 AS row, b.i // 8 AS col, round(sum(a.q * b.q) * any_value(a.scale * b.scale), 6) AS y FROM q a JOIN q b ON a.vec_id = b.vec_id AND a.i % 8 = b.i % 8 GROUP BY ALL""")
def quant8_gemm(spark, d):
    """8 x 8 matrices of 8-bit codes times their transposes: whole-number sums, scaled once."""
    c = C.quantize_affine(C.packed(spark, d)).select("vec_id", "scale", F.transform("q", lambda q: q - F.col("zp")).alias("q"))
    row = lambda q, r: F.slice(q, r * 8 + 1, F.lit(8))
    cell = lambda o: F.aggregate(F.zip_with(row(F.col("q"), F.floor(o / 8).cast("int")), row(F.col("q"), o % 8), lambda a, b: a * b), F.lit(0).cast("long"), lambda s, p: s + p)
    each = c.select("vec_id", "scale", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), cell)).alias("o", "s"))
    return each.select("vec_id", F.floor(F.col("o") / 8).cast("long").alias("row"), (F.col("o") % 8).cast("long").alias("col"), F.round(F.col("s") * (F.col("scale") * F.col("scale")), 6).alias("y"))


def _kept(spark, d):
    """Each vector's six largest entries as an array of (i, v), in order."""
    return C.top_k(C.packed(spark, d), F.lit(6)).select("vec_id", "kept")


def _restored(df):
    return df.select("vec_id", F.posexplode("r").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), (F.round("v", 6) + 0.0).alias("v"))


@query("recon_zero", f"WITH {_TOP} SELECT v.vec_id, v.i, round(coalesce(top.v, 0.0), 6) + 0.0 AS v FROM v LEFT JOIN top ON top.vec_id = v.vec_id AND top.i = v.i")
def recon_zero(spark, d):
    """Missing entries as zero."""
    return _restored(C.densify(_kept(spark, d), F.lit(64)).select("vec_id", F.col("dense").alias("r")))


_AROUND = f"""{_TOP}, j AS (SELECT v.vec_id, v.i, top.v AS k, CASE WHEN top.v IS NOT NULL THEN v.i END AS ki FROM v LEFT JOIN top ON top.vec_id = v.vec_id AND top.i = v.i),
    a AS (SELECT vec_id, i, k, last_value(ki IGNORE NULLS) OVER p AS i0, last_value(k IGNORE NULLS) OVER p AS v0, first_value(ki IGNORE NULLS) OVER n AS i1, first_value(k IGNORE NULLS) OVER n AS v1 FROM j
        WINDOW p AS (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("recon_linear", f"""WITH {_AROUND} SELECT vec_id, i, round(CASE WHEN k IS NOT NULL THEN k WHEN i0 IS NULL THEN 0.5 * v1 WHEN i1 IS NULL THEN 0.5 * v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, 6) + 0.0 AS v FROM a""")
def recon_linear(spark, d):
    """Missing entries on the line between their neighbours, half the edge value outside."""
    return _restored(C.fill(_kept(spark, d), F.lit(64), C.linear))


@query("recon_nearest", f"""WITH {_AROUND} SELECT vec_id, i, round(CASE WHEN i1 IS NULL OR i - i0 <= i1 - i THEN v0 / (1 + sqrt(i - i0)) ELSE v1 / (1 + sqrt(i1 - i)) END, 6) + 0.0 AS v FROM a""")
def recon_nearest(spark, d):
    """Nearest entry, faded with distance; the earlier one on ties."""
    return _restored(C.fill(_kept(spark, d), F.lit(64), C.nearest))


@query("recon_decay", f"""WITH {_TOP}, near AS (SELECT v.vec_id, v.i, top.v AS k, abs(top.i - v.i) AS dist FROM v JOIN top ON top.vec_id = v.vec_id),
    five AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY vec_id, i ORDER BY dist, k) <= 5)
    SELECT vec_id, i, round(CASE WHEN min(dist) = 0 THEN min_by(k, dist) ELSE sum(exp(-0.1 * dist) * k) / sum(exp(-0.1 * dist)) END, 6) + 0.0 AS v FROM five GROUP BY ALL""")
def recon_decay(spark, d):
    """Mean of the five nearest entries with weights that fall with distance."""
    return _restored(C.fill(_kept(spark, d), F.lit(64), C.smooth_decay))


_KIND = "['METADATA_JSON', 'CONFIG', 'WEIGHTS_FP32', 'TOKENIZER_VOCAB', 'SPARSE_INDICES', 'WEIGHTS_INT8', 'ATTENTION_WEIGHTS'][doc_id % 7 + 1]"
_SEG = f"seg AS (SELECT doc_id, 'seg-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS name, {_KIND} AS kind, octet_length(encode(text)) AS original_size FROM documents)"


def _segments(spark, d, kinds=5, *more):
    names = ("METADATA_JSON", "CONFIG", "WEIGHTS_FP32", "TOKENIZER_VOCAB", "SPARSE_INDICES", "WEIGHTS_INT8", "ATTENTION_WEIGHTS")[:kinds]
    kind = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % kinds).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("seg-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("name"), kind.alias("kind"), F.octet_length("text").cast("long").alias("original_size"), *more)


#: The strategy of each segment by the rules of the codecs: adaptive coding applies to small segments and tokenizers (other
#: texts have no zero bytes to leave out), quantization to whole 32-bit floats, runs where their pairs are fewer bytes.
_CODED = f"""{_SEG},
    bytes AS (SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents WHERE doc_id % 7 = 5)),
    islands AS (SELECT doc_id, b, i - row_number() OVER (PARTITION BY doc_id, b ORDER BY i) AS g FROM bytes),
    pairs AS (SELECT doc_id, CAST(sum((n + 254) // 255) AS BIGINT) AS pairs FROM (SELECT doc_id, count(*) AS n FROM islands GROUP BY doc_id, b, g) GROUP BY doc_id),
    coded AS (SELECT seg.*, coalesce(pairs, 0) AS pairs, CASE
        WHEN kind IN ('METADATA_JSON', 'CONFIG', 'TOKENIZER_VOCAB', 'SPARSE_INDICES') AND (original_size <= 1024 OR kind = 'TOKENIZER_VOCAB') THEN 1
        WHEN kind IN ('METADATA_JSON', 'SPARSE_INDICES') THEN 0
        WHEN kind IN ('WEIGHTS_FP32', 'ATTENTION_WEIGHTS') AND original_size > 0 AND original_size % 4 = 0 THEN 4
        WHEN kind = 'WEIGHTS_INT8' AND 2 * coalesce(pairs, 0) < original_size THEN 2
        ELSE 3 END AS strategy FROM seg LEFT JOIN pairs USING (doc_id))"""


def _compressed(spark, d, **more):
    """Documents as segments of seven kinds, coded; columns of `more` stay beside them."""
    segments = _segments(spark, d, 7, F.col("text").cast("binary").alias("data"), *(c.alias(n) for n, c in more.items()))
    return coding.compress(segments.select("doc_id", "kind", "data", *more))


@query("strategy_chain", f"WITH {_CODED} SELECT doc_id, CAST(strategy AS INT) AS strategy FROM coded")
def strategy_chain(spark, d):
    """The first strategy in priority order whose coded bytes are accepted, raw storage if none are."""
    return _compressed(spark, d).select("doc_id", "strategy")


@query("archive_offsets", f"WITH {_SEG} SELECT name, original_size, CAST(sum(original_size) OVER (ORDER BY name) - original_size AS BIGINT) AS place FROM seg")
def archive_offsets(spark, d):
    """Places of payloads written one after the other, by name."""
    return archive.offsets(_segments(spark, d, 7).select("name", "original_size"), F.substring("name", 5, 6), "name", "original_size").select("name", "original_size", "place")


@query("size_by_strategy", f"""
    WITH {_CODED} SELECT kind, CAST(strategy AS INT) AS strategy, count(*) AS segments, CAST(sum(original_size) AS BIGINT) AS bytes,
        CAST(sum(CASE strategy WHEN 0 THEN original_size WHEN 1 THEN original_size + 1 WHEN 2 THEN 2 * pairs WHEN 4 THEN original_size // 4 + 8 END) AS BIGINT) AS stored_bytes FROM coded GROUP BY kind, strategy""")
def size_by_strategy(spark, d):
    """Segments, bytes and stored bytes by kind and strategy, as coded; gzip's sizes, which SQL can not tell, are left out."""
    stored = F.when(F.col("strategy") != archive.GZIP, F.octet_length("data"))
    return _compressed(spark, d).groupBy("kind", "strategy").agg(F.count(F.lit(1)).alias("segments"), F.sum("original_size").alias("bytes"), F.sum(stored).cast("long").alias("stored_bytes"))


@query("archive_roundtrip")
def archive_roundtrip(spark, d):
    """Every lossless segment through coding and back: sizes and whether the bytes are the same, by digests that go along."""
    coded = _compressed(spark, d, want=F.sha2(F.col("text").cast("binary"), 256)).filter(F.col("strategy") != archive.QUANT).withColumn("stored_size", F.octet_length("data"))
    back = coding.decompress(coded.withColumn("size", F.col("original_size")))
    return back.select("doc_id", "size", "stored_size", (F.sha2("data", 256) == F.col("want")).alias("same"))


@query("largest_segments", f"WITH {_SEG} SELECT name, kind, original_size FROM seg ORDER BY original_size DESC, name LIMIT 25")
def largest_segments(spark, d):
    """The 25 largest segments (a top-k report)."""
    return _segments(spark, d, 7).orderBy(F.desc("original_size"), "name").limit(25).select("name", "kind", "original_size")


@query("skip_predicate", f"WITH {_SEG} SELECT kind, count(*) FILTER (NOT skip) AS kept, count(*) FILTER (skip) AS dropped, CAST(coalesce(sum(original_size) FILTER (skip), 0) AS BIGINT) AS dropped_bytes FROM (SELECT *, kind LIKE 'TOKENIZER%' OR original_size < 64 AS skip FROM seg) GROUP BY kind")
def skip_predicate(spark, d):
    """Segments that a skip predicate drops, with the bytes they held."""
    skip = F.col("kind").startswith("TOKENIZER") | (F.col("original_size") < 64)
    return archive.skipped(_segments(spark, d, 7), skip)


@query("archive_lookup", f"WITH {_SEG} SELECT name, kind, original_size FROM seg WHERE name IN ('seg-00000003', 'seg-00000077', 'seg-99999999')")
def archive_lookup(spark, d):
    """Random access: named segments alone; a name that is not there gives no row."""
    return _segments(spark, d, 7).filter(F.col("name").isin("seg-00000003", "seg-00000077", "seg-99999999")).select("name", "kind", "original_size")


@query("audio_lossy", f"WITH {_LONG} SELECT vec_id, i, CAST({_TRUNC.format('((v + 1) * 511.5)')} AS BIGINT) AS code FROM v WHERE abs(v) >= 0.01")
def audio_lossy(spark, d):
    """Samples below a threshold go, the rest become ten-bit codes."""
    v = long_vectors(spark, d).filter(F.abs("v") >= 0.01)
    return v.select("vec_id", "i", C.toward_zero((F.col("v") + 1) * 511.5).alias("code"))


@query("audio_lossless", f"WITH {_LONG} SELECT vec_id, i, CAST(least(65535, greatest(0, {_TRUNC.format('((v + 1) * 32768)')})) AS BIGINT) AS code FROM v")
def audio_lossless(spark, d):
    """Samples as 16-bit codes, clamped."""
    return long_vectors(spark, d).select("vec_id", "i", F.least(F.lit(65535), F.greatest(F.lit(0), C.toward_zero((F.col("v") + 1) * 32768))).cast("long").alias("code"))


@query("audio_valid", f"WITH {_LONG} SELECT vec_id, bool_and(v >= -1 AND v <= 1) AND count(*) > 0 AS valid FROM v GROUP BY vec_id")
def audio_valid(spark, d):
    """Whether all samples lie between -1 and 1."""
    x = C.packed(spark, d)
    return x.select("vec_id", ((F.size("x") > 0) & F.forall("x", lambda v: (v >= -1) & (v <= 1))).alias("valid"))


@query("series_of_sizes", f"WITH {_SEG} SELECT kind, name, coalesce(original_size - lag(original_size) OVER (PARTITION BY kind ORDER BY name), 0) AS change FROM seg")
def series_of_sizes(spark, d):
    """Change of size from one segment of a kind to the next.

    Kinds are few and large, so neighbours are found in ranges of names; a range's first row takes the last of the range before.
    """
    s = _segments(spark, d, 7).withColumn("part", F.substring("name", 5, 6))
    inside = s.withColumn("before", F.lag("original_size").over(W.partitionBy("kind", "part").orderBy("name")))
    last = s.groupBy("kind", "part").agg(F.max_by("original_size", "name").alias("last"))
    last = last.select("kind", "part", F.lag("last").over(W.partitionBy("kind").orderBy("part")).alias("last"))
    return inside.join(last, ["kind", "part"]).select("kind", "name", F.coalesce(F.col("original_size") - F.coalesce("before", "last"), F.lit(0)).cast("long").alias("change"))
