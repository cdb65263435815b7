"""Codecs: runs, deltas, varints, top-k, quantization and reconstruction.

Vectors come long (ids, i, v) where entries must be ranked or joined, and packed (ids, x array) where each row can be coded
on its own: then nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.functions.base import let
from bitloom.sources.tables import vectors

MAX_RUN = 255


def toward_zero(c: Column) -> Column:
    """Drops the fraction."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long")


def half_up(c: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.when(c < 0, -F.floor(-c + 0.5)).otherwise(F.floor(c + 0.5))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of `left` with the row of `right` of the same keys, nulls being equal; `right` has one row for each key."""
    named = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, same).drop(*(f"_r_{k}" for k in keys))


def _before(sums: DataFrame, by: list[str], total: str) -> Column:
    """The sum of `total` over a group's earlier buckets."""
    return F.sum(total).over(W.partitionBy(*by).orderBy("_bucket")) - F.col(total)


def ranks(df: DataFrame, by: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Numbers each group's rows from 0. `bucket` never falls along the order, so that a large group is numbered in many tasks."""
    keys = [*by, "_bucket"]
    held = df.withColumn("_bucket", bucket)
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, _before(counts, by, "_n").alias("_start"))
    rows = held.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    return _beside(rows, starts, keys).withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_row", "_start")


def runs(df: DataFrame, by: list[str], order: list[Column], value: str, bucket: Column) -> DataFrame:
    """Runs of equal values of each group: (by, value, start, run).

    `bucket` never falls along the order. Runs are found within the buckets of a group; then only the first and the last run
    of each bucket are looked at again, and neighbours of equal value become one. So a group of any size is cut into many
    tasks, and what passes through one task is two rows a bucket.
    """
    keys = [*by, "_bucket"]
    # Dealt to a given number of tasks, which adaptive execution keeps: rows take far more room sorted than dealt. One sort serves all windows.
    named = [f"_o{i}" for i in range(len(order))]
    w = W.partitionBy(*keys).orderBy(*named)
    held = df.select(*by, bucket.alias("_bucket"), F.col(value).alias("_value"), *(o.alias(n) for o, n in zip(order, named)))
    counts = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, "_n", _before(counts, by, "_n").alias("_from"))
    held = held.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    row = F.row_number().over(w)
    numbered = held.withColumns({"_r": (row - 1).cast("long"), "_new": (~F.col("_value").eqNullSafe(F.lag("_value").over(w)) | (row == 1)).cast("int")})
    marked = numbered.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    local = marked.groupBy(*keys, "_run").agg(F.first("_value").alias("value"), F.min("_r").alias("_at"), F.count(F.lit(1)).alias("run"))
    inner = (F.col("_at") > 0) & (F.col("_at") + F.col("run") < F.col("_n"))
    placed = _beside(local, starts, keys).select(*by, "value", "run", (F.col("_from") + F.col("_at")).alias("start"), F.when(inner, F.struct("_bucket")).alias("_place"))
    # Inner runs stay with their bucket; the first and last runs of all buckets of a group, where _place is null, meet.
    along = W.partitionBy(*by, "_place").orderBy("start")
    meets = F.col("value").eqNullSafe(F.lag("value").over(along)) & (F.lag(F.col("start") + F.col("run")).over(along) == F.col("start"))
    islands = placed.withColumn("_new", (~F.coalesce(meets, F.lit(False))).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_place", "_island").agg(F.first("value").alias("value"), F.min("start").alias("start"), F.sum("run").alias("run")).drop("_place", "_island")


def split_runs(coded: DataFrame, most: int = MAX_RUN) -> DataFrame:
    """Runs of at most `most` repeats."""
    part = coded.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("run") - 1) / most))))
    return part.withColumn("start", F.col("start") + F.col("_k") * most).withColumn("run", F.least(F.lit(most).cast("long"), F.col("run") - F.col("_k") * most)).drop("_k")


def expand_runs(coded: DataFrame) -> DataFrame:
    """One row for each repeat, with its place."""
    return coded.withColumn("place", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("run") - 1)))


def deltas(df: DataFrame, by: list[str], pos: str, width: int = 1 << 20) -> DataFrame:
    """Adds `delta`, the difference to the position before (to zero for the first); buckets hold `width` positions each."""
    keys = [*by, "_bucket"]
    held = df.withColumn("_bucket", F.floor(F.col(pos) / width))
    last = held.groupBy(*keys).agg(F.max(pos).alias("_last"))
    earlier = last.select(*keys, F.lag("_last", 1, 0).over(W.partitionBy(*by).orderBy("_bucket")).alias("_earlier"))
    inside = held.withColumn("_inside", F.lag(pos).over(W.partitionBy(*keys).orderBy(pos)))
    return _beside(inside, earlier, keys).withColumn("delta", F.col(pos) - F.coalesce("_inside", "_earlier")).drop("_bucket", "_inside", "_earlier")


def undelta(df: DataFrame, by: list[str], rank: str, width: int = 1 << 20) -> DataFrame:
    """Adds `pos`, the running sum of the differences; buckets hold `width` ranks each."""
    keys = [*by, "_bucket"]
    held = df.withColumn("_bucket", F.floor(F.col(rank) / width))
    sums = held.groupBy(*keys).agg(F.sum("delta").alias("_sum"))
    starts = sums.select(*keys, _before(sums, by, "_sum").alias("_from"))
    inside = held.withColumn("_inside", F.sum("delta").over(W.partitionBy(*keys).orderBy(rank).rowsBetween(W.unboundedPreceding, 0)))
    return _beside(inside, starts, keys).withColumn("pos", F.col("_from") + F.col("_inside")).drop("_bucket", "_inside", "_from")


def varint_bytes(c: Column) -> Column:
    """Bytes of a non-negative integer below 2^35 with seven bits in each."""
    return F.when(c < 1 << 7, 1).when(c < 1 << 14, 2).when(c < 1 << 21, 3).when(c < 1 << 28, 4).otherwise(5)


def active_count(n: Column, sparsity) -> Column:
    """Entries that stay of n at a sparsity: the share, at least one, within the size's cap."""
    s = sparsity if isinstance(sparsity, Column) else F.lit(float(sparsity))
    k = F.greatest(F.lit(1), F.floor(n * s)).cast("long")
    wide = F.when(n > 10_000_000, F.least(k, F.lit(1_000_000))).when(n > 1_000_000, F.least(k, F.lit(500_000))).otherwise(k)
    base = F.when(n > 10_000_000, 10_000).when(n > 1_000_000, 5_000).otherwise(2_000)
    narrow = F.floor(base * F.greatest(F.lit(0.25), 1 + s * 8))
    return F.least(k, F.when(s >= 0.1, wide).otherwise(narrow)).cast("long")


def top_k(df: DataFrame, k: Column) -> DataFrame:
    """Adds `kept`: the k largest magnitudes of the vector x as (i, v), by position; lower positions win ties. Vectors are
    ranked inside their rows."""
    ranked = F.array_sort(F.transform("x", lambda v, i: F.struct((-F.abs(v)).alias("m"), i.cast("long").alias("i"), v.alias("v"))))
    first = F.transform(F.slice(ranked, F.lit(1), k.cast("int")), lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v")))
    return df.withColumn("kept", F.array_sort(first))


def uniform(long: DataFrame, n: int, k: int) -> DataFrame:
    """Every max(1, n // k)-th entry, k at most."""
    step = max(1, n // k)
    return long.filter((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < k))


def index_values(df: DataFrame, levels: int = 65535) -> DataFrame:
    """Adds lo, scale and `coded`, the kept entries as (i, v, q) with the code q between the row's extremes."""
    values = F.transform("kept", lambda e: e["v"])
    ends = F.struct(F.array_min(values).alias("lo"), F.array_max(values).alias("hi"))
    held = let(ends, lambda e: F.struct(e["lo"].alias("lo"), F.when(e["hi"] > e["lo"], (e["hi"] - e["lo"]) / levels).otherwise(1.0).alias("scale")))
    each = df.withColumn("_h", held).select(*df.columns, "_h.lo", "_h.scale")
    return each.withColumn("coded", F.transform("kept", lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"), F.floor((e["v"] - F.col("lo")) / F.col("scale")).alias("q"))))


def varint(c: Column) -> Column:
    """The bytes of a non-negative integer below 2^35, seven bits in each, low bits first, the top bit set but for the last."""
    part = lambda k: F.shiftrightunsigned(c.cast("long"), 7 * k).bitwiseAND(127)
    at = lambda n: F.concat(*(F.unhex(F.lpad(F.hex(part(k) + (128 if k < n - 1 else 0)), 2, "0")) for k in range(n)))
    n = varint_bytes(c)
    return F.when(n == 1, at(1)).when(n == 2, at(2)).when(n == 3, at(3)).when(n == 4, at(4)).otherwise(at(5))


def from_varint(data: Column) -> Column:
    """The integer of varint()."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    value = F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("long").bitwiseAND(127))
    return F.aggregate(F.reverse(value), F.lit(0).cast("long"), lambda a, x: a * 128 + x)


def format_flag(n: Column) -> Column:
    """Tag byte of an index list by its length."""
    return F.when(n > 100_000, 0x90).when(n > 10_000, 0x88).when(n > 2_000, 0xD0).otherwise(0x0F)


def size_limit(n: Column, sparsity: Column) -> Column:
    """Largest coded size that is accepted, in original sizes."""
    return F.when(sparsity >= 0.1, 2.0).when(n < 1024, 1.2).otherwise(1.0)


def adaptive_choice(kind: Column, n: Column, direct: int = 1024) -> Column:
    """direct for small or lossless segments, metadata for descriptions, tensor otherwise."""
    return F.when((n <= direct) | kind.isin("TOKENIZER_VOCAB", "TOKENIZER_MODEL"), "direct").when(kind.isin("METADATA_JSON", "METADATA_TOML", "CONFIG", "GRAPH_STRUCTURE_PROTO"), "metadata").otherwise("tensor")


def metadata_bits(df: DataFrame, key: str, text: str, width: int, sparsity: float) -> DataFrame:
    """(key, pos): hashed positions of a text's characters, the first distinct ones up to the sparsity's share."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    hashed = F.flatten(F.transform(chars, lambda c, i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: (((F.ascii(c).cast("long") * 31 + i) * 17 + j * 257) % width))))
    most = F.greatest(F.lit(1), F.floor(8 * F.length(text) * sparsity).cast("int"))
    return df.select(key, F.explode(F.slice(F.array_distinct(hashed), F.lit(1), most)).alias("pos"))


def checksum(text: Column) -> Column:
    """Sum of the bytes of a text."""
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, p: a + F.conv(p, 16, 10).cast("long"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x."""
    return vectors(spark, sf_dir)


def _extremes(x: str) -> tuple[Column, Column]:
    return F.array_min(x), F.array_max(x)


def _bounded(v: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def quantize_symmetric(df: DataFrame, bits: int) -> DataFrame:
    """Adds scale and codes q; a vector of zeros has scale 1."""
    top = 2 ** (bits - 1) - 1
    lo, hi = _extremes("x")
    held = let(F.greatest(F.abs(lo), F.abs(hi)), lambda a: F.when(a > 0, a / top).otherwise(1.0))
    coded = let(held, lambda s: F.struct(s.alias("scale"), F.transform("x", lambda v: half_up(v / s).cast("int")).alias("q")))
    return df.withColumn("_c", coded).select(*df.columns, "_c.scale", "_c.q")


def quantize_range(df: DataFrame, bits: int) -> DataFrame:
    """Adds lo, scale and unsigned codes q."""
    lo, hi = _extremes("x")
    ends = F.struct(lo.alias("lo"), F.when(hi > lo, (hi - lo) / (2**bits - 1)).otherwise(1.0).alias("scale"))
    coded = let(ends, lambda e: F.struct(e["lo"].alias("lo"), e["scale"].alias("scale"), F.transform("x", lambda v: half_up((v - e["lo"]) / e["scale"]).cast("int")).alias("q")))
    return df.withColumn("_c", coded).select(*df.columns, "_c.lo", "_c.scale", "_c.q")


def quantize_affine(df: DataFrame) -> DataFrame:
    """Adds scale, zero point zp and signed 8-bit codes q."""
    lo, hi = _extremes("x")
    ends = F.struct(lo.alias("lo"), F.when(hi - lo < 1e-8, 1.0).otherwise((hi - lo) / 255).alias("scale"))
    pointed = let(ends, lambda e: F.struct(e["scale"].alias("scale"), (toward_zero(-e["lo"] / e["scale"]) - 128).alias("zp")))
    coded = let(pointed, lambda e: F.struct(e["scale"].alias("scale"), e["zp"].alias("zp"), F.transform("x", lambda v: _bounded(half_up(v / e["scale"]) + e["zp"], -128, 127).cast("int")).alias("q")))
    return df.withColumn("_c", coded).select(*df.columns, "_c.scale", "_c.zp", "_c.q")


def quantize_grouped(df: DataFrame, group: int) -> DataFrame:
    """Adds codes: (q, zp, scale) of each entry, signed 4-bit with scale and zero point for each group of entries."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / group).cast("int")), lambda g: F.slice("x", g * group + 1, F.lit(group)))
    ends = F.transform(parts, lambda p: F.struct(p.alias("p"), F.array_min(p).alias("lo"), F.array_max(p).alias("hi")))
    scaled = F.transform(ends, lambda e: F.struct(e["p"].alias("p"), e["lo"].alias("lo"), F.when(e["hi"] - e["lo"] < 1e-8, 1.0).otherwise((e["hi"] - e["lo"]) / 15).alias("scale")))
    pointed = F.transform(scaled, lambda e: F.struct(e["p"].alias("p"), e["scale"].alias("scale"), _bounded(half_up(-e["lo"] / e["scale"]) - 8, -8, 7).cast("int").alias("zp")))
    coded = F.transform(pointed, lambda e: F.transform(e["p"], lambda v: F.struct(_bounded(half_up(v / e["scale"]) + e["zp"], -8, 7).cast("int").alias("q"), e["zp"].alias("zp"), e["scale"].alias("scale"))))
    return df.withColumn("codes", F.flatten(coded))


def explode_codes(df: DataFrame) -> DataFrame:
    """vec_id, i, q."""
    return df.select("vec_id", F.posexplode("q").alias("i", "q")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("q").cast("int").alias("q"))


def nibble_pack(codes: Column) -> Column:
    """Bytes of two 4-bit codes each, low half first; a missing last half is zero."""
    half = lambda parity: lambda c: F.filter(c, lambda _, i: i % 2 == parity)
    byte = lambda a, b: a.bitwiseAND(15).cast("long") + F.coalesce(b, F.lit(0)).bitwiseAND(15).cast("long") * 16
    return let(codes, lambda c: F.zip_with(half(0)(c), half(1)(c), byte))


def nibble_unpack(packed_bytes: Column, n: Column) -> Column:
    """Signed codes of nibble_pack."""
    both = F.flatten(F.transform(packed_bytes, lambda b: F.array(b.bitwiseAND(15), F.shiftright(b, 4).bitwiseAND(15))))
    return F.slice(F.transform(both, lambda q: F.when(q > 7, q - 16).otherwise(q).cast("int")), F.lit(1), n)


def densify(kept: DataFrame, n: Column) -> DataFrame:
    """Adds `dense`: zeros with the kept (i, v) in place."""
    lookup = F.map_from_entries(F.transform("kept", lambda e: F.struct(e["i"].cast("int"), e["v"])))
    return kept.withColumn("dense", let(lookup, lambda m: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))))


def fill(df: DataFrame, n: Column, rule: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds `r`: entry i of each vector as the rule makes it from `kept`, (i, v) in order. Vectors are coded row by row."""
    return df.withColumn("r", let(F.col("kept"), lambda kept: F.transform(F.sequence(F.lit(0), n - 1), lambda i: rule(kept, i))))


def _around(kept: Column, i: Column) -> tuple[Column, Column]:
    """The last kept entry at or before i, and the first one at or after it; null where there is none."""
    return F.try_element_at(F.filter(kept, lambda e: e["i"] <= i), F.lit(-1)), F.get(F.filter(kept, lambda e: e["i"] >= i), F.lit(0))


def linear(kept: Column, i: Column) -> Column:
    """On the line between neighbours; half the edge value outside."""
    before, after = _around(kept, i)
    inside = F.when(before["i"] == i, before["v"]).otherwise(before["v"] + (after["v"] - before["v"]) * (i - before["i"]) / F.nullif(after["i"] - before["i"], F.lit(0)))
    return F.when(before["i"].isNull(), 0.5 * after["v"]).when(after["i"].isNull(), 0.5 * before["v"]).otherwise(inside)


def nearest(kept: Column, i: Column) -> Column:
    """The nearest entry over one plus the root of its distance."""
    before, after = _around(kept, i)
    early = after["i"].isNull() | (before["i"].isNotNull() & (i - before["i"] <= after["i"] - i))
    return F.when(early, before["v"] / (1 + F.sqrt(i - before["i"]))).otherwise(after["v"] / (1 + F.sqrt(after["i"] - i)))


def smooth_decay(kept: Column, i: Column) -> Column:
    """Weighted mean of the five nearest entries; a kept entry is itself."""
    near = F.slice(F.array_sort(F.transform(kept, lambda e: F.struct(F.abs(e["i"] - i).alias("d"), e["v"].alias("v")))), 1, 5)
    total = lambda f: F.aggregate(near, F.lit(0.0), lambda a, e: a + f(e))
    weight = lambda e: F.exp(-0.1 * e["d"])
    return F.when(F.get(near, F.lit(0))["d"] == 0, F.get(near, F.lit(0))["v"]).otherwise(total(lambda e: weight(e) * e["v"]) / total(weight))
