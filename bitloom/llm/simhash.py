"""SimHash near-duplicates through one-wildcard segment variants.

Fingerprints of 64 bits link at two or fewer differing bits. Cut into two segments of 32 bits, one segment of a linked
pair differs by at most one bit, so the pair shares a variant of that segment with one bit masked out. Each distinct
fingerprint is indexed under its 2 x 32 variants; an equality join finds candidates and the join condition verifies
them. A pair that shares several variants is reported under one canonical variant only. Nearly all variants belong to
one fingerprint alone: variants are counted first, which shuffles eight bytes of each, and only those that two or more
share are joined. Fingerprints are dealt out for the count, so that a task holds a bounded number of variants.

Buckets with more than `max_bucket` fingerprints are not joined: their members are indexed under all 2,016 two-bit
masks of the whole fingerprint instead. At most four fingerprints share such a key and all of them link, so nothing is
lost, no pairs of a large group are formed, and the work stays linear in the group.

Components come from alternating large-star and small-star rounds on tables in the shared folder, with as many files as
their edges need.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; a
text of fewer than three words is one shingle; rows that repeat a doc_id count once each for their fingerprint; rows
with a null doc_id link like any other and name a component only if it has no doc_id; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import MAX_BROADCAST_IDS, keep_ids, materialise, per_row, text_bytes

#: Words of a shingle and seed of its hash.
SHINGLE, SEED = 3, 42
#: Fingerprints that a bucket may hold to be joined pair by pair.
MAX_BUCKET = 128
#: Fingerprints whose variants a task counts: a million variants, about 100 MB.
NODES_PER_TASK = 16_384
#: Shingles hashed at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, count, _BLOCK):
        part = words[at : min(at + _BLOCK, count) + shingle - 1]
        shingles = map(join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _signed(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash as a signed long."""
    value = fingerprint(bytes(text), shingle)
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row."""

    def rows(source):
        for doc_id, text in source:
            yield doc_id, _signed(text, shingle)

    return per_row(docs.select("doc_id", text_bytes().alias("t")), "doc_id long, fp long", rows)


def _variants(nodes: DataFrame) -> DataFrame:
    """node, fp, and a key for each segment and masked bit: 38 bits that hold the masked segment, the segment's number and the bit."""
    numbered = nodes.select("node", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    segment = F.expr("shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295L")
    return numbered.select("node", "fp", "v", segment.alias("seg")).select("node", "fp", F.expr("shiftleft(seg & ~shiftleft(1L, v % 32), 6) | v").alias("key"))


def _dealt(nodes: DataFrame) -> DataFrame:
    """The fingerprints, about NODES_PER_TASK to a task and no fewer tasks than cores."""
    return nodes.repartition(max(nodes.sparkSession.sparkContext.defaultParallelism, -(-nodes.count() // NODES_PER_TASK)), "fp")


def _shared(nodes: DataFrame) -> DataFrame:
    """The variants that two or more fingerprints share: key, node, fp and how many share it (n)."""
    keyed = _variants(nodes)
    twice = materialise(_variants(_dealt(nodes)).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-variants")
    # Two numbers a key: broadcast where the count allows, else one more shuffle of the variants.
    small = twice.count() <= MAX_BROADCAST_IDS
    return materialise(keyed.join(F.broadcast(twice) if small else twice.hint("merge"), "key"), "shared")


def links(nodes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """All pairs (u, v) of nodes whose distinct fingerprints differ by one or two bits, or a chain of such pairs.

    nodes: a materialised table (node, fp) with distinct fp.
    """
    shared = _shared(nodes)
    small, large = shared.filter(F.col("n") <= max_bucket), shared.filter(F.col("n") > max_bucket)
    crowded = not large.isEmpty()
    a = small.select(F.col("key").alias("ka"), F.col("node").alias("u"), F.col("fp").alias("fa"))
    b = small.select(F.col("key").alias("kb"), F.col("node").alias("v"), F.col("fp").alias("fb"))
    low, high = "((fa ^ fb) & 4294967295L)", "shiftrightunsigned(fa ^ fb, 32)"
    # The canonical variant: segment 0 if it differs by at most one bit, else segment 1; an equal segment at its bit 0.
    canonical = f"""CASE WHEN bit_count({low}) <= 1
        THEN (ka & 63) = CASE WHEN {low} = 0 THEN 0 ELSE CAST(round(log2({low})) AS INT) END
        ELSE (ka & 63) = 32 + CASE WHEN {high} = 0 THEN 0 ELSE CAST(round(log2({high})) AS INT) END END"""
    found = a.join(b, (F.col("ka") == F.col("kb")) & F.expr(f"fa < fb AND bit_count(fa ^ fb) <= 2 AND {canonical}")).select("u", "v")
    if not crowded:
        return found
    # Pairs with one end in a large bucket still meet in a small one, or both ends are in the large one and meet here.
    members = large.select("node", "fp").distinct()
    masks = F.expr("flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> struct(i * 64 + j AS m, shiftleft(1L, i) | shiftleft(1L, j) AS bits))))")
    starred = members.select("node", "fp", F.explode(masks).alias("mask")).select("node", F.expr("mask.m").alias("m"), F.expr("fp & ~mask.bits").alias("key"))
    stars = starred.groupBy("m", "key").agg(F.collect_list("node").alias("all")).filter(F.size("all") > 1)
    chained = stars.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).filter("u <> v").distinct()
    return found.union(chained)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and the smallest node that it reaches, for the nodes of the edges (u, v).

    Hub nodes are safe: minima are aggregated partially, and the join to them is split where skewed.
    """
    at = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    sign = F.expr("count(1) AS n"), F.expr("sum(CAST(xxhash64(u, v) AS DECIMAL(38, 0))) AS s")
    before = at.agg(*sign).first()
    for _ in range(max_rounds):
        if not before["n"]:
            break
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star", before["n"])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        at = materialise(small, "small-star", 2 * before["n"])
        now = at.agg(*sign).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return at.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _node() -> Column:
    """A row's place in its component: the smallest doc_id first, no doc_id last. Fingerprints that share a doc_id stay apart."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("fp").alias("of"))


def _named(docs: DataFrame, shingle: int, max_bucket: int) -> DataFrame:
    """doc_id, fp and the first node of its component (`first`) of each row."""
    each = materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = materialise(each.groupBy("fp").agg(F.min(_node()).alias("node")), "nodes")
    roots = components(links(nodes, max_bucket))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("component", "node").alias("first"))
    return each.alias("e").join(named.alias("n").hint("merge"), "fp").select("e.doc_id", "fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    return _named(docs, shingle, max_bucket).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that come first in their components; of rows equal in doc_id and fingerprint, one."""
    decisions = _named(docs, SHINGLE, MAX_BUCKET).select("doc_id", (_node() == F.col("first")).alias("kept"), F.col("fp").alias("key"))
    return keep_ids(docs, materialise(decisions, "classes"), F.udf(_signed, "long", useArrow=True)(text_bytes()))
