"""Algebra of bit sets in long form (id columns, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOTAL = 20000
WORD_END, SPECIAL_END, NUMBER_END = 10000, 15000, 20000


def union(bits: DataFrame, by: list[str]) -> DataFrame:
    """Distinct positions of each group."""
    return bits.select(*by, "pos").distinct()


def overlap(a: DataFrame, b: DataFrame, by_a: list[str], by_b: list[str]) -> DataFrame:
    """Shared positions of sets of a and b, divided by the smaller set; pairs that share none are left out.

    a and b: distinct (ids, pos). Sizes are joined after the shared positions are counted.
    """
    left = a.groupBy(*by_a).agg(F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy(*by_b).agg(F.count(F.lit(1)).alias("n_b"))
    shared = a.join(b, "pos").groupBy(*by_a, *by_b).agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(left, by_a).join(right, by_b).withColumn("overlap", F.col("shared") / F.least("n_a", "n_b"))


#: Sets that are held beside each row at most: 8 bytes a mask, so some MB at 1,250 positions.
MAX_IN_ROW = 20_000


def masks(bits: DataFrame, by: str, width: int) -> tuple[DataFrame, list[str]]:
    """(by, n, a column for each 64-bit mask) of each set, and the masks' names. n is the size of the set.

    Rows are dealt by set first: two numbers each, less than the masks they would be summed to before the shuffle. A
    repeated position counts once. As many tasks as the session has partitions, as what follows is work on few rows.
    """
    names = [f"_m{i}" for i in range(-(-width // 64))]
    parts = [F.bit_or(F.when(F.shiftright("pos", 6) == i, F.expr("shiftleft(1L, CAST(pos & 63 AS INT))")).otherwise(0)).alias(m) for i, m in enumerate(names)]
    dealt = bits.repartition(int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    size = sum((F.bit_count(m) for m in names[1:]), F.bit_count(names[0]))
    return dealt.groupBy(by).agg(*parts).select(by, size.alias("n"), *names), names


def best_overlap(a: DataFrame, b: DataFrame, by_a: str, by_b: str, width: int) -> DataFrame:
    """(by_a, b): for each set of a the best of the sets of b, as (overlap o, shared positions, minus its id i); sets that
    share nothing with any are left out. All of b, MAX_IN_ROW sets at most, stand in one row beside each row of a."""
    left, names = masks(a, by_a, width)
    held = masks(b, by_b, width)[0].agg(F.collect_list(F.struct(F.col(by_b).alias("id"), "n", *names)).alias("_all"))
    each = left.crossJoin(F.broadcast(held))
    common = lambda x: sum((F.bit_count(F.col(m).bitwiseAND(x[m])) for m in names[1:]), F.bit_count(F.col(names[0]).bitwiseAND(x[names[0]])))
    shared = F.filter(F.transform("_all", lambda x: F.struct(common(x).alias("shared"), x["n"].alias("n"), x["id"].alias("id"))), lambda x: x["shared"] > 0)
    scored = F.transform(shared, lambda x: F.struct(F.round(x["shared"] / F.least("n", x["n"]), 9).alias("o"), x["shared"].alias("shared"), (-x["id"]).alias("i")))
    return each.select(by_a, F.array_max(scored).alias("b")).filter("b IS NOT NULL")


def region(pos: str = "pos"):
    """Which part of the space a position lies in."""
    p = F.col(pos)
    return F.when(p < WORD_END, "word").when(p < SPECIAL_END, "special").when(p < NUMBER_END, "number").otherwise("none")


def hash_order(*columns: str):
    """A reproducible shuffle that other engines compute alike."""
    mixed = F.lit(0).cast("long")
    for c in columns:
        mixed = (mixed * 31 + F.col(c) * F.lit(2654435761)) % F.lit(4294967296)
    return mixed


def bit_pack(bits: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of each set, low bit first: (ids, byte, value)."""
    return bits.groupBy(*by, F.floor(F.col("pos") / 8).cast("long").alias("byte")).agg(F.sum(F.expr("shiftleft(1L, CAST(pos % 8 AS INT))")).alias("value"))
