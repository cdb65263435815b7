"""Archives of dictionary-coded tensors: looked up by name, decoded, or multiplied without decoding.

An archive is a folder with three Parquet tables: `index` (a row per tensor: its dictionary, stage scales, tiles and bytes),
`atoms` (the dictionaries, shared by any number of tensors) and `codes` (a row per tile, its codes packed in stage and slot
order, dealt by dictionary). A lookup reads the index alone; a tensor's tiles are found by dictionary and name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import dictionary as D


def packed(codes: DataFrame) -> DataFrame:
    """(name, dictionary, tile, slots, codes) from (name, dictionary, tile, stage, slot, atom, sign): a row per tile."""
    each = F.struct("stage", "slot", D.pack_code(F.col("atom"), F.col("sign")).cast("int").alias("code"))
    tiles = codes.groupBy("name", "dictionary", "tile").agg(F.array_sort(F.collect_list(each)).alias("c"), (F.max("slot") + 1).cast("int").alias("slots"))
    return tiles.select("name", "dictionary", "tile", "slots", F.col("c.code").alias("codes"))


def unpacked(tiles: DataFrame) -> DataFrame:
    """(name, tile, stage, slot, atom, sign) from packed tiles."""
    at = tiles.select("name", "tile", "slots", F.posexplode("codes").alias("p", "code"))
    split = at.select("name", "tile", F.floor(F.col("p") / F.col("slots")).cast("int").alias("stage"), (F.col("p") % F.col("slots")).alias("slot"), D.unpack_code(F.col("code")).alias("u"))
    return split.select("name", "tile", "stage", "slot", "u.atom", "u.sign")


def write(codes: DataFrame, atoms: DataFrame, scales: list[float], path: str) -> None:
    """Writes codes (name, dictionary, tile, stage, slot, atom, sign) and atoms (dictionary, atom, i, w)."""
    packed(codes).write.mode("overwrite").partitionBy("dictionary").parquet(f"{path}/codes")
    atoms.write.mode("overwrite").parquet(f"{path}/atoms")
    stored = codes.sparkSession.read.parquet(f"{path}/codes").groupBy("name", F.col("dictionary").cast("string").alias("dictionary"))
    index = stored.agg(F.count(F.lit(1)).alias("tiles"), F.sum(2 * F.size("codes")).alias("coded_bytes"))
    index.withColumn("scales", F.array(*map(F.lit, scales))).write.mode("overwrite").parquet(f"{path}/index")


def has(spark: SparkSession, path: str, name: str) -> bool:
    """Whether the archive holds a tensor; reads the index alone."""
    return not spark.read.parquet(f"{path}/index").filter(F.col("name") == name).isEmpty()


def _tensor(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """A tensor's codes, its dictionary and its scales. A name that is missing is an error."""
    entry = spark.read.parquet(f"{path}/index").filter(F.col("name") == name).first()
    if entry is None:
        raise KeyError(f"no such tensor: {name}")
    mine = F.col("dictionary").cast("string") == entry["dictionary"]
    tiles = spark.read.parquet(f"{path}/codes").filter(mine & (F.col("name") == name))
    return unpacked(tiles), spark.read.parquet(f"{path}/atoms").filter(mine).select("atom", "i", "w"), entry["scales"]


def decompress(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(tile, i, v) of a tensor."""
    codes, atoms, scales = _tensor(spark, path, name)
    return D.decode(codes, atoms, scales)


def product(spark: SparkSession, path: str, name: str, x: DataFrame) -> DataFrame:
    """(tile, y): a tensor's tiles times x (i, h), from the codes."""
    codes, atoms, scales = _tensor(spark, path, name)
    return D.fused_product(codes, atoms, x, scales)
