"""Bit sets as packed bytes in files: 2,500 bytes a set of 20,000 positions, plain or as byte runs, with or without gzip."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators.sets import TOTAL


def packed(pos: Column, width: int = TOTAL) -> Column:
    """An array of positions as bytes, low bit first; positions outside the width are left out.

    Sets are laid out some 64 at a time in Arrow batches, so that work follows positions and bytes.
    """

    @F.arrow_udf("binary")
    def pack(sets: pa.Array) -> pa.Array:
        size, out = (width + 7) // 8, []
        for at in range(0, len(sets), SETS):
            some = sets.slice(at, SETS)
            values, lengths = some.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(some), 0).to_numpy()
            rows, inside = np.repeat(np.arange(len(some)), lengths), (values >= 0) & (values < width)
            bits = np.zeros((len(some), size * 8), dtype=np.uint8)
            bits[rows[inside], values[inside].astype(np.int64)] = 1
            data = np.packbits(bits, axis=1, bitorder="little")
            out += [row.tobytes() if ok else None for row, ok in zip(data, some.is_valid().to_pylist())]
        return pa.array(out, pa.binary())

    return pack(pos)


#: Sets that are laid out at once.
SETS = 64


def unpacked(data: Column) -> Column:
    """Active positions of packed bytes, in order."""

    @F.arrow_udf("array<bigint>")
    def unpack(rows: pa.Array) -> pa.Array:
        found, offsets = [np.zeros(0, dtype=np.int64)], [0]
        for row in rows:
            if row.is_valid:
                held = np.frombuffer(row.as_buffer(), dtype=np.uint8)
                at = np.flatnonzero(held)
                byte, bit = np.nonzero(np.unpackbits(held[at, None], axis=1, bitorder="little"))
                found.append(at[byte] * 8 + bit)
                offsets.append(offsets[-1] + len(byte))
            else:
                offsets.append(offsets[-1])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)), mask=rows.is_null())

    return unpack(data)


def to_binary(codes: Column) -> Column:
    """Numbers from 0 to 255 as bytes."""
    return F.unhex(F.array_join(F.transform(codes, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def from_binary(data: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), lambda p: F.conv(p, 16, 10).cast("int"))


def positions(codes: Column) -> Column:
    """Active positions of packed bytes; bytes without any are passed over at once."""
    held = F.filter(F.transform(codes, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda e: e["b"] != 0)
    bit = lambda e, k: F.when(e["b"].bitwiseAND(1 << k) != 0, (e["i"] * 8 + k).cast("long"))
    return F.flatten(F.transform(held, lambda e: F.array_compact(F.array(*(bit(e, k) for k in range(8))))))


def run_codes(codes: Column, most: int = 255) -> Column:
    """Bytes as (value, run) pairs, one after the other."""

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = last.isNotNull() & (last["v"] == b) & (last["n"] < most)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(b.cast("int").alias("v"), (last["n"] + 1).alias("n"))))
        return F.when(same, longer).otherwise(F.concat(acc, F.array(F.struct(b.cast("int").alias("v"), F.lit(1).alias("n")))))

    runs = F.aggregate(codes, F.array().cast("array<struct<v:int,n:int>>"), step)
    return F.flatten(F.transform(runs, lambda r: F.array(r["v"], r["n"])))


def unrun(pairs: Column) -> Column:
    """Inverse of run_codes."""
    half = lambda k: F.filter(pairs, lambda _, i: i % 2 == k)
    return F.flatten(F.zip_with(half(0), half(1), lambda v, n: F.array_repeat(v, n)))


def write(sets: DataFrame, path: str, runs: bool = False, gzip: bool = False) -> None:
    """Writes (id, pos array) as a table of packed sets; gzip compresses the files."""
    data = packed(F.col("pos"))
    held = sets.select("id", (to_binary(run_codes(from_binary(data))) if runs else data).alias("data"), F.lit(runs).alias("runs"))
    held.write.mode("overwrite").option("compression", "gzip" if gzip else "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """id and pos of a written table."""
    codes = from_binary(F.col("data"))
    return spark.read.parquet(path).select("id", positions(F.when(F.col("runs"), unrun(codes)).otherwise(codes)).alias("pos"))
