"""Bits of half-precision numbers as arithmetic, and sizes of block formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format -> (values of a block, bytes of a block). Fixed values.
BLOCK_FORMATS = {"f32": (1, 4), "f16": (1, 2), "bf16": (1, 2), "i8": (1, 1), "q4_0": (32, 18), "q8_0": (32, 34), "q4_k": (256, 144), "q5_k": (256, 176), "q6_k": (256, 210)}


def from_half(bits: Column) -> Column:
    """The number that 16 bits stand for."""
    sign = F.when(bits.bitwiseAND(0x8000) != 0, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    finite = F.when(exponent == 0, fraction / 1024 * 2.0**-14).otherwise((1 + fraction / 1024) * F.pow(F.lit(2.0), exponent - 15))
    return F.when((exponent == 31) & (fraction != 0), F.lit(float("nan"))).when(exponent == 31, sign * F.lit(float("inf"))).otherwise(sign * finite)


def to_half(v: Column) -> Column:
    """The 16 bits of a number, rounded to the nearest, halves to the even; too large ones are infinite."""
    size = F.abs(v)
    exponent = F.when(size >= 2.0**-14, F.floor(F.log2(F.when(size > 0, size).otherwise(1.0)))).otherwise(-14)
    step = F.pow(F.lit(2.0), exponent - 10)
    units = F.rint(size / step).cast("long")
    held = F.when(size < 2.0**-14, units).otherwise((exponent + 14) * 1024 + units)
    sign = F.when(v < 0, 0x8000).otherwise(0)
    return F.when(F.isnan(v), 0x7E00).when(size >= 65520, sign + 0x7C00).otherwise(sign + held).cast("long")
