"""Tensor kernels: activations, norms, products, convolutions, pooling, attention.

A vector that fits a row is an array column (`x`), and what needs only that vector stays inside the row. Matrices that
exceed a row are long, (i, j, v), and products are joins with partial sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.base import let, total

_GELU = math.sqrt(2 / math.pi)


def relu(v: Column) -> Column:
    return F.greatest(v, F.lit(0.0))


def leaky_relu(v: Column, slope: float = 0.01) -> Column:
    return F.when(v > 0, v).otherwise(v * slope)


def gelu(v: Column) -> Column:
    """Tanh form."""
    return 0.5 * v * (1 + F.tanh(_GELU * (v + 0.044715 * v * v * v)))


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def silu(v: Column) -> Column:
    return v * sigmoid(v)


def elu(v: Column, alpha: float = 1.0) -> Column:
    return F.when(v >= 0, v).otherwise(alpha * (F.exp(v) - 1))


ACTIVATIONS = {"relu": relu, "leaky_relu": leaky_relu, "gelu": gelu, "sigmoid": sigmoid, "tanh": F.tanh, "silu": silu, "elu": elu}


def activation(name: str, v: Column) -> Column:
    """An activation by name; unknown names pass values through."""
    return ACTIVATIONS.get(name.lower(), lambda x: x)(v)


def softmax(x: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    raised = let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
    return let(raised, lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def layer_norm(x: Column, eps: float = 1e-5, gamma: float = 1.0, beta: float = 0.0) -> Column:
    """Normalised by mean and population variance."""
    centred = let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    return let(centred, lambda c: let(F.sqrt(total(F.transform(c, lambda v: v * v)) / F.size(c) + eps), lambda s: F.transform(c, lambda v: gamma * v / s + beta)))


def rms_norm(x: Column, eps: float = 1e-5) -> Column:
    return let(F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + eps), lambda s: F.transform(x, lambda v: v / s))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def finite_dot(x: Column, y: Column) -> Column:
    """Pairs with a NaN or an infinity are left out."""
    ok = lambda v: ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))
    return total(F.zip_with(x, y, lambda a, b: F.when(ok(a) & ok(b), a * b).otherwise(0.0)))


def sanitise(x: Column, most: float = 1000.0) -> Column:
    """Non-finite entries become zero; if the largest magnitude exceeds `most`, all are scaled down to it."""
    clean = F.transform(x, lambda v: F.when(F.isnan(v) | v.isin(float("inf"), float("-inf")), 0.0).otherwise(v))
    return let(clean, lambda c: let(F.greatest(F.abs(F.array_max(c)), F.abs(F.array_min(c))), lambda a: F.transform(c, lambda v: F.when(a > most, v * most / a).otherwise(v))))


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of the product of long matrices (i, k, v) and (k, j, v): a join on k and partial sums."""
    right = b.select(F.col("k").alias("_k"), "j", F.col("v").alias("_w"))
    return a.join(right, a["k"] == F.col("_k")).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def gram(df: DataFrame, width: int) -> DataFrame:
    """(i, j, v) of X^T X for rows `x` of a fixed width.

    Each task sums its batches' products with numpy and gives width^2 partial sums, whatever the number of rows; exploding
    the products instead makes width^2 rows of every vector.
    """

    def run(batches):
        held = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held += x.T @ x
        i, j = np.divmod(np.arange(width * width, dtype=np.int32), width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held.ravel())], names=["i", "j", "v"])

    return df.filter(F.size("x") == width).select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def csr_row_pointers(long: DataFrame, rows: int) -> DataFrame:
    """(row, start, entries) of a sparse matrix (row, col, v) of a known number of rows, empty rows included.

    Row counts are ranked within blocks of rows, so no task sees all of them.
    """
    from bitloom.sources.archive import offsets

    counts = long.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    every = long.sparkSession.range(rows).select(F.col("id").alias("row")).join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("entries"))
    return offsets(every, F.floor(F.col("row") / 65536), "row", "entries").select("row", F.col("place").cast("long").alias("start"), F.col("entries").cast("long").alias("entries"))


def grid(side: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(side) for c in range(side)]


def pool(x: Column, side: int, kind: str = "max") -> Column:
    """2 x 2 windows at stride 2 over a side x side image in row-major order."""
    at = lambda r, c: F.get(x, F.lit(r * side + c))
    out = []
    for r in range(0, side - 1, 2):
        for c in range(0, side - 1, 2):
            four = (at(r, c), at(r, c + 1), at(r + 1, c), at(r + 1, c + 1))
            out.append(F.greatest(*four) if kind == "max" else (four[0] + four[1] + four[2] + four[3]) / 4)
    return F.array(*out)


def conv2d(x: Column, side: int, kernel: list[list[float]], padding: int = 0, stride: int = 1) -> Column:
    """One channel's convolution (cross-correlation) over a side x side image; zeros outside.

    Windows are gathered by position arithmetic inside the row, so nothing is joined.
    """
    k = len(kernel)
    out_side = (side + 2 * padding - k) // stride + 1
    weights = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(kernel[a][b])).alias("w")) for a in range(k) for b in range(k)))

    def cell(o: Column) -> Column:
        top, left = F.floor(o / out_side).cast("int") * stride - padding, (o % out_side) * stride - padding

        def term(acc: Column, w: Column) -> Column:
            r, c = top + w["a"], left + w["b"]
            inside = (r >= 0) & (r < side) & (c >= 0) & (c < side)
            return acc + F.when(inside, F.get(x, r * side + c) * w["w"]).otherwise(0.0)

        return F.aggregate(weights, F.lit(0.0), term)

    return F.transform(F.sequence(F.lit(0), F.lit(out_side * out_side - 1)), cell)


def conv_transpose2d(x: Column, side: int, kernel: list[list[float]], stride: int = 1) -> Column:
    """One channel's transposed convolution without padding: each entry adds its multiple of the kernel at its place.

    An output entry sums the kernel entries that reach it from an input entry, so the row is read and nothing is scattered.
    """
    k = len(kernel)
    out_side = (side - 1) * stride + k
    weights = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(kernel[a][b])).alias("w")) for a in range(k) for b in range(k)))

    def cell(o: Column) -> Column:
        def term(acc: Column, w: Column) -> Column:
            r, c = F.floor(o / out_side).cast("int") - w["a"], o % out_side - w["b"]
            there = (r >= 0) & (c >= 0) & (r % stride == 0) & (c % stride == 0) & (r < side * stride) & (c < side * stride)
            return acc + F.when(there, F.get(x, (F.floor(r / stride) * side + F.floor(c / stride)).cast("int")) * w["w"]).otherwise(0.0)

        return F.aggregate(weights, F.lit(0.0), term)

    return F.transform(F.sequence(F.lit(0), F.lit(out_side * out_side - 1)), cell)


def im2col(x: Column, side: int, k: int) -> Column:
    """Windows of k x k entries in row-major order, one array each, no padding."""
    out = side - k + 1
    offsets = F.array(*(F.lit(a * side + b) for a in range(k) for b in range(k)))
    return F.transform(F.sequence(F.lit(0), F.lit(out * out - 1)), lambda o: F.transform(offsets, lambda w: F.get(x, F.floor(o / out).cast("int") * side + o % out + w)))


def transpose(x: Column, rows: int, cols: int) -> Column:
    """A row-major matrix turned over."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda o: F.get(x, (o % rows) * cols + F.floor(o / rows).cast("int")))


def rope(x: Column, position: Column, theta: float = 1_000_000.0) -> Column:
    """Rotates the pairs (2i, 2i + 1) by position * theta^(-2i / n)."""

    def turned(v: Column, i: Column) -> Column:
        angle = position * F.pow(F.lit(theta), -(F.floor(i / 2) * 2) / F.size(x))
        other = F.get(x, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return F.when(i % 2 == 0, v * F.cos(angle) - other * F.sin(angle)).otherwise(other * F.sin(angle) + v * F.cos(angle))

    return F.transform(x, turned)


def attention(rows: DataFrame, group: list[str], order: str, width: int, causal: bool, heads: int = 1) -> DataFrame:
    """(group, order, head, out array): scaled dot-product attention among the rows `x` of each group.

    A group is a sequence of bounded length (a block of tokens). Keys and values are collected once for each group and joined
    back by group; scores and weights stay inside the row.
    """
    size = width // heads
    kv = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("x").alias("k")))).alias("kv"))
    joined = rows.join(kv, group).withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    part = lambda a: F.slice(a, F.col("head") * size + 1, F.lit(size))
    seen = F.filter("kv", lambda e: e["o"] <= F.col(order)) if causal else F.col("kv")
    own = joined.withColumn("q", part(F.col("x"))).withColumn("seen", F.transform(seen, lambda e: part(e["k"])))
    weights = let(F.transform("seen", lambda k: dot(F.col("q"), k) / math.sqrt(size)), softmax)
    summed = let(weights, lambda w: F.aggregate(F.arrays_zip(w.alias("w"), F.col("seen").alias("k")), F.array_repeat(F.lit(0.0), size), lambda acc, e: F.zip_with(acc, e["k"], lambda a, v: a + e["w"] * v)))
    return own.select(*group, order, "head", summed.alias("out"))


def head_size(width: Column) -> Column:
    """The first of 128, 64, 256, 32, 16 that divides the width; the width itself if none does."""
    rule = F.when(width % 128 == 0, 128)
    for s in (64, 256, 32, 16):
        rule = rule.when(width % s == 0, s)
    return rule.otherwise(width)
