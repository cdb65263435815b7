"""Image, audio and video coders with numpy, row by row."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: As objects: type strings would need a session when this module is imported.
_CODES = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("c", T.DoubleType())]))
_SIZES = T.StructType([*(T.StructField(n, T.LongType()) for n in ("phrases", "marked", "runs")), T.StructField("same", T.BooleanType())])

SIDE, KEPT = 8, 10
_N = np.arange(SIDE)
_BASIS = np.sqrt(np.where(_N == 0, 1.0, 2.0) / SIDE)[:, None] * np.cos(np.pi * (2 * _N[None, :] + 1) * _N[:, None] / (2 * SIDE))


def dct(block: np.ndarray) -> np.ndarray:
    """Two-dimensional cosine transform of an 8 x 8 block."""
    return _BASIS @ block @ _BASIS.T


def idct(coefficients: np.ndarray) -> np.ndarray:
    return _BASIS.T @ coefficients @ _BASIS


def strongest(block: np.ndarray, kept: int = KEPT) -> list[tuple[int, float]]:
    """(index, value) of the largest coefficients, the lower index first on ties."""
    flat = dct(block).ravel()
    order = np.lexsort((np.arange(flat.size), -np.abs(np.round(flat, 8))))[:kept]
    return [(int(i), float(flat[i])) for i in order]


@F.pandas_udf(_CODES)
def dct_codes(x: pd.Series) -> pd.Series:
    """Strongest coefficients of vectors of 64 as 8 x 8 blocks."""
    return x.map(lambda v: [{"idx": i, "c": c} for i, c in strongest(np.asarray(v, dtype=float).reshape(SIDE, SIDE))] if v is not None else None)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum(x: pd.Series) -> pd.Series:
    """Magnitudes of the Fourier transform, from the mean up to half the rate; any length keeps all its samples."""
    return x.map(lambda v: np.abs(np.fft.rfft(np.asarray(v, dtype=float))).tolist() if v is not None else None)


@F.pandas_udf(T.BooleanType())
def gzip_same(data: pd.Series) -> pd.Series:
    """Whether bytes come back from gzip as they were."""
    return data.map(lambda x: x is None or gzip.decompress(gzip.compress(x, 6)) == x)


def image_format(content: Column) -> Column:
    """png, jpeg, bmp or unknown by the first bytes."""
    h = F.hex(F.substring(content, 1, 4))
    return F.when(h == "89504E47", "png").when(F.substring(h, 1, 6) == "FFD8FF", "jpeg").when(F.substring(h, 1, 4) == "424D", "bmp").otherwise("unknown")


def png_size(content: Column) -> Column:
    """(width, height) from a PNG header."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.struct(number(17).alias("width"), number(21).alias("height"))


def pixel_runs(data: bytes) -> list[int]:
    """Length of the data, then value << 16 | count of each run (65,535 at most)."""
    out, raw = [len(data)], np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(raw)) + 1 if len(raw) else np.empty(0, dtype=int)
    for part in np.split(raw, edges):
        for at in range(0, len(part), 65_535):
            out.append(int(part[0]) << 16 | min(65_535, len(part) - at))
    return out


def pixels_of_runs(codes: list[int]) -> bytes:
    return b"".join(bytes([c >> 16 & 255]) * (c & 65_535) for c in codes[1:])[: codes[0]]


def phrase_codes(data: bytes, most: int = 4096) -> list[int]:
    """Dictionary codes: the longest known phrase, which the next byte extends to a new one until the dictionary is full."""
    known = {bytes([b]): b for b in range(256)}
    out, phrase = [], b""
    for b in data:
        longer = phrase + bytes([b])
        if longer in known:
            phrase = longer
            continue
        out.append(known[phrase])
        if len(known) < most:
            known[longer] = len(known)
        phrase = bytes([b])
    return [*out, known[phrase]] if phrase else out


def phrases_of(codes: list[int], most: int = 4096) -> bytes:
    """Inverse of phrase_codes."""
    known, out, before = {b: bytes([b]) for b in range(256)}, [], b""
    for c in codes:
        phrase = known[c] if c in known else before + before[:1]
        if before and len(known) < most:
            known[len(known)] = before + phrase[:1]
        out.append(phrase)
        before = phrase
    return b"".join(out)


MARK = 0xFF


def marked_runs(data: bytes) -> bytes:
    """Runs of more than three equal bytes as mark, count, byte. A literal mark is written as a run, so that decoding is exact."""
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 255 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n > 3 or data[at] == MARK:
            out += bytes((MARK, n, data[at]))
        else:
            out += data[at : at + n]
        at += n
    return bytes(out)


def unmarked(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        if data[at] == MARK and at + 2 < len(data):
            out += bytes([data[at + 2]]) * data[at + 1]
            at += 3
        else:
            out.append(data[at])
            at += 1
    return bytes(out)


@F.pandas_udf(_SIZES)
def video_sizes(data: pd.Series) -> pd.DataFrame:
    """Sizes of each coder's output, and whether all of them give the bytes back."""
    rows = []
    for x in data:
        raw = bytes(x or b"")
        codes, marked, runs = phrase_codes(raw), marked_runs(raw), pixel_runs(raw)
        rows.append((len(codes), len(marked), len(runs), phrases_of(codes) == raw and unmarked(marked) == raw and pixels_of_runs(runs) == raw))
    return pd.DataFrame(rows, columns=["phrases", "marked", "runs", "same"])
