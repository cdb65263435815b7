"""Decoding of block-quantized tensors with numpy, for Arrow batches.

Codes of a block are read in the order of their values: value 2j is the low half of byte j, value 2j + 1 the high half, and
bits beyond four are packed likewise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bitloom.functions.bits import BLOCK_FORMATS


def _half(raw: np.ndarray) -> np.ndarray:
    """Little-endian half-precision numbers of an array of byte pairs."""
    return np.ascontiguousarray(raw).view("<f2").astype(np.float32)


def _fields(raw: np.ndarray, width: int) -> np.ndarray:
    """Codes of 1, 2 or 4 bits, low bits of a byte first."""
    return np.stack([raw >> s & (1 << width) - 1 for s in range(0, 8, width)], axis=-1).reshape(len(raw), -1)


def _scales_and_mins(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight 6-bit scales and mins from twelve bytes: the first four of each stand whole, the others lend their top bits."""
    low, mid, high = packed[:, 0:4], packed[:, 4:8], packed[:, 8:12]
    scales = np.concatenate([low & 63, (high & 15) | (low >> 6) << 4], axis=1)
    mins = np.concatenate([mid & 63, (high >> 4) | (mid >> 6) << 4], axis=1)
    return scales.astype(np.float32), mins.astype(np.float32)


def _k_block(b: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Values of 256 codes with eight scales and mins."""
    scales, mins = _scales_and_mins(b[:, 4:16])
    d, least = _half(b[:, 0:2]), _half(b[:, 2:4])
    return (codes.reshape(-1, 8, 32) * (d * scales)[:, :, None] - (least * mins)[:, :, None]).reshape(len(b), 256)


def dequantize(data: bytes, data_format: str, scale: float = 1.0, zero_point: float = 0.0) -> np.ndarray:
    """The 32-bit values of a tensor's bytes. Bytes that are no whole number of blocks are an error."""
    f = data_format.lower()
    f = {"fp32": "f32", "float32": "f32", "fp16": "f16", "float16": "f16", "half": "f16", "int8": "i8"}.get(f, f)
    if f not in BLOCK_FORMATS:
        raise ValueError(f"no decoder for {data_format}")
    size = BLOCK_FORMATS[f][1]
    if len(data) % size:
        raise ValueError(f"{len(data)} bytes of {f} are no multiple of {size}")
    if f == "f32":
        return np.frombuffer(data, "<f4").copy()
    if f == "f16":
        return np.frombuffer(data, "<f2").astype(np.float32)
    if f == "bf16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)
    if f == "i8":
        return (np.frombuffer(data, np.int8).astype(np.float32) - zero_point) * np.float32(scale)
    b = np.frombuffer(data, np.uint8).reshape(-1, size)
    if f == "q8_0":
        return (b[:, 2:].view(np.int8).astype(np.float32) * _half(b[:, :2])).ravel()
    if f == "q4_0":
        return ((_fields(b[:, 2:], 4).astype(np.float32) - 8) * _half(b[:, :2])).ravel()
    if f == "q4_k":
        return _k_block(b, _fields(b[:, 16:], 4).astype(np.float32)).ravel()
    if f == "q5_k":
        return _k_block(b, (_fields(b[:, 48:], 4) | _fields(b[:, 16:48], 1) << 4).astype(np.float32)).ravel()
    codes = (_fields(b[:, :128], 4) | _fields(b[:, 128:192], 2) << 4).astype(np.float32) - 32
    scales = b[:, 192:208].view(np.int8).astype(np.float32) * _half(b[:, 208:])
    return (codes.reshape(-1, 16, 16) * scales[:, :, None]).ravel()


def quantize_q8(values: np.ndarray, d: float) -> bytes:
    """Blocks of 32 codes with a given step."""
    codes = np.clip(np.rint(values / d), -127, 127).astype(np.int8).reshape(-1, 32)
    head = np.full((len(codes), 1), d, dtype="<f2").view(np.uint8).reshape(-1, 2)
    return np.concatenate([head, codes.view(np.uint8)], axis=1).tobytes()


def decode_segments(segments: DataFrame) -> DataFrame:
    """name and values of segments (name, data_format, data); formats without a decoder give null values."""

    def run(batches):
        for batch in batches:
            names, formats, data = (c.to_pylist() for c in batch.columns)
            values = [dequantize(x, f).tolist() if x is not None and f is not None and f.lower() in BLOCK_FORMATS else None for f, x in zip(formats, data)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.list_(pa.float32()))], names=["name", "x"])

    return segments.select("name", "data_format", "data").mapInArrow(run, "name string, x array<float>")
