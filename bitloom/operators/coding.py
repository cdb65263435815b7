"""Segment codecs that run: each strategy turns a segment's bytes into coded bytes and back, or does not apply.

A segment is coded by the first strategy of its kind, in priority order, that applies and whose result passes the size
limit; raw storage is left otherwise. Segments are coded row by row in Arrow batches, so nothing is shuffled.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from bitloom.sources.archive import ADAPTIVE, GZIP, QUANT, RAW, REGISTERED, RLE

#: Adaptive coding stores segments up to this size, and tokenizers, as they are.
DIRECT = 1024
OPTIONS: dict[str, list[int]] = {}
for _kind, _, _sid in sorted(REGISTERED, key=lambda r: r[1]):
    OPTIONS.setdefault(_kind, []).append(_sid)


def size_limit(n: int, sparsity: float) -> float:
    """Largest coded size that is accepted, in bytes."""
    return n * (2.0 if sparsity >= 0.1 else 1.2 if n < 1024 else 1.0)


def rle(data: bytes) -> bytes:
    """Pairs of a run's length, 255 at most, and its byte."""
    if not data:
        return b""
    x = np.frombuffer(data, dtype=np.uint8)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    runs = np.diff(np.concatenate((starts, [len(x)])))
    parts = -(-runs // 255)
    length = np.full(parts.sum(), 255, dtype=np.int64)
    length[np.cumsum(parts) - 1] = runs - 255 * (parts - 1)
    return np.column_stack([length.astype(np.uint8), np.repeat(x[starts], parts)]).tobytes()


def from_rle(coded: bytes) -> bytes:
    pairs = np.frombuffer(coded, dtype=np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 1], pairs[:, 0]).tobytes()


def varints(values: np.ndarray) -> bytes:
    """Non-negative integers, seven bits in a byte, low bits first."""
    out = bytearray()
    for v in values.tolist():
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def from_varints(coded: bytes) -> list[int]:
    """All integers of a string of varints."""
    out, value, shift = [], 0, 0
    for b in coded:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def adaptive(data: bytes, kind: str) -> bytes:
    """A tag byte, then the bytes themselves (small segments, tokenizers) or the bytes that are not zero with their
    distances from one to the next."""
    if len(data) <= DIRECT or kind.startswith("TOKENIZER"):
        return b"\0" + data
    x = np.frombuffer(data, dtype=np.uint8)
    at = np.flatnonzero(x)
    gaps = varints(np.diff(np.concatenate(([0], at))))
    return b"\1" + struct.pack("<QQ", len(data), len(gaps)) + gaps + x[at].tobytes()


def from_adaptive(coded: bytes) -> bytes:
    if coded[:1] == b"\0":
        return coded[1:]
    n, size = struct.unpack_from("<QQ", coded, 1)
    out = np.zeros(n, dtype=np.uint8)
    out[np.cumsum(np.array(from_varints(coded[17 : 17 + size]), dtype=np.int64))] = np.frombuffer(coded, dtype=np.uint8, offset=17 + size)
    return out.tobytes()


def quant(data: bytes) -> bytes | None:
    """32-bit floats as a scale and symmetric 8-bit codes; None for bytes that are not finite floats."""
    if not data or len(data) % 4:
        return None
    x = np.frombuffer(data, dtype="<f4").astype(np.float64)
    if not np.isfinite(x).all():
        return None
    scale = np.abs(x).max() / 127 or 1.0
    q = x / scale
    return struct.pack("<d", scale) + (np.sign(q) * np.floor(np.abs(q) + 0.5)).astype(np.int8).tobytes()


def from_quant(coded: bytes) -> bytes:
    return (np.frombuffer(coded, dtype=np.int8, offset=8) * struct.unpack_from("<d", coded)[0]).astype("<f4").tobytes()


def encode(data: bytes, kind: str, sparsity: float = 0.02) -> tuple[int, bytes]:
    """The strategy that a segment is stored by, and its coded bytes."""
    for sid in OPTIONS.get(kind, ()):
        if sid == ADAPTIVE:
            coded = adaptive(data, kind)
            if len(coded) - 1 <= size_limit(len(data), sparsity):
                return sid, coded
        elif sid == RLE:
            coded = rle(data)
            if len(coded) < len(data):
                return sid, coded
        elif sid == QUANT:
            coded = quant(data)
            if coded is not None:
                return sid, coded
        elif sid == GZIP:
            return sid, gzip.compress(data, 9, mtime=0)
    return RAW, data


def decode(sid: int, coded: bytes) -> bytes:
    """The bytes of a coded segment; quantized ones within half a step."""
    return {RAW: bytes, ADAPTIVE: from_adaptive, RLE: from_rle, GZIP: gzip.decompress, QUANT: from_quant}[sid](coded)


#: Bytes of segments, or of what they stand for, that are coded at once, and a segment more.
MOST = 4 << 20


def _small(batches, data_at: int, size_at: int | None = None):
    """The batches in slices of at most MOST bytes, or of one segment; sizes are those of a column, or of the data.

    Python then holds a batch and a slice's results, not the results of a batch of ten thousand segments.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(data_at)) if size_at is None else batch.column(size_at), 0).to_pylist()
        first = held = 0
        for i, size in enumerate(sizes):
            if i > first and held + size > MOST:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size
        if first < batch.num_rows:
            yield batch.slice(first)


def compress(segments: DataFrame, sparsity: float = 0.02) -> DataFrame:
    """Segments (kind, data, further columns) with `data` coded, and `strategy` and `original_size` added."""
    data_at, kind_at = segments.columns.index("data"), segments.columns.index("kind")

    def run(batches):
        for batch in _small(batches, data_at):
            coded = [(None, None) if d is None else encode(d, k or "", sparsity) for d, k in zip(batch.column(data_at).to_pylist(), batch.column(kind_at).to_pylist())]
            columns = list(batch.columns)
            sizes = pc.binary_length(columns[data_at]).cast(pa.int64())
            columns[data_at] = pa.array([c for _, c in coded], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s for s, _ in coded], pa.int32()), sizes], names=[*batch.schema.names, "strategy", "original_size"])

    return segments.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema) + ", strategy int, original_size long")


def decompress(coded: DataFrame) -> DataFrame:
    """The segments of compress(), without its two columns."""
    kept = [f for f in coded.schema if f.name not in ("strategy", "original_size")]
    data_at, sid_at, size_at = (coded.columns.index(c) for c in ("data", "strategy", "original_size"))

    def run(batches):
        for batch in _small(batches, data_at, size_at):
            plain = [None if d is None else decode(s, d) for d, s in zip(batch.column(data_at).to_pylist(), batch.column(sid_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(plain, pa.binary()) if f.name == "data" else batch.column(batch.schema.names.index(f.name)) for f in kept], names=[f.name for f in kept])

    return coded.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))
