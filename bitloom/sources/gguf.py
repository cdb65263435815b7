"""Model files of the GGUF format: a reader over Spark's binary files, and a writer of small files.

Files are read by Spark (any store it reads), one row a tensor. Spark gives a file as one binary value, so a file may hold at
most 2 GiB; larger models come in parts, which `parts` lists with their completeness.
"""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import models as M

#: Number of an element type -> (name, values of a block, bytes of a block). Fixed values.
TYPES = {
    0: ("f32", 1, 4), 1: ("f16", 1, 2), 2: ("q4_0", 32, 18), 3: ("q4_1", 32, 20), 6: ("q5_0", 32, 22), 7: ("q5_1", 32, 24), 8: ("q8_0", 32, 34), 9: ("q8_1", 32, 36),
    10: ("q2_k", 256, 84), 11: ("q3_k", 256, 110), 12: ("q4_k", 256, 144), 13: ("q5_k", 256, 176), 14: ("q6_k", 256, 210), 15: ("q8_k", 256, 292),
    24: ("i8", 1, 1), 25: ("i16", 1, 2), 26: ("i32", 1, 4), 27: ("i64", 1, 8), 28: ("f64", 1, 8), 30: ("bf16", 1, 2),
}
#: Number of a metadata type -> struct code; 8 is a string, 9 an array. Fixed values.
_SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
SCHEMA = "path string, name string, data_format string, dims array<long>, data binary"


class _Cursor:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, code: str):
        size = struct.calcsize("<" + code)
        if self.at + size > len(self.raw):
            raise ValueError("the file ends early")
        value = struct.unpack_from("<" + code, self.raw, self.at)[0]
        self.at += size
        return value

    def text(self) -> str:
        n = self.take("Q")
        if self.at + n > len(self.raw):
            raise ValueError("the file ends early")
        self.at += n
        return self.raw[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.take("I"), self.take("Q")
            return [self.value(inner) for _ in range(n)]
        return self.take(_SCALARS[kind])


def parse(raw: bytes) -> tuple[dict, list[tuple[str, str, list[int], bytes]]]:
    """Metadata, and (name, format, dims, bytes) of each tensor."""
    c = _Cursor(raw)
    if raw[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    c.at = 4
    version, tensors, pairs = c.take("I"), c.take("Q"), c.take("Q")
    if version not in (2, 3):
        raise ValueError(f"GGUF version {version}")
    metadata = {}
    for _ in range(pairs):
        key = c.text()
        metadata[key] = c.value(c.take("I"))
    infos = []
    for _ in range(tensors):
        name = c.text()
        dims = [c.take("Q") for _ in range(c.take("I"))]
        infos.append((name, c.take("I"), dims, c.take("Q")))
    align = int(metadata.get("general.alignment", 32))
    start = -(-c.at // align) * align
    out = []
    for name, kind, dims, offset in infos:
        if kind not in TYPES:
            raise ValueError(f"element type {kind} of {name}")
        label, block, size = TYPES[kind]
        n = 1
        for x in dims:
            n *= x
        at, length = start + offset, -(-n // block) * size
        if at + length > len(raw):
            raise ValueError(f"{name} lies beyond the end of the file")
        out.append((name, label, dims, raw[at : at + length]))
    return metadata, out


def dump(metadata: dict, tensors: list[tuple[str, str, list[int], bytes]], align: int = 32) -> bytes:
    """A file of text, number, boolean and text-list metadata and tensors."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()

    def value(v) -> bytes:
        if isinstance(v, bool):
            return struct.pack("<I?", 7, v)
        if isinstance(v, int):
            return struct.pack("<Iq", 11, v)
        if isinstance(v, float):
            return struct.pack("<Id", 12, v)
        if isinstance(v, list):
            return struct.pack("<IIQ", 9, 8, len(v)) + b"".join(map(text, v))
        return struct.pack("<I", 8) + text(v)

    numbers = {name: n for n, (name, _, _) in TYPES.items()}
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(metadata)) + b"".join(text(k) + value(v) for k, v in metadata.items())
    at, body = 0, b""
    for name, label, dims, data in tensors:
        head += text(name) + struct.pack(f"<I{len(dims)}Q", len(dims), *dims) + struct.pack("<IQ", numbers[label], at)
        body += data + b"\0" * (-len(data) % align)
        at = len(body)
    return head + b"\0" * (-len(head) % align) + body


def own_segments(metadata: dict) -> list[tuple[str, str, list[int], bytes]]:
    """Segments made of the metadata: all of it, the settings, the token list and the rest of the tokenizer."""
    small = {k: v for k, v in metadata.items() if not isinstance(v, list)}
    tokens = metadata.get("tokenizer.ggml.tokens", [])
    rest = {k: v for k, v in metadata.items() if k.startswith("tokenizer.") and k != "tokenizer.ggml.tokens"}
    whole = {k: v if not isinstance(v, list) else len(v) for k, v in metadata.items()}
    return [
        ("gguf_metadata", "json", [], json.dumps(whole, sort_keys=True).encode()), ("gguf_config", "json", [], json.dumps({k: v for k, v in small.items() if not k.startswith("tokenizer.")}, sort_keys=True).encode()),
        ("tokenizer_vocab", "text", [], "\n".join(map(str, tokens)).encode()), ("tokenizer_model", "json", [], json.dumps(rest, sort_keys=True).encode()),
    ]


def tensors_of(files: DataFrame) -> DataFrame:
    """path, name, data_format, dims, data of each segment of files (path, content)."""

    def run(batches):
        for batch in batches:
            paths, contents = batch.column(0).to_pylist(), batch.column(1)
            for i, path in enumerate(paths):
                metadata, found = parse(contents[i].as_py())
                rows = [*own_segments(metadata), *found]
                for at in range(0, len(rows), 16):
                    part = rows[at : at + 16]
                    name, label, dims, data = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array(name), pa.array(label), pa.array(dims, pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["path", "name", "data_format", "dims", "data"]
                    )

    return files.select("path", "content").mapInArrow(run, SCHEMA)


OWN_KINDS = {"gguf_metadata": "METADATA_JSON", "gguf_config": "CONFIG", "tokenizer_vocab": "TOKENIZER_VOCAB", "tokenizer_model": "TOKENIZER_MODEL"}


def with_kinds(segments: DataFrame) -> DataFrame:
    """Adds kind, layer_name and layer_index by the name rules."""
    own = F.try_element_at(F.create_map(*(F.lit(x) for kv in OWN_KINDS.items() for x in kv)), F.col("name"))
    return segments.withColumns({"kind": F.coalesce(own, M.segment_kind(F.col("name"), F.col("data_format"))), "layer_name": M.strip_suffix(F.col("name")), "layer_index": M.layer_index(F.col("name"))})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all GGUF files at a path."""
    return with_kinds(tensors_of(spark.read.format("binaryFile").load(path)))


def parts(files: DataFrame) -> DataFrame:
    """Models in parts among files (path): base, parts, found, complete."""
    pattern = r"^(.+)-([0-9]+)-of-([0-9]+)(\.[^/]+)$"
    get = lambda i: F.regexp_extract("path", pattern, i)
    m = files.filter(F.col("path").rlike(pattern)).select(get(1).alias("base"), get(2).cast("long").alias("part"), get(3).cast("long").alias("parts")).distinct()
    here = F.count(F.when(F.col("part").between(1, F.col("parts")), 1))
    return m.groupBy("base", "parts").agg(here.alias("found"), (here == F.col("parts")).alias("complete"))
