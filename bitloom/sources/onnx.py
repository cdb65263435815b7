"""Model files of the ONNX format: initializers, metadata and graph, read from the protobuf wire format without a library.

Field numbers and element types are those of the public ONNX schema. A tensor whose values lie in another file has null data.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Number of an element type -> (name, numpy type, field of the typed values). Fixed values.
TYPES = {
    1: ("f32", "<f4", 4), 2: ("u8", "u1", 5), 3: ("i8", "i1", 5), 4: ("u16", "<u2", 5), 5: ("i16", "<i2", 5), 6: ("i32", "<i4", 5), 7: ("i64", "<i8", 7), 9: ("bool", "u1", 5),
    10: ("f16", "<u2", 5), 11: ("f64", "<f8", 10), 12: ("u32", "<u4", 11), 13: ("u64", "<u8", 11), 16: ("bf16", "<u2", 5),
}
NODE_SCHEMA = "path string, position long, name string, op_type string, inputs array<string>, outputs array<string>, attributes string"


def varint(raw, at: int) -> tuple[int, int]:
    """A base-128 number and the place after it."""
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("the file ends early")
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fields(raw) -> Iterator[tuple[int, int, object]]:
    """(field number, wire type, value) of a message; values of length-delimited fields are views, not copies."""
    at, end = 0, len(raw)
    while at < end:
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        else:
            if kind == 2:
                size, at = varint(raw, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            if at + size > end:
                raise ValueError("the file ends early")
            value, at = raw[at : at + size], at + size
        yield key >> 3, kind, value


def grouped(raw) -> dict[int, list]:
    """Field number -> values in order."""
    out: dict[int, list] = {}
    for number, _, value in fields(raw):
        out.setdefault(number, []).append(value)
    return out


def _text(values: list | None) -> str:
    return bytes(values[-1]).decode("utf-8", "replace") if values else ""


def _numbers(raw, wanted: int) -> list[int]:
    """Whole numbers of a repeated field, packed or not."""
    out = []
    for number, kind, value in fields(raw):
        if number == wanted and kind == 0:
            out.append(signed(value))
        elif number == wanted:
            at = 0
            while at < len(value):
                n, at = varint(value, at)
                out.append(signed(n))
    return out


def tensor(raw) -> tuple[str, str, list[int], bytes | None]:
    """(name, format, dims, little-endian bytes) of a tensor message."""
    f = grouped(raw)
    name, kind = _text(f.get(8)), f.get(2, [0])[-1]
    if kind not in TYPES:
        raise ValueError(f"element type {kind} of {name}")
    label, dtype, field = TYPES[kind]
    dims = _numbers(raw, 1)
    if f.get(14, [0])[-1] == 1:
        return name, label, dims, None
    if 9 in f:
        data = bytes(f[9][-1])
    elif field in (4, 10):
        data = b"".join(bytes(v) for v in f.get(field, []))
    else:
        data = np.array(_numbers(raw, field), "<i8").astype(dtype).tobytes() if field != 11 else np.array([n & (1 << 64) - 1 for n in _numbers(raw, field)], "<u8").astype(dtype).tobytes()
    n = 1
    for x in dims:
        n *= x
    if len(data) != n * np.dtype(dtype).itemsize:
        raise ValueError(f"{name} has {len(data)} bytes for {n} values")
    return name, label, dims, data


def _attribute(raw) -> tuple[str, object]:
    f = grouped(raw)
    kind = f.get(20, [0])[-1]
    if kind == 1:
        value: object = struct.unpack("<f", f.get(2, [bytes(4)])[-1])[0]
    elif kind == 2:
        value = signed(f.get(3, [0])[-1])
    elif kind == 3:
        value = _text(f.get(4))
    elif kind == 6:
        value = np.frombuffer(b"".join(bytes(v) for v in f.get(7, [])), "<f4").tolist()
    elif kind == 7:
        value = _numbers(raw, 8)
    elif kind == 8:
        value = [bytes(v).decode("utf-8", "replace") for v in f.get(9, [])]
    else:
        value = None
    return _text(f.get(1)), value


def _value_shape(raw) -> tuple[str, list]:
    """Name and dims (numbers, or names of free dimensions) of an input, output or inner value."""
    f = grouped(raw)
    shape: list = []
    for t in f.get(2, []):
        for tensor_type in grouped(t).get(1, []):
            for s in grouped(tensor_type).get(2, []):
                for dim in grouped(s).get(1, []):
                    d = grouped(dim)
                    shape.append(signed(d[1][-1]) if 1 in d else _text(d.get(2)) or None)
    return _text(f.get(1)), shape


def _graph(raw) -> dict[int, list]:
    model = grouped(raw)
    if 7 not in model:
        raise ValueError("not an ONNX model: there is no graph")
    return grouped(model[7][-1])


def nodes(raw: bytes) -> list[tuple[int, str, str, list[str], list[str], str]]:
    """(position, name, operator, inputs, outputs, attributes as JSON) of each node."""
    out = []
    for i, node in enumerate(_graph(memoryview(raw)).get(1, [])):
        f = grouped(node)
        names = [[bytes(v).decode("utf-8", "replace") for v in f.get(k, [])] for k in (1, 2)]
        attributes = dict(map(_attribute, f.get(5, [])))
        out.append((i, _text(f.get(3)), _text(f.get(4)), names[0], names[1], json.dumps(attributes, sort_keys=True)))
    return out


def segments(raw: bytes) -> Iterator[tuple[str, str, list[int], bytes | None]]:
    """model_metadata, model_structure (dims: nodes, initializers, inputs, outputs) and the initializers of a model."""
    view = memoryview(raw)
    model, graph = grouped(view), _graph(view)
    opset = next((signed(v[-1]) for o in model.get(8, []) if (v := grouped(o).get(2))), None)
    properties = {_text(p.get(1)): _text(p.get(2)) for p in map(grouped, model.get(14, []))}
    about = {"producer": _text(model.get(2)), "domain": _text(model.get(4)), "ir_version": signed(model.get(1, [0])[-1]), "opset": opset, "properties": properties}
    yield "model_metadata", "json", [], json.dumps(about, sort_keys=True).encode()
    shapes = dict(_value_shape(v) for k in (11, 12, 13) for v in graph.get(k, []))
    counts = [len(graph.get(k, [])) for k in (1, 5, 11, 12)]
    yield "model_structure", "graph", counts, json.dumps({"name": _text(graph.get(2)), "nodes": [n[1:5] for n in nodes(raw)], "shapes": shapes}, sort_keys=True).encode()
    yield from map(tensor, graph.get(5, []))


def nodes_of(files: DataFrame) -> DataFrame:
    """The nodes of each model among files (path, content), in the order of the graph."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = nodes(content.as_py())
                if found:
                    columns = list(zip(*found))
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
                    names = ["path", "position", "name", "op_type", "inputs", "outputs", "attributes"]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=names)

    return files.select("path", "content").mapInArrow(run, NODE_SCHEMA)


def _put(number: int, value) -> bytes:
    """One field: a whole number, or bytes or text."""

    def base128(n: int) -> bytes:
        out = bytearray()
        n &= (1 << 64) - 1
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    if isinstance(value, int):
        return base128(number << 3) + base128(value)
    value = value.encode() if isinstance(value, str) else value
    return base128(number << 3 | 2) + base128(len(value)) + value


def dump(tensors: list[tuple[str, str, list[int], bytes]], graph_nodes: list[tuple[str, str, list[str], list[str], dict[str, int]]] = (), producer: str = "bitloom") -> bytes:
    """A small model: tensors as raw bytes, nodes (name, operator, inputs, outputs, whole-number attributes)."""
    numbers = {label: n for n, (label, _, _) in TYPES.items()}
    body = b""
    for name, op, inputs, outputs, attributes in graph_nodes:
        node = b"".join(_put(1, x) for x in inputs) + b"".join(_put(2, x) for x in outputs) + _put(3, name) + _put(4, op)
        body += _put(1, node + b"".join(_put(5, _put(1, k) + _put(3, v) + _put(20, 2)) for k, v in attributes.items()))
    body += _put(2, "graph")
    for name, label, dims, data in tensors:
        body += _put(5, b"".join(_put(1, d) for d in dims) + _put(2, numbers[label]) + _put(8, name) + _put(9, data))
    return _put(1, 8) + _put(2, producer) + _put(8, _put(2, 17)) + _put(7, body)
