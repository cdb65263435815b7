"""Model files of the PyTorch zip format: tensors of a state dictionary, read without that library.

The pickled part of a file is read by an unpickler that knows the few names state dictionaries are made of; any other name is
kept as an inert object and nothing of it is called, so that a file can not run code.
"""

from __future__ import annotations

import io
import pickle
import struct
import zipfile
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np

#: Storage class -> (format, bytes of a value). Fixed values.
STORAGES = {
    "FloatStorage": ("f32", 4), "DoubleStorage": ("f64", 8), "HalfStorage": ("f16", 2), "BFloat16Storage": ("bf16", 2), "CharStorage": ("i8", 1), "ByteStorage": ("u8", 1),
    "ShortStorage": ("i16", 2), "IntStorage": ("i32", 4), "LongStorage": ("i64", 8), "BoolStorage": ("bool", 1),
}


class _Inert:
    """Stands for any class or function that is not needed."""

    def __init__(self, *_, **__):
        pass

    def __setstate__(self, _):
        pass


class _Tensor:
    def __init__(self, storage, offset, size, stride, *_):
        self.storage, self.offset, self.size, self.stride = storage, offset, tuple(size), tuple(stride)


class _Unpickler(pickle.Unpickler):
    def find_class(self, module, name):
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _Tensor
        if (module, name) == ("torch._utils", "_rebuild_parameter"):
            return lambda data, *_: data
        if module == "torch" and name in STORAGES:
            return name
        return _Inert

    def persistent_load(self, pid):
        if not isinstance(pid, tuple) or len(pid) < 5 or pid[1] not in STORAGES:
            raise ValueError(f"storage {pid!r}")
        return pid[1], str(pid[2])


def _walk(value, prefix: str) -> Iterator[tuple[str, _Tensor]]:
    """Tensors in nested dictionaries and lists; names are joined by dots."""
    if isinstance(value, _Tensor):
        yield prefix or "tensor", value
    elif isinstance(value, (dict, list, tuple)):
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from _walk(v, f"{prefix}.{k}" if prefix else str(k))


def _bytes(t: _Tensor, stored: bytes, width: int) -> bytes:
    """A tensor's values in row order, whatever its strides."""
    n = int(np.prod(t.size, dtype=np.int64))
    if n == 0:
        return b""
    if len(t.stride) != len(t.size) or t.offset < 0 or min(t.stride, default=0) < 0:
        raise ValueError("offset or strides of a tensor")
    last = t.offset + sum((d - 1) * s for d, s in zip(t.size, t.stride))
    if (last + 1) * width > len(stored):
        raise ValueError("a tensor lies beyond the end of its storage")
    whole = np.frombuffer(stored, f"V{width}", len(stored) // width)
    return np.lib.stride_tricks.as_strided(whole[t.offset :], t.size, [s * width for s in t.stride]).tobytes()


def segments(raw: bytes) -> Iterator[tuple[str, str, list[int], bytes]]:
    """(name, format, dims, bytes) of each tensor."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as broken:
        raise ValueError("not a zip file") from broken
    with archive:
        root = next((n[: -len("data.pkl")] for n in archive.namelist() if n == "data.pkl" or n.endswith("/data.pkl")), None)
        if root is None:
            raise ValueError("there is no data.pkl")
        state = _Unpickler(io.BytesIO(archive.read(root + "data.pkl"))).load()
        for name, t in _walk(state, ""):
            label, width = STORAGES[t.storage[0]]
            yield name, label, list(t.size), _bytes(t, archive.read(f"{root}data/{t.storage[1]}"), width)


def dump(tensors: list[tuple[str, str, list[int], list[int], int, bytes]]) -> bytes:
    """A small file of (name, format, dims, strides, offset, storage)."""
    classes = {label: name for name, (label, _) in STORAGES.items()}
    text = lambda s: b"X" + struct.pack("<I", len(s.encode())) + s.encode()
    number = lambda n: b"J" + struct.pack("<i", n)
    many = lambda ns: b"(" + b"".join(map(number, ns)) + b"t"
    empty = b"ccollections\nOrderedDict\n)R"
    out = b"\x80\x02" + empty + b"("
    for i, (name, label, dims, strides, offset, data) in enumerate(tensors):
        stored = b"(" + text("storage") + b"ctorch\n" + classes[label].encode() + b"\n" + text(str(i)) + text("cpu") + number(len(data)) + b"tQ"
        out += text(name) + b"ctorch._utils\n_rebuild_tensor_v2\n(" + stored + number(offset) + many(dims) + many(strides) + b"\x89" + empty + b"tR"
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("archive/data.pkl", out + b"u.")
        for i, t in enumerate(tensors):
            z.writestr(f"archive/data/{i}", t[5])
    return whole.getvalue()
