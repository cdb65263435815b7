"""Model files of several formats behind one reader: the format is found by extension, else by the first bytes.

A parser takes a file's bytes and yields (name, format, dims, bytes) of each segment. Files are read by Spark, one row a file and
then one row a segment; a parser runs once a file, in the task that holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import models as M
from bitloom.sources import gguf, onnx, torch_zip


def _gguf(raw: bytes) -> Iterator[tuple]:
    metadata, found = gguf.parse(raw)
    yield from gguf.own_segments(metadata)
    yield from found


PARSERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"gguf": _gguf, "onnx": onnx.segments, "pytorch": torch_zip.segments}
#: Kinds that a format's own segments have; others follow from name and type. Fixed values.
OWN_KINDS = {**gguf.OWN_KINDS, "model_metadata": "METADATA_JSON", "model_structure": "GRAPH_STRUCTURE_PROTO"}
SEGMENTS_AT_A_TIME = 16


def format_of(path, content):
    """The format by the extension, else by the first bytes; "unknown" where neither tells."""
    by_name = M.file_format(path)
    return F.when(by_name != "unknown", by_name).otherwise(M.format_of_bytes(content))


def segments_of(files: DataFrame) -> DataFrame:
    """path, format, name, data_format, dims, data of each segment of files (path, content). Files of a format that has no
    parser here are an error, as rows must not vanish silently; a file that is broken is an error as well."""

    def run(batches):
        for batch in batches:
            for path, label, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if label not in PARSERS:
                    raise ValueError(f"no parser for {path} of format {label}")
                part: list[tuple] = []
                for row in PARSERS[label](content.as_py()):
                    part.append(row)
                    if len(part) == SEGMENTS_AT_A_TIME:
                        yield _batch(path, label, part)
                        part = []
                if part:
                    yield _batch(path, label, part)

    def _batch(path, label, part):
        name, kind, dims, data = zip(*part)
        arrays = [pa.array([path] * len(part)), pa.array([label] * len(part)), pa.array(name), pa.array(kind), pa.array(dims, pa.list_(pa.int64())), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["path", "format", "name", "data_format", "dims", "data"])

    labelled = files.select("path", format_of(F.col("path"), F.col("content")).alias("format"), "content")
    return labelled.mapInArrow(run, "path string, format string, name string, data_format string, dims array<long>, data binary")


def with_kinds(segments: DataFrame) -> DataFrame:
    """Adds kind, layer_name and layer_index. Unsigned bytes count as 8-bit weights."""
    own = F.try_element_at(F.create_map(*(F.lit(x) for kv in OWN_KINDS.items() for x in kv)), F.col("name"))
    by_rule = M.segment_kind(F.col("name"), F.when(F.col("data_format") == "u8", "i8").otherwise(F.col("data_format")))
    return segments.withColumns({"kind": F.coalesce(own, by_rule), "layer_name": M.strip_suffix(F.col("name")), "layer_index": M.layer_index(F.col("name"))})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Segments of all model files at a path."""
    return with_kinds(segments_of(spark.read.format("binaryFile").load(path)))


def by_layer(segments: DataFrame) -> DataFrame:
    """Segments in reading order: within each file by layer, kind and name."""
    return segments.orderBy("path", "layer_index", "kind", "name")
