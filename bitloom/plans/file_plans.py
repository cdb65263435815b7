"""Queries of model files in several formats: one small file for each vector, in a format that its number decides."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from bitloom.functions import models as M
from bitloom.functions.blocks import decode_segments
from bitloom.plans.registry import query
from bitloom.sources import gguf, model_files, onnx, torch_zip
from bitloom.sources.tables import vectors


def _model(i: int, data: bytes) -> tuple[str, bytes]:
    """Name and bytes of the file of vector i: formats by turns, the third with a transposed tensor."""
    depth = i % 22
    if i % 3 == 0:
        return f"m-{i}.gguf", gguf.dump({"general.name": f"m{i}"}, [(f"blk.{depth}.ffn_up.weight", "f32", [8, 8], data)])
    if i % 3 == 1:
        weight = f"h.{depth}.attn.weight"
        nodes = [("mm", "MatMul", ["x", weight], ["y"], {}), ("act", "Softmax", ["y"], ["z"], {"axis": -1})]
        return f"m-{i}.onnx", onnx.dump([(weight, "f32", [8, 8], data), ("shape", "i64", [2], bytes(16))], nodes)
    return f"m-{i}.pt", torch_zip.dump([(f"layers.{depth}.mlp.weight", "f32", [8, 8], [1, 8], 0, data)])


def _files(spark, d):
    def run(batches):
        import numpy as np

        for batch in batches:
            made = [_model(i, np.array(v, "<f4").tobytes()) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made]), pa.array([b for _, b in made], pa.binary())], names=["path", "content"])

    return vectors(spark, d).select("vec_id", "x").mapInArrow(run, "path string, content binary")


_PATH = "'m-' || vec_id || ['.gguf', '.onnx', '.pt'][vec_id % 3 + 1]"
_NAME = "CASE vec_id % 3 WHEN 0 THEN 'blk.' || vec_id % 22 || '.ffn_up.weight' WHEN 1 THEN 'h.' || vec_id % 22 || '.attn.weight' ELSE 'layers.' || vec_id % 22 || '.mlp.weight' END"


@query("model_file_segments", f"""
    SELECT {_PATH} AS path, ['gguf', 'onnx', 'pytorch'][vec_id % 3 + 1] AS format, {_NAME} AS name, CASE WHEN vec_id % 3 = 1 THEN 'ATTENTION_WEIGHTS' ELSE 'FEED_FORWARD_WEIGHTS' END AS kind, CAST(vec_id % 22 AS BIGINT) AS layer, [8, 8]::BIGINT[] AS dims, CAST(256 AS BIGINT) AS bytes FROM embeddings
    UNION ALL SELECT {_PATH}, 'onnx', 'shape', 'UNKNOWN', 0, [2], 16 FROM embeddings WHERE vec_id % 3 = 1
    UNION ALL SELECT {_PATH}, 'onnx', 'model_structure', 'GRAPH_STRUCTURE_PROTO', 0, [2, 2, 0, 0], NULL FROM embeddings WHERE vec_id % 3 = 1""")
def model_file_segments(spark, d):
    """Tensors and graphs of files of three formats, found by one reader."""
    s = model_files.with_kinds(model_files.segments_of(_files(spark, d))).filter(~F.col("kind").isin("METADATA_JSON", "CONFIG", "TOKENIZER_VOCAB", "TOKENIZER_MODEL"))
    size = F.when(F.col("kind") != "GRAPH_STRUCTURE_PROTO", F.octet_length("data")).cast("long")
    return s.select("path", "format", "name", "kind", F.col("layer_index").alias("layer"), "dims", size.alias("bytes"))


@query("model_file_values", f"WITH v AS (SELECT vec_id, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j FROM embeddings) SELECT {_PATH} AS path, CASE WHEN vec_id % 3 = 2 THEN j % 8 * 8 + j // 8 ELSE j END AS i, v::DOUBLE AS v FROM v")
def model_file_values(spark, d):
    """Values of the tensors in row order, whatever the strides they are stored with."""
    s = model_files.segments_of(_files(spark, d)).filter(F.col("data_format") == "f32").select(F.col("path").alias("name"), "data_format", "data")
    return decode_segments(s).select(F.col("name").alias("path"), F.posexplode("x").alias("i", "v")).select("path", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


@query("onnx_nodes", """
    SELECT 'm-' || vec_id || '.onnx' AS path, p AS position, ['mm', 'act'][p + 1] AS name, ['LINEAR', 'Softmax'][p + 1] AS layer_type, CASE p WHEN 0 THEN ['x', 'h.' || vec_id % 22 || '.attn.weight'] ELSE ['y'] END AS inputs, [['y'], ['z']][p + 1] AS outputs, ['{}', '{"axis": -1}'][p + 1] AS attributes
    FROM embeddings, (SELECT unnest([0, 1]::BIGINT[]) AS p) WHERE vec_id % 3 = 1""")
def onnx_nodes(spark, d):
    """Nodes of graphs in order, with the layer types of their operators where those are known."""
    n = onnx.nodes_of(_files(spark, d).filter(M.file_format(F.col("path")) == "onnx"))
    return n.select("path", "position", "name", M.layer_type(F.col("op_type")).alias("layer_type"), "inputs", "outputs", "attributes")
