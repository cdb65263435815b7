"""Dictionary codes, layer graphs, sources and streams."""

import gzip
import io
import os
import random
import struct
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import dictionary as D
from bitloom.operators import layers, ordering
from bitloom.operators import tensors as X
from bitloom.sources import archive, gguf, model_files, onnx, torch_zip
from bitloom.streaming import cache


def test_pursuit_against_a_plain_loop():
    r = np.random.default_rng(2)
    tiles, atoms, scales, k = r.normal(size=(5, 12)), r.normal(size=(9, 12)), D.gammas(2), 3
    chosen, signs = D.pursue(tiles, atoms, scales, k)
    for t in range(5):
        left = tiles[t].copy()
        for s, g in enumerate(scales):
            used = set()
            for j in range(k):
                products = [(-abs(float(left @ a)), i) for i, a in enumerate(atoms) if i not in used]
                _, best = min(products)
                sign = -1 if left @ atoms[best] < 0 else 1
                assert (chosen[t, s, j], signs[t, s, j]) == (best, sign)
                used.add(best)
                left -= g * sign * atoms[best]


def test_fused_product_equals_decoding(spark):
    r = np.random.default_rng(4)
    tiles = spark.createDataFrame([(i, r.normal(size=16).tolist()) for i in range(20)], "tile long, x array<double>")
    scales = D.gammas(3)
    atoms = D.fit(tiles, 8, scales, 2, 4)
    table = spark.createDataFrame([(a, i, float(w)) for a, row in enumerate(atoms) for i, w in enumerate(row)], "atom int, i long, w double")
    codes = D.encode(tiles, atoms, scales, 2).cache()
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r.normal(size=16))], "i long, h double")
    decoded = D.decode(codes, table, scales).join(x, "i").groupBy("tile").agg(F.sum(F.col("v") * F.col("h")).alias("y"))
    dense = {r["tile"]: r["y"] for r in decoded.collect()}
    fused = {r["tile"]: r["y"] for r in D.fused_product(codes, table, x, scales).collect()}
    assert dense.keys() == fused.keys() and all(abs(dense[t] - fused[t]) < 1e-9 for t in dense)


def test_fitting_lowers_the_error(spark):
    from bitloom.plans.registry import QUERIES

    rows = QUERIES["dictionary_fit"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["nmse"] < 0.8 for r in rows)


def test_real_codes_beat_binary_ones():
    r = np.random.default_rng(5)
    atoms = r.normal(size=(20, 16))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    tiles = r.normal(size=(12, 16))
    chosen, c = D.real_codes(tiles, atoms, 4)
    real = np.einsum("nk,nkd->nd", c, atoms[chosen])
    picked, sign = D.binary_codes(tiles, atoms, 4)
    binary = np.einsum("nk,nkd->nd", sign, atoms[picked])
    error = lambda y: ((tiles - y) ** 2).mean()
    assert error(real) < error(D.hybrid_codes(tiles, atoms, 4)) < error(binary) + 1e-9 or error(real) < error(binary)
    assert all(len(set(row)) == 4 for row in chosen.tolist())
    for t in range(12):  # each step takes the atom nearest to what an exact fit of the atoms so far leaves
        left, taken = tiles[t], []
        for j in range(4):
            products = [-1 if a in taken else abs(float(atoms[a] @ left)) for a in range(20)]
            taken.append(int(np.argmax(products)))
            fit = np.linalg.lstsq(atoms[taken].T, tiles[t], rcond=None)[0]
            left = tiles[t] - fit @ atoms[taken]
        assert taken == chosen[t].tolist() and np.allclose(fit, c[t])
    with pytest.raises(ValueError):
        D.real_codes(tiles, atoms, 21)


def test_code_errors_of_zeros_and_of_one_atom(spark):
    atoms = D.walsh(4)
    df = spark.createDataFrame([(1, [0.0] * 4), (2, (3.0 * atoms[2]).tolist())], "tile int, x array<double>")
    got = {r["tile"]: (r["real"], r["binary"], r["hybrid"]) for r in D.code_errors(df, atoms, 1).collect()}
    assert got[1] == (0, 0, 0) and np.allclose(got[2], (0, 4 / 9, 0))


def test_codes_pack_and_unpack(spark):
    df = spark.createDataFrame([(5, 1), (5, -1), (32767, -1), (0, 1)], "a int, s int").withColumn("c", D.pack_code(F.col("a"), F.col("s")))
    assert [r["c"] for r in df.collect()] == [5, 32773, 65535, 0]
    assert [tuple(r[0]) for r in df.select(D.unpack_code(F.col("c"))).collect()] == [(5, 1), (5, -1), (32767, -1), (0, 1)]


def test_graph_order_and_errors():
    g = layers.Graph().add("b", lambda x: x).add("a", lambda x: x).add("c", lambda x, y: x, ["b", "a"])
    assert g.order() == ["a", "b", "c"]
    with pytest.raises(ValueError):
        g.add("a", lambda x: x)
    with pytest.raises(ValueError):
        layers.Graph().add("a", lambda x: x, ["b"]).add("b", lambda x: x, ["a"]).order()
    with pytest.raises(KeyError):
        layers.Graph().add("a", lambda x: x, ["z"]).order()


def test_boundaries_settle_at_the_middles_of_means(spark):
    df = spark.createDataFrame([(float(v),) for v in [1.0] * 50 + [9.0] * 50 + [float("nan"), None] if v is not None], "v double")
    edges = layers.fit_boundaries(df, "v", low=0.0, high=12.0, buckets=2, rounds=2000, tolerance=1e-6, rate=0.05, fade=1.0)
    assert abs(edges[1] - 5.0) < 0.01 and edges[0] == 0.0 and edges[2] == 12.0


def test_tensor_edges(spark):
    x = lambda *v: F.array(*(F.lit(float(a)) for a in v))
    row = spark.range(1).select(X.softmax(x(1000, 1000)), X.cosine(x(0, 0), x(1, 2)), X.sanitise(x("nan", 2000, -500)), X.layer_norm(x(3, 3)), X.rope(x(1, 0), F.lit(0)), X.finite_dot(x("inf", 2), x(1, 3))).first()
    assert row[0] == [0.5, 0.5] and row[1] is None and row[2] == [0.0, 1000.0, -250.0] and row[3] == [0.0, 0.0] and row[4] == [1.0, 0.0] and row[5] == 6.0


def test_ranks_in_two_levels(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = ordering.global_rank(df, F.floor(F.col("v") / 3), [F.col("v")], "r", coarse=4).collect()
    assert all(r["r"] == r["v"] for r in got) and len(got) == 500


SEGMENTS = "name string, kind string, data binary"


def segments(spark, n=6):
    kinds = ["WEIGHTS_FP32", "CONFIG", "TOKENIZER_VOCAB"]
    return spark.createDataFrame([(f"s{i}", kinds[i % 3], bytearray(b"x" * i)) for i in range(n)], SEGMENTS)


def test_archive(spark, tmp_path):
    at = str(tmp_path / "a")
    archive.write(segments(spark), at, skip=F.col("kind") == "CONFIG")
    index = {r["name"]: r["original_size"] for r in archive.read_index(spark, at).collect()}
    assert index == {"s0": 0, "s2": 2, "s3": 3, "s5": 5}
    assert [bytes(r["data"]) for r in archive.read(spark, at, names=["s5"]).collect()] == [b"xxxxx"]
    assert archive.read(spark, at, kinds=["WEIGHTS_FP32"]).count() == 2
    with pytest.raises(KeyError):
        archive.read(spark, at, names=["s1"])
    archive.extract(spark, at, str(tmp_path / "out"))
    assert (tmp_path / "out" / "kind=WEIGHTS_FP32" / "name=s3").is_dir()


def test_streamed_archive(spark, tmp_path):
    segments(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SEGMENTS).parquet(str(tmp_path / "in"))
    at = str(tmp_path / "a")
    archive.stream_to(stream, at, str(tmp_path / "c")).awaitTermination(120)
    assert archive.read_index(spark, at).count() == 6
    segments(spark, 8).filter("name >= 's6'").write.mode("append").parquet(str(tmp_path / "in"))
    archive.stream_to(stream, at, str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r["name"] for r in archive.read_index(spark, at).collect()) == [f"s{i}" for i in range(8)]


def test_gguf_files(spark, tmp_path):
    raw = np.arange(64, dtype="<f4")
    for part in (1, 2):
        whole = gguf.dump({"general.name": "m", "n": 3, "r": 0.5, "ok": True, "tokenizer.ggml.tokens": ["a", "b"]}, [(f"blk.{part}.attn_q.weight", "f32", [8, 8], raw.tobytes()), ("token_embd.weight", "f16", [64], raw.astype("<f2").tobytes())])
        (tmp_path / f"m-0000{part}-of-00003.gguf").write_bytes(whole)
    s = {(r["path"][-20:-14], r["name"]): r for r in gguf.read(spark, str(tmp_path)).collect()}
    assert len(s) == 12
    r = next(r for (_, n), r in s.items() if n == "blk.2.attn_q.weight")
    assert (r["kind"], r["layer_index"], r["layer_name"], r["dims"], bytes(r["data"])) == ("ATTENTION_WEIGHTS", 2, "blk.2.attn_q", [8, 8], raw.tobytes())
    assert next(bytes(r["data"]) for (_, n), r in s.items() if n == "tokenizer_vocab") == b"a\nb"
    p = gguf.parts(spark.read.format("binaryFile").load(str(tmp_path)).select("path")).first()
    assert (p["parts"], p["found"], p["complete"]) == (3, 2, False)


def test_broken_gguf_is_an_error():
    good = gguf.dump({}, [("a", "f32", [2], b"12345678")])
    assert gguf.parse(good)[1] == [("a", "f32", [2], b"12345678")]
    for bad in (b"", b"GGUX" + good[4:], good[:20], good[:-40], gzip.compress(good)):
        with pytest.raises(ValueError):
            gguf.parse(bad)


def test_onnx_wire_format():
    put = onnx._put
    raw = np.arange(4, dtype="<f4")
    half = put(1, 2) + put(2, 10) + put(5, put(0, 0)[:0] + bytes([0x80, 0x78, 0x80, 0x80, 0x01])) + put(8, "half")  # packed: 0x3c00 and 0x4000
    long = put(1, 2) + put(2, 7) + put(7, -1) + put(7, 5) + put(8, "long")  # not packed, one negative
    away = put(1, 9) + put(2, 1) + put(8, "away") + put(14, 1)
    graph = b"".join(put(5, t) for t in (half, long, away)) + put(11, put(1, "x") + put(2, put(1, put(1, 1) + put(2, put(1, put(1, 3)) + put(1, put(2, "batch"))))))
    found = {s[0]: s[1:] for s in onnx.segments(put(1, 8) + put(7, graph))}
    assert found["half"] == ("f16", [2], np.array([1, 2], "<f2").tobytes()) and found["long"] == ("i64", [2], np.array([-1, 5], "<i8").tobytes()) and found["away"] == ("f32", [9], None)
    assert found["model_structure"][1] == [0, 3, 1, 0] and b'"x": [3, "batch"]' in found["model_structure"][2]
    good = onnx.dump([("a", "f32", [4], raw.tobytes())], [("n", "Relu", ["a"], ["b"], {"k": -2})])
    assert onnx.nodes(good) == [(0, "n", "Relu", ["a"], ["b"], '{"k": -2}')]
    for bad in (b"", good[:-3], put(1, 8), onnx.dump([("a", "f32", [5], raw.tobytes())]), b"\xff" * 12):
        with pytest.raises(ValueError):
            list(onnx.segments(bad))


def test_torch_files_run_no_code(tmp_path):
    raw = np.arange(12, dtype="<f4")
    got = list(torch_zip.segments(torch_zip.dump([("a", "f32", [3, 2], [1, 3], 6, raw.tobytes()), ("b", "f16", [], [], 0, b"\0\x3c"), ("c", "i64", [0], [1], 0, b"")])))
    assert got == [("a", "f32", [3, 2], raw[6:].reshape(2, 3).T.copy().tobytes()), ("b", "f16", [], b"\0\x3c"), ("c", "i64", [0], b"")]
    mark = tmp_path / "ran"
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("m/data.pkl", b"cposix\nsystem\n(X" + struct.pack("<I", len(f"touch {mark}")) + f"touch {mark}".encode() + b"tR.")
    assert list(torch_zip.segments(whole.getvalue())) == [] and not mark.exists()
    for bad in (b"", b"PK", torch_zip.dump([("a", "f32", [4], [1], 9, raw.tobytes())]), torch_zip.dump([("a", "f32", [4], [-1], 3, raw.tobytes())])):
        with pytest.raises(ValueError):
            list(torch_zip.segments(bad))


def test_one_reader_for_model_files(spark, tmp_path):
    raw = np.arange(4, dtype="<f4").tobytes()
    (tmp_path / "a.onnx").write_bytes(onnx.dump([("blk.3.attn_q.weight", "f32", [2, 2], raw), ("scale", "u8", [1], b"x")]))
    (tmp_path / "b.pth").write_bytes(torch_zip.dump([("ln_f.weight", "f32", [4], [1], 0, raw)]))
    (tmp_path / "c").write_bytes(gguf.dump({}, [("x", "f16", [2], b"1234")]))
    s = {r["name"]: r for r in model_files.read(spark, str(tmp_path)).collect()}
    assert (s["blk.3.attn_q.weight"]["kind"], s["blk.3.attn_q.weight"]["layer_index"], bytes(s["blk.3.attn_q.weight"]["data"])) == ("ATTENTION_WEIGHTS", 3, raw)
    assert (s["scale"]["kind"], s["ln_f.weight"]["kind"], s["x"]["kind"], s["x"]["format"], s["gguf_metadata"]["kind"]) == ("WEIGHTS_INT8", "LAYER_NORM_WEIGHTS", "WEIGHTS_FP16", "gguf", "METADATA_JSON")
    ordered = [r["name"] for r in model_files.by_layer(model_files.read(spark, str(tmp_path)).filter("format = 'onnx'")).collect()]
    assert ordered == ["model_structure", "model_metadata", "scale", "blk.3.attn_q.weight"]
    (tmp_path / "d.h5").write_bytes(b"\x89HDF")
    with pytest.raises(Exception, match="no parser"):
        model_files.read(spark, str(tmp_path)).collect()


def test_cache_refuses_rows_beyond_its_capacity(spark, tmp_path):
    rows = [(layer, p) for layer in (0, 1) for p in range(5 if layer else 2)]
    spark.createDataFrame(rows, "layer long, position long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("layer long, position long").parquet(str(tmp_path / "in"))
    q = cache.kv_cache(stream, 3).writeStream.format("memory").queryName("kv").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["layer"], r["position"], r["length"], r["accepted"]) for r in spark.table("kv").collect())
    assert got == [(0, 0, 1, True), (0, 1, 2, True), (1, 0, 1, True), (1, 1, 2, True), (1, 2, 3, True), (1, 3, 3, False), (1, 4, 3, False)]


def test_windows_leave_late_rows_out(spark, tmp_path):
    schema = "ts timestamp_ntz, event_type string, value double"
    q = None
    for i, times in enumerate((["2024-01-01 00:00:10", "2024-01-01 00:04:00", "2024-01-01 01:00:00"], ["2024-01-01 00:01:00", "2024-01-01 02:00:00"])):
        spark.createDataFrame([(t, "a", 1.0) for t in times], "t string, event_type string, value double").select(F.to_timestamp_ntz("t").alias("ts"), "event_type", "value").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = cache.windowed_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    first = [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).filter("start = '2024-01-01 00:00:00'").collect()]
    assert first == [2]


def test_bit_sets_in_files(spark, tmp_path):
    from bitloom.sources import sdr_file

    rows = [(0, []), (1, [0, 7, 8, 19999, 19999, 20000, -1]), (2, list(range(0, 20000, 3)))]
    df = spark.createDataFrame(rows, "id long, pos array<long>")
    for runs, gz in ((False, False), (True, True)):
        sdr_file.write(df.filter("id < 2") if runs else df, str(tmp_path / f"f{runs}"), runs, gz)
        got = {r["id"]: r["pos"] for r in sdr_file.read(spark, str(tmp_path / f"f{runs}")).collect()}
        assert got[0] == [] and got[1] == [0, 7, 8, 19999]
        assert runs or got[2] == rows[2][1]


def test_generation_against_a_plain_loop(spark):
    from bitloom.operators.generation import generate

    r = np.random.default_rng(8)
    x = r.normal(size=(30, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    ids = [3, 5]
    for _ in range(4):
        s = x @ x[ids].mean(axis=0) / 0.8
        for i in set(ids):
            s[i] = s[i] / 1.5 if s[i] > 0 else s[i] * 1.5
        ids.append(int(s.argmax()))
    assert generate(rows, [3, 5], 4) == ids[2:]
    assert generate(rows, [99], 4) == [] and generate(rows, [3, 5], 4, end=ids[2]) == ids[2:3]


def test_turns_decode_by_the_whole_vocabulary_with_marks_and_numbers(spark, tmp_path):
    from bitloom.plans.registry import QUERIES

    turns = [(1, t, "user", f"w{t:04d}") for t in range(1, 1000)] + [(2, t, "user", f"w{1000 + t:04d}") for t in range(1000)] + [(3, 0, "user", "w1900 (W0003)! 5, 5 2000 -")]
    spark.createDataFrame(turns + [(4, 0, "user", " ")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.text for r in QUERIES["sdr_decode_text"](spark, str(tmp_path)).collect()}
    # Word n has number n - 1; words 1,250 apart share a block, which the later one owns.
    for conv, turn, _, text in turns[:-1]:
        n = int(text[1:])
        assert got[conv, turn] == f"w{n + 1250 if n + 1250 < 2000 else n:04d}"
    assert got[3, 0] == "w1253 w1900 ! ( ) , - 10 990" and (4, 0) not in got


def test_decoder_steps_equal_prefill_and_plain_attention(spark):
    from bitloom.operators import decoder
    from bitloom.plans.tensor_plans import decoder_weights

    r = np.random.default_rng(4)
    x, blocks = r.normal(size=(20, 16)), [decoder_weights(), decoder_weights()]
    whole, _ = decoder.prefill(x, blocks)
    some, caches = decoder.prefill(x[:12], blocks)
    rest = []
    for i in range(12, 20):
        y, caches = decoder.step(x[i : i + 1], blocks, caches)
        rest.append(y)
    assert np.allclose(whole, np.concatenate([some, *rest]))
    q, k, v = r.normal(size=(9, 4, 6)), r.normal(size=(9, 2, 6)), r.normal(size=(9, 2, 6))
    plain = np.zeros_like(q)
    for t in range(9):
        for h in range(4):
            w = np.exp(k[: t + 1, h // 2] @ q[t, h] / np.sqrt(6))
            plain[t, h] = w / w.sum() @ v[: t + 1, h // 2]
    for tile in (1, 2, 4, 256):
        assert np.allclose(decoder.attend(q, k, v, 0, tile), plain)


def test_segment_codecs_round_trip():
    from bitloom.operators import coding

    r = random.Random(2)
    texts = [b"", b"a", b"a" * 256, b"ab" * 700, bytes(3000), bytes(r.randrange(3) for _ in range(2000)), bytes(500) + b"x" * 5 + bytes(2000), "é".encode() * 900]
    for data in texts:
        assert coding.from_rle(coding.rle(data)) == data
        for kind in ("CONFIG", "TOKENIZER_VOCAB", "SPARSE_INDICES", "WEIGHTS_INT8", "METADATA_JSON", "OTHER"):
            sid, coded = coding.encode(data, kind)
            assert coding.decode(sid, coded) == data
    assert coding.rle(b"\1" * 300 + b"\2") == bytes([255, 1, 45, 1, 1, 2])
    assert coding.from_varints(coding.varints(np.array([0, 127, 128, 16384, 2**34]))) == [0, 127, 128, 16384, 2**34]
    assert coding.encode(bytes(3000), "SPARSE_INDICES")[0] == coding.ADAPTIVE and len(coding.encode(bytes(3000), "SPARSE_INDICES")[1]) < 20
    assert coding.encode(b"q" * 2000, "OTHER") == (coding.RAW, b"q" * 2000) and gzip.decompress(coding.encode(b"cd" * 2000, "CONFIG")[1]) == b"cd" * 2000
    x = np.array([0.5, -1.0, 0.25, 0.0], dtype="<f4")
    sid, coded = coding.encode(x.tobytes(), "WEIGHTS_FP32")
    assert sid == coding.QUANT and np.abs(np.frombuffer(coding.decode(sid, coded), "<f4") - x).max() <= 0.5 / 127 + 1e-6
    assert coding.encode(np.array([np.nan], "<f4").tobytes(), "WEIGHTS_FP32")[0] == coding.GZIP


def test_archive_stores_coded_segments_and_reads_them_back(spark, tmp_path):
    at = f"file://{tmp_path}/coded"
    rows = [("zeros", "WEIGHTS_INT8", bytearray(4000)), ("words", "CONFIG", bytearray(b"key = value\n" * 300)), ("other", "UNKNOWN", bytearray(b"\1\2\3")), ("gone", "CONFIG", None)]
    archive.write(spark.createDataFrame(rows, "name string, kind string, data binary"), at)
    index = {r["name"]: r for r in archive.read_index(spark, at).collect()}
    assert {n: x["strategy"] for n, x in index.items()} == {"zeros": archive.RLE, "words": archive.GZIP, "other": archive.RAW, "gone": None}
    assert all(index[n]["stored_size"] < index[n]["original_size"] for n in ("zeros", "words"))
    back = {r["name"]: r["data"] and bytes(r["data"]) for r in archive.read(spark, at).collect()}
    assert back == {n: None if d is None else bytes(d) for n, _, d in rows}
    assert [r["strategy"] for r in archive.read(spark, at, names=["zeros"], raw=True).collect()] == [archive.RLE]


def test_layer_types_and_transposed_convolution(spark):
    from bitloom.functions import models as M
    from bitloom.operators import tensors as X

    written = ["flatten", "Concat", "slice", "gather", "sub", "mul", "DIV", "maxpool", "avgpool", "averagepool", "globalaveragepool", "odd"]
    df = spark.createDataFrame([(w,) for w in written], "w string").select(M.layer_type(F.col("w")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["Flatten", "Concat", "Slice", "Gather", "Sub", "Mul", "Div", "MaxPool", "AveragePool", "AveragePool", "GlobalAveragePool", "odd"]
    image, kernel = np.arange(9.0).reshape(3, 3), np.array([[1.0, 2.0], [-1.0, 0.5]])
    want = np.zeros((8, 8))
    for y in range(3):
        for z in range(3):
            want[3 * y : 3 * y + 2, 3 * z : 3 * z + 2] += image[y, z] * kernel
    got = spark.createDataFrame([(image.ravel().tolist(),)], "x array<double>").select(X.conv_transpose2d(F.col("x"), 3, kernel.tolist(), 3).alias("y")).first()["y"]
    assert np.allclose(np.array(got).reshape(8, 8), want)


def test_coded_archive(spark, tmp_path):
    from bitloom.sources import coded

    rng = np.random.default_rng(3)
    scales, path, at = D.gammas(2), f"{tmp_path}/coded", {}
    dictionaries = {"mlp": rng.normal(size=(16, 6)), "other": rng.normal(size=(8, 6))}
    tensors = {"a.mlp": "mlp", "b.mlp": "mlp", "c.attn": "other"}
    codes = None
    for name, held in tensors.items():
        x = rng.normal(size=(5, 6))
        tiles = spark.createDataFrame([(t, row.tolist()) for t, row in enumerate(x)], "tile long, x array<double>")
        mine = D.encode(tiles, dictionaries[held], scales, 3).withColumns({"name": F.lit(name), "dictionary": F.lit(held)})
        codes = mine if codes is None else codes.unionByName(mine)
        chosen, signs = D.pursue(x, dictionaries[held], scales, 3)
        at[name] = np.einsum("nsk,nskd->nd", np.array(scales)[None, :, None] * signs, dictionaries[held][chosen])
    atoms = spark.createDataFrame([(n, a, i, float(w)) for n, m in dictionaries.items() for (a, i), w in np.ndenumerate(m)], "dictionary string, atom int, i int, w double")
    coded.write(codes, atoms, scales, path)
    index = {r["name"]: (r["dictionary"], r["tiles"], r["coded_bytes"]) for r in spark.read.parquet(f"{path}/index").collect()}
    assert index == {n: (held, 5, 5 * 6 * 2) for n, held in tensors.items()}
    assert coded.has(spark, path, "b.mlp") and not coded.has(spark, path, "d")
    h = rng.normal(size=6)
    x = spark.createDataFrame([(i, float(v)) for i, v in enumerate(h)], "i int, h double")
    for name, want in at.items():
        got = np.zeros((5, 6))
        for r in coded.decompress(spark, path, name).collect():
            got[r["tile"], r["i"]] = r["v"]
        assert np.allclose(got, want)
        y = {r["tile"]: r["y"] for r in coded.product(spark, path, name, x).collect()}
        assert np.allclose([y[t] for t in range(5)], want @ h)
    with pytest.raises(KeyError):
        coded.decompress(spark, path, "d")


def plan_of(df):
    """The nodes of a plan from the top, before it runs."""
    return [line.strip(" :+-*(0123456789)") for line in df._jdf.queryExecution().sparkPlan().toString().split("\n")]


def turns_table(spark, path, turns=60):
    rows = [(c, t, "user", " ".join(f"w{(c * 97 + t * 31 + k * k) % 4000}" for k in range(20)) + f" {c}! (x) {c * 7}.") for c in range(turns) for t in range(3)]
    rows += [(1, 1, "user", "w5 again"), (900, 0, "user", None), (901, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def against_sql(spark, path, name):
    """Rows of a query and of its SQL over a folder's tables, sorted."""
    import duckdb

    from bitloom.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for at in os.listdir(path):
        con.sql(f"CREATE VIEW {at.removesuffix('.parquet')} AS SELECT * FROM '{path}/{at}/*.parquet'")
    df = QUERIES[name](spark, path)
    return sorted(map(tuple, df.collect())), sorted(con.sql(ORACLES[name]).select(*df.columns).fetchall())


def test_decoded_texts_are_not_shuffled_and_a_vocabulary_of_slices_gives_the_same(spark, tmp_path, monkeypatch):
    from bitloom.plans import text_plans

    path = turns_table(spark, tmp_path)
    top = plan_of(text_plans.sdr_decode(spark, path))
    assert "Aggregate" not in " ".join(top[: next(i for i, x in enumerate(top) if x.startswith("MapInArrow"))])
    for most in (text_plans.MAX_WORDS, 1250):
        monkeypatch.setattr(text_plans, "MAX_WORDS", most)
        ours, theirs = against_sql(spark, path, "sdr_decode")
        assert ours == theirs


def test_decoded_words_are_made_in_as_many_tasks_as_the_session_has(spark, tmp_path, monkeypatch):
    from bitloom.plans import text_plans

    path = turns_table(spark, tmp_path)
    df = text_plans.word_decode(spark, path)
    df.collect()
    assert df.rdd.getNumPartitions() == 4
    for most in (text_plans.MAX_WORDS, 1250):
        monkeypatch.setattr(text_plans, "MAX_WORDS", most)
        ours, theirs = against_sql(spark, path, "word_decode")
        assert ours == theirs


def test_turn_encodings_of_repeated_turns_and_nulls_equal_sql(spark, tmp_path):
    path = turns_table(spark, tmp_path)
    for name in ("sdr_region_stats", "sdr_trim", "sdr_bitpack", "sdr_file_bytes"):
        ours, theirs = against_sql(spark, path, name)
        assert ours == theirs, name


def test_positions_are_made_inside_a_turns_row(spark, tmp_path):
    """No exchange, window or join stands above the row of a turn, so that eight positions a word are never dealt."""
    from bitloom.plans.registry import QUERIES

    path = turns_table(spark, tmp_path, 3)
    for name in ("sdr_region_stats", "sdr_trim", "sdr_file_bytes", "sdr_decode_text"):
        plan = QUERIES[name](spark, path)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Repartition")]
        assert "Window" not in above and above.count("Aggregate") == 1, plan


def test_packing_is_linear_in_positions_and_keeps_nulls(spark):
    from bitloom.sources import sdr_file

    rows = [(0, list(range(20000))), (1, None), (2, []), (3, [19999, 3, 3, 20000, -1])]
    df = spark.createDataFrame(rows, "id long, pos array<long>").select("id", sdr_file.packed(F.col("pos")).alias("data"))
    got = {r["id"]: (r["n"], r["p"]) for r in df.select("id", F.octet_length("data").alias("n"), sdr_file.unpacked(F.col("data")).alias("p")).collect()}
    assert got == {0: (2500, list(range(20000))), 1: (None, None), 2: (2500, []), 3: (2500, [3, 19999])}
    big = spark.range(400, numPartitions=1).select(F.sequence(F.col("id") % 2, F.lit(19999), F.lit(2)).alias("pos")).select(sdr_file.unpacked(sdr_file.packed(F.col("pos"))).alias("p"))
    began = time.time()
    assert big.agg(F.sum(F.size("p"))).first()[0] == 400 * 10000
    # Work that grew with the square of the positions took minutes here.
    assert time.time() - began < 60


def test_runs_are_found_in_as_many_tasks_as_the_session_has_after_one_sort(spark):
    from bitloom.operators import codecs

    df = spark.range(5000, numPartitions=3).select(F.lit(1).alias("g"), "id", (F.col("id") % 7 < 3).cast("int").alias("v"))
    out = codecs.runs(df, ["g"], [F.col("id")], "v", F.floor(F.col("id") / 100))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    assert out.agg(F.sum("run")).first()[0] == 5000


def test_segments_are_coded_a_few_at_a_time():
    import pyarrow as pa

    from bitloom.operators import coding

    batch = pa.RecordBatch.from_arrays([pa.array([bytes(1 << 20)] * 9 + [None, bytes(9 << 20), b""], pa.binary())], names=["data"])
    parts = list(coding._small([batch], 0))
    assert [p.num_rows for p in parts] == [4, 4, 2, 1, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert list(coding._small([batch.slice(0, 0)], 0)) == []
