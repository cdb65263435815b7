"""Hand values of the encoders, codecs and rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import bits, blocks, media, models, numbers, pieces
from bitloom.functions import text as T
from bitloom.operators import codecs, sets


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_number_buckets(spark):
    values = [-1000.0, -980.0, -979.999, 0.0, 0.001, 1000.0, 5000.0, math.nan, math.inf, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [r[0] for r in df.select(numbers.number_bucket(F.col("v"))).collect()]
    assert got == [0, 0, 1, 49, 50, 99, 99, None, None, None]
    assert [list(r[0]) for r in df.filter("i >= 6").select(numbers.number_bits(F.col("v"))).collect()] == [[15099], [], [], []]


def test_numbers_as_text(spark):
    positions = F.array(*(F.lit(p).cast("long") for p in (15000, 15099, 15100, 14999, 15050)))
    assert one(spark, numbers.number_text(positions), numbers.range_text(F.lit(0), F.lit(1)))[:] == ("-990 990 ? ? 10", "[-1000, -960]")
    assert one(spark, numbers.number_text(F.array().cast("array<bigint>")))[0] == ""


def test_numbers_in_a_text(spark):
    assert one(spark, numbers.numbers_in(F.lit("1,234 x 5.5  -3 4e 7.")))[0] == [1234.0, 5.5, -3.0]


def test_ranges(spark):
    n = lambda a, b, s: numbers.range_buckets(F.lit(a), F.lit(b), F.lit(s))
    assert one(spark, n(0.0, 100.0, 1.0), n(0.0, 100.0, 30.0), n(5.0, 1.0, 1.0), n(0.0, 1.0, 0.0)) == ([49, 54], [49, 54, 51], None, None)


def test_date_parts(spark):
    ts = F.expr("timestamp_ntz '2024-02-20 15:30:45'")
    assert one(spark, numbers.date_bits(ts))[0] == [2124, 2201, 2319, 2415, 2490, 2565, 3220]
    assert str(one(spark, numbers.date_decode(numbers.date_bits(ts)))[0]) == "2024-02-20 15:30:45"


def test_date_formats(spark):
    given = ["2024-02-20T15:30:45Z", "2024-02-20T15:30:45+05:30", "20240220153045", "last week", "1700000000", "soon"]
    assert list(one(spark, *(numbers.date_format(F.lit(x)) for x in given))) == ["iso8601", "iso8601", "compact", "relative", "unix", "unknown"]


def test_places(spark):
    g = lambda a, b: numbers.geo_bits(F.lit(a), F.lit(b))
    assert [tuple(x) for x in one(spark, g(0.0, 0.0), g(90.0, 180.0), g(-90.0, -180.0), g(-99.0, 999.0))] == [(499, 499), (999, 999), (0, 0), (0, 999)]


def test_tokens_and_words(spark):
    tok, words = one(spark, T.tokens(F.lit("Hi, 3.14 don't  été!")), T.words(F.lit("Hi, 3.14 été")))
    assert tok == ["hi", ",", "3", ".", "14", "don", "'", "t", "été", "!"]
    assert words == ["hi", "3", "14", "t"]
    assert one(spark, T.word_bits(F.lit(1250)))[0] == list(range(8))


def test_text_codes(spark):
    assert one(spark, T.char_codes(F.lit("abcde")))[0] == [0 + 74 * 1 + 74**2 * 2 + 74**3 * 3, 4]
    assert one(spark, T.char_decode(T.char_codes(F.lit("Hello, wor1d"))))[0] == "Hello, wor1d"
    assert one(spark, T.base64(F.lit("x" * 100)), T.unbase64(T.base64(F.lit("é")))) == ("eHh4" * 33 + "eA==", "é")
    assert one(spark, T.url_quote(F.lit("a b/ü~")), T.url_unquote(T.url_quote(F.lit("a b/ü~+%")))) == ("a+b%2f%c3%bc~", "a b/ü~+%")
    assert one(spark, T.lines(F.lit("a\r\nb\n")), T.lines(F.lit("")), T.lines(F.lit("x\n\ny"))) == (["a", "b"], [], ["x", "", "y"])
    assert one(spark, T.special_index(F.lit("!")), T.special_index(F.lit("x")), T.special_char(F.lit(99))) == (0, -1, "?")
    assert one(spark, F.size(T.byte_tensor(F.lit(""))), F.slice(T.byte_tensor(F.lit("\x7f")), 1, 2)) == (128, [127 / 255, 0.0])


def test_set_overlap(spark):
    a = spark.createDataFrame([(1, p) for p in (1, 2, 3)], "a int, pos int")
    b = spark.createDataFrame([(9, p) for p in (2, 3, 4, 5)], "b int, pos int")
    r = sets.overlap(a, b, ["a"], ["b"]).first()
    assert (r["shared"], r["overlap"]) == (2, 2 / 3)


def test_runs_of_300_and_back(spark):
    df = spark.createDataFrame([(0, i, 1) for i in range(300)] + [(0, 300 + i, None) for i in range(2)] + [(0, 302, 1)], "g int, i int, v int")
    coded = codecs.split_runs(codecs.runs(df, ["g"], [F.col("i")], "v", F.floor(F.col("i") / 40)))
    assert sorted((r["start"], r["value"], r["run"]) for r in coded.collect()) == [(0, 1, 255), (255, 1, 45), (300, None, 2), (302, 1, 1)]
    assert codecs.expand_runs(coded).count() == 303


def test_runs_and_deltas_of_groups_cut_into_buckets(spark):
    import random

    r = random.Random(3)
    rows = [(g, 3 * i + r.randrange(3), r.choice([0, 0, 0, 1, None])) for g in (None, 1, 2) for i in range(200 if g else 90)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    expected = set()
    for g in (None, 1, 2):
        values = [v for _, _, v in sorted((x for x in rows if x[0] == g), key=lambda x: x[1])]
        cuts = [0, *(k for k in range(1, len(values)) if values[k] != values[k - 1]), len(values)]
        expected |= {(g, values[a], a, b - a) for a, b in zip(cuts, cuts[1:])}
    for width in (1, 4, 50, 10_000):
        coded = codecs.runs(df, ["g"], [F.col("i")], "v", F.floor(F.col("i") / width)).collect()
        assert len(coded) == len(expected) and {tuple(x) for x in coded} == expected
        split = codecs.deltas(df.select("g", "i"), ["g"], "i", width)
        stored = codecs.ranks(split, ["g"], [F.col("i")], F.floor(F.col("i") / 20), "n").drop("i")
        restored = codecs.undelta(stored, ["g"], "n", width).collect()
        assert sorted((x["g"] or 0, x["pos"], x["n"]) for x in restored) == sorted((g or 0, i, n) for g in (None, 1, 2) for n, i in enumerate(sorted(x[1] for x in rows if x[0] == g)))


def test_deltas_and_varints(spark):
    df = spark.createDataFrame([(0, p) for p in (3, 7, 20)], "g int, p int")
    assert sorted(r["delta"] for r in codecs.deltas(df, ["g"], "p").collect()) == [3, 4, 13]
    assert one(spark, *(codecs.varint_bytes(F.lit(n)) for n in (0, 127, 128, 16383, 16384, 1 << 28))) == (1, 1, 2, 2, 3, 5)


def test_quantization_of_constants_and_of_one_sign(spark):
    df = spark.createDataFrame([(0, [0.0] * 4), (1, [2.0] * 4), (2, [1.0, 2.0, 3.0, 4.0])], "id int, x array<double>").orderBy("id")
    sym = [tuple(r["q"]) for r in codecs.quantize_symmetric(df, 8).collect()]
    assert sym == [(0, 0, 0, 0), (127,) * 4, (32, 64, 95, 127)]
    assert [r["scale"] for r in codecs.quantize_affine(df).collect()][:2] == [1.0, 1.0]
    packed = codecs.quantize_grouped(df, 4).select(codecs.nibble_pack(F.transform("codes", lambda c: c["q"])).alias("b"), F.transform("codes", lambda c: c["q"]).alias("q"))
    for r in packed.withColumn("u", codecs.nibble_unpack(F.col("b"), F.size("q"))).collect():
        assert r["u"] == r["q"]
    odd = spark.range(1).select(codecs.nibble_pack(F.array(*map(F.lit, (-1, 7, 3)))).alias("b")).first()["b"]
    assert odd == [15 + 7 * 16, 3]


def test_half_precision(spark):
    values = [0.0, 1.0, -2.5, 65504.0, 6e-8, 1e-5, 0.1, 1e9, math.inf, -math.inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    got = [r[0] for r in df.select(bits.to_half(F.col("v"))).collect()]
    with np.errstate(over="ignore"):
        assert got == np.array(values).astype(np.float16).view(np.uint16).tolist()
    back = [r[0] for r in df.select(bits.from_half(bits.to_half(F.col("v")))).collect()]
    with np.errstate(over="ignore"):
        assert back == np.array(values).astype(np.float16).astype(float).tolist()


def test_k_block_by_hand():
    raw = bytearray(144)
    raw[0:2], raw[4], raw[16], raw[17] = np.array([1.0], "<f2").tobytes(), 1, 0x21, 0x43
    assert blocks.dequantize(bytes(raw), "q4_K").tolist() == [1.0, 2.0, 3.0, 4.0] + [0.0] * 252


def _slow_k(raw, fmt):
    """Values of one block by the bit."""
    bit = lambda b, at, n: sum((b[(at + k) // 8] >> (at + k) % 8 & 1) << k for k in range(n))
    out = []
    if fmt == "q6_k":
        d = float(np.frombuffer(raw[208:210], "<f2")[0])
        for i in range(256):
            q = bit(raw[:128], 4 * i, 4) + 16 * bit(raw[128:192], 2 * i, 2) - 32
            out.append(q * d * np.frombuffer(raw[192 + i // 16 : 193 + i // 16], np.int8)[0])
        return out
    d, least = (float(x) for x in np.frombuffer(raw[:4], "<f2"))
    s, codes = raw[4:16], raw[48:] if fmt == "q5_k" else raw[16:]
    for i in range(256):
        k = i // 32
        scale = s[k] & 63 if k < 4 else (s[k + 4] & 15) + (s[k - 4] >> 6) * 16
        low = s[k + 4] & 63 if k < 4 else (s[k + 4] >> 4) + (s[k] >> 6) * 16
        q = bit(codes, 4 * i, 4) + (16 * bit(raw[16:48], i, 1) if fmt == "q5_k" else 0)
        out.append(q * d * scale - least * low)
    return out


@pytest.mark.parametrize("fmt", ["q4_k", "q5_k", "q6_k"])
def test_k_blocks_against_single_bits(fmt):
    size = bits.BLOCK_FORMATS[fmt][1]
    raw = bytearray(np.random.default_rng(3).integers(0, 256, size, dtype=np.uint8).tobytes())
    where = 208 if fmt == "q6_k" else 0
    raw[where : where + 2] = np.array([0.5], "<f2").tobytes()
    if fmt != "q6_k":
        raw[2:4] = np.array([0.25], "<f2").tobytes()
    assert np.allclose(blocks.dequantize(bytes(raw), fmt), _slow_k(bytes(raw), fmt))


def test_plain_formats_and_bad_lengths():
    x = np.array([1.5, -2.0, 0.0, 3.25], "<f4")
    assert blocks.dequantize(x.tobytes(), "f32").tolist() == x.tolist() == blocks.dequantize(x.astype("<f2").tobytes(), "fp16").tolist()
    assert blocks.dequantize((x.view("<u4") >> 16).astype("<u2").tobytes(), "bf16").tolist() == x.tolist()
    assert blocks.dequantize(bytes([1, 255]), "int8", 0.5, 1.0).tolist() == [0.0, -1.0]
    for bad in ("q4_0", "q8_0", "q6_k", "f32"):
        with pytest.raises(ValueError):
            blocks.dequantize(b"abc", bad)
    with pytest.raises(ValueError):
        blocks.dequantize(b"", "iq9")


def test_video_and_image_coders_round_trip():
    r = np.random.default_rng(1)
    for raw in (b"", b"a", bytes(300), bytes([255] * 7), r.integers(0, 256, 5000, dtype=np.uint8).tobytes(), b"abababab" * 900, bytes(70_000)):
        assert media.phrases_of(media.phrase_codes(raw)) == raw
        assert media.unmarked(media.marked_runs(raw)) == raw
        assert media.pixels_of_runs(media.pixel_runs(raw)) == raw
    block = r.normal(size=(8, 8))
    assert np.allclose(media.idct(media.dct(block)), block)


def test_piece_tokenizer():
    words = ["<unk>", "<s>", "\n", "▁the", "▁th", "e", "▁", "cat", "<tag>", *(f"<0x{b:02X}>" for b in range(256))]
    t = pieces.PieceTokenizer(words)
    ids = t.encode("the cat\nthe <tag>é")
    assert [words[i] for i in ids] == ["<s>", "▁the", "▁", "cat", "\n", "▁the", "<0x20>", "<tag>", "▁", "<0xC3>", "<0xA9>"]
    assert t.decode(t.encode("the cat")) == "the cat"
    assert t.encode("") == [1] and pieces.PieceTokenizer([]).encode("") == [32] and pieces.PieceTokenizer([]).encode("é") == [195, 169]


def test_protection_and_shapes(spark):
    names = [(f"blk.{i}.mlp.down", i) for i in (0, 2, 5, 10, 18, 19, 21)] + [("lm_head", 0)]
    df = spark.createDataFrame(names, "n string, k int")
    kept = {(r["n"], r["k"]) for r in df.filter(~models.protected(F.col("n"), F.col("k"), 3, 22)).collect()}
    assert kept == {("blk.5.mlp.down", 5), ("blk.10.mlp.down", 10), ("blk.18.mlp.down", 18), ("lm_head", 0)}
    shape = lambda *d: models.effective_shape(F.array(*(F.lit(x).cast("long") for x in d)))
    assert [tuple(x) for x in one(spark, shape(5), shape(5, 6), shape(2, 3, 4))] == [(0, 0), (5, 6), (2, 12)]
    strip = lambda s: models.strip_suffix(F.lit(s))
    assert one(spark, strip("a.weight"), strip(".weight"), strip("a.bias.weight"), strip("plain")) == ("a", ".weight", "a.bias", "plain")
