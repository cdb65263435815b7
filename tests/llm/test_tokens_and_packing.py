import hashlib
import random
import zlib
from collections import Counter

import edge
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.llm import bpe, common, packing


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encode_and_decode_match_the_library(text):
    coder = bpe.coder()
    ids = coder.library().encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids
    assert coder.decode(ids) == coder.library().decode(ids, skip_special_tokens=False)


def test_special_tokens_and_contractions_match_the_library():
    coder = bpe.coder()
    for text in ("don't <|endoftext|>x<|startoftext|>", "ΑΣ ΟΔΥΣΣΕΥΣ 1²½ ﬁ", "a" * 5000, "<|endoftext|>", "é x", "don''t we'LL"):
        assert coder.encode(text) == coder.library().encode(text, add_special_tokens=False).ids


def test_token_digests(spark):
    coder, values = bpe.coder(), edge.texts()
    got = {r.doc_id: r for r in bpe.token_digests(edge.docs(spark)).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        ids = coder.library().encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(coder.library().decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(edge.empty(spark)).count() == 0
    assert bpe.token_digests(edge.odd_docs(spark)).count() == 5


def test_ids_column_decodes_again(spark):
    coder = bpe.coder()
    decoded = {r.doc_id: r.text for r in bpe.decode_column(bpe.encode_column(edge.docs(spark))).collect()}
    for i, t in enumerate(edge.texts()):
        assert decoded[i] == coder.decode(coder.encode(t))


def brute_choice(gaps, length, cap):
    """The gap to use by trying all and summing the squares."""
    options = [g for g in set(gaps) if g >= length] + [cap]
    def total(g):
        left = list(gaps)
        if g in left and g != cap:
            left.remove(g)
        left += [g - length] if g > length else []
        return sum(left.count(x) ** 2 for x in set(left))
    return min(options, key=lambda g: (total(g), g == cap, g))


def test_each_piece_goes_where_the_squares_are_smallest():
    r, cap = random.Random(4), 24
    packer, gaps, bins = packing.SumOfSquares(cap), [], {}
    for _ in range(400):
        n = r.randint(1, cap)
        want = brute_choice(gaps, n, cap)
        seq, offset = packer.place(n)
        assert cap - offset == want
        if want != cap:
            gaps.remove(want)
        if want > n:
            gaps.append(want - n)
        bins.setdefault(seq, []).append((offset, n))
    for parts in bins.values():
        at = 0
        for offset, n in parts:
            assert offset == at
            at += n
        assert at <= cap


def check_packing(rows, values):
    coder = bpe.coder()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(values):
        ids = coder.encode(t) + [0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, at, min(2048, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 2048))]
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in parts]
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_seq)


def test_packing(spark):
    values = edge.texts()
    rows = packing.best_fit_packing(edge.docs(spark)).collect()
    used = check_packing(rows, values)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 2
    assert packing.best_fit_packing(edge.empty(spark)).count() == 0
    assert packing.best_fit_packing(edge.odd_docs(spark)).count() == 5
    many = packing.best_fit_packing(edge.docs(spark), block_pieces=10).collect()
    check_packing(many, values)


def test_packing_does_not_depend_on_the_words_that_workers_remember(spark):
    few, many = (sorted(map(tuple, packing.best_fit_packing(edge.docs(spark), cache_words=n).collect()), key=str) for n in (1, 600_000))
    assert few == many


def test_sequences_of_many_blocks_stay_apart_in_one_partition(spark):
    values = edge.texts(n=120)
    docs = edge.docs(spark, values).repartition(5, "doc_id")
    cut = common.materialise(packing.pieces(docs).withColumn("number", F.monotonically_increasing_id()), "pieces")
    for tasks in (2, packing.MAX_TASKS):
        packed = packing.pack(cut, block_pieces=10, max_tasks=tasks)
        assert packed.rdd.getNumPartitions() == min(tasks, -(-cut.count() // 10))
        rows = common.materialise(packed.coalesce(1), "packed").collect()
        assert check_packing(rows, values) > 1
        assert {r.sequence_id >> 36 for r in rows} == set(range(-(-cut.count() // 10)))


def test_equal_rows_are_dealt_over_the_blocks(spark):
    docs = spark.range(400).selectExpr("CAST(NULL AS LONG) AS doc_id", "'one text that all rows share' AS text")
    rows = packing.best_fit_packing(docs, block_pieces=40).collect()
    sizes = Counter(r.sequence_id >> 36 for r in rows)
    assert len(rows) == 400 and len(sizes) == 10 and max(sizes.values()) < 80
