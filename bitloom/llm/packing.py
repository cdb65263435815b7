"""Sum-of-squares packing of token sequences.

Every document is encoded, closed with the separator id 0 and, if longer than a sequence, cut into full pieces. A
piece of length s goes where the sum over all residual gaps g of (number of open sequences with gap g) squared becomes
smallest: moving a sequence from gap g to g - s changes that sum by 2(N[g-s] - N[g]) + 2 (1 - 2N[g] for an exact fit),
a new sequence by 2N[cap-s] + 1. Ties go to the smallest gap, and an open sequence is preferred to a new one.

Pieces are numbered when they are written and dealt into blocks by that number, whose hash spreads equal rows as well
as others; the number of blocks follows the number of pieces. Each block is packed on its own in order of falling
length; only the counts and the open sequences of a block are in memory. A block wastes a few open sequences, of some
tens of thousands of pieces. A task packs one or more whole blocks, and a sequence's id holds its block, whatever task
or partition that is in. The order within a block is total, so a task that is run again gives the same sequences.

Defined results: a null or empty text is the separator alone; equal rows are packed once each; rows with a null doc_id
are packed like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.bpe import CACHE_WORDS, cache, coder
from bitloom.llm.common import materialise, per_row, whole_text

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces of one block, about, and tasks that the blocks are dealt to at most.
BLOCK_PIECES, MAX_TASKS = 40_000, 8_192


class SumOfSquares:
    """Online sum-of-squares packer: place(length) -> (sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)
        self.at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        cap, n = self.capacity, self.open
        if not 0 < length <= cap:
            raise ValueError(f"length {length} does not fit a sequence of {cap}")
        gap, best = cap, 0
        if length < cap:
            best = 2 * int(n[cap - length]) + 1
        here = n[length:cap]
        if here.size:
            change = 2 * (n[: cap - length] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            i = int(change.argmin())
            if change[i] <= best and here[i]:
                gap = length + i
        if gap == cap:
            seq = self.made
            self.made += 1
        else:
            seq = self.at_gap[gap].pop()
            n[gap] -= 1
        left = gap - length
        if left:
            n[left] += 1
            self.at_gap[left].append(seq)
        return seq, cap - gap


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces; a worker remembers cache_words words at most."""

    def rows(source):
        bpe = coder(path)
        model, symbol = bpe.library().model, bpe.byte_symbols

        def make(word: str) -> bytes:
            mapped = word if word.isascii() and word.isalnum() else "".join(symbol[b] for b in word.encode("utf-8"))
            found = model.tokenize(mapped)
            return struct.pack(f"<{len(found)}I", *[t.id for t in found])

        words = cache(bpe.path, "u32", make, cache_words)
        for doc_id, text in source:
            parts = bpe.joined(text, words, lambda i: i.to_bytes(4, "little"))
            parts.append(b"\0\0\0\0")
            ids = b"".join(parts)
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)

    return per_row(docs.select("doc_id", whole_text().alias("t")), "doc_id long, piece int, start long, length long, ids_crc32 long", rows, 64, True)


def pack(cut: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES, max_tasks: int = MAX_TASKS) -> DataFrame:
    """Adds sequence_id and offset to a (small, materialised) table of numbered pieces."""
    blocks = max(1, -(-cut.count() // block_pieces))
    tasks = min(blocks, max_tasks)

    def rows(source):
        packer, at = None, None
        for block, doc_id, piece, start, length, crc in source:
            if block != at:
                packer, at = SumOfSquares(capacity), block
            seq, offset = packer.place(length)
            yield doc_id, piece, start, length, crc, (block << 36) + seq, offset

    columns = ["block", "doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks))).repartitionById(tasks, F.expr(f"CAST(block % {tasks} AS INT)"))
    ordered = dealt.sortWithinPartitions("block", F.desc("length"), "doc_id", "piece", "ids_crc32", "number")
    return per_row(ordered.select(columns), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows)


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, block_pieces: int = BLOCK_PIECES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Encodes, cuts and packs all documents; one row per piece."""
    numbered = pieces(docs, capacity, path, cache_words).withColumn("number", F.monotonically_increasing_id())
    return pack(materialise(numbered, "pieces"), capacity, block_pieces)
