"""Byte-pair encoding and decoding with a public vocabulary of word-end pieces.

Encoding a word keeps its symbols in a doubly linked list and the possible merges in a priority queue ordered by
(merge rank, place). An entry taken from the queue is stale, and skipped, when its left symbol is gone or when the
pair that now stands there merges into something else. Decoding concatenates vocabulary strings, with one space
between tokens, as the vocabulary file names no decoder.

Defined results: a null or empty text has no tokens; texts of any length are encoded whole; special tokens that occur
literally in a text get their own ids, as in the library that the vocabulary file is meant for; repeated rows give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import per_row, remembered, whole_text

#: Words that a worker remembers at most; the memory is emptied when full. Results do not depend on it.
CACHE_WORDS = 250_000
#: Longer words are encoded without being remembered.
CACHE_LENGTH = 48


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache(dict):
    """word -> value, computed on a miss; emptied when it holds `limit` words."""

    def __init__(self, make: Callable[[str], bytes], limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _ranges(of: Callable[[str], bool], top: int) -> str:
    """A regex class body of the code points up to `top` that satisfy `of`."""
    out, start = [], None
    for cp in range(top + 2):
        inside = cp <= top and not 0xD800 <= cp < 0xE000 and of(chr(cp))
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


#: White space as the splitting pattern of the vocabulary file means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Texts are split with the smallest alphabet that holds them: classes over few code points match many times faster.
ALPHABETS = (0x7F, 0x24F, 0xFFFF, sys.maxunicode)
_BEYOND = [re.compile(f"[^\\x00-\\U{top:08x}]") for top in ALPHABETS[:-1]]


@lru_cache(maxsize=len(ALPHABETS))
def _patterns(top: int) -> tuple[re.Pattern, re.Pattern | None]:
    """The word pattern for texts of code points up to `top`, and a pattern of those that this Python does not know."""
    letters = _ranges(lambda c: unicodedata.category(c)[0] == "L", top)
    numbers = _ranges(lambda c: unicodedata.category(c)[0] == "N", top)
    unknown = _ranges(lambda c: unicodedata.category(c) == "Cn", top)
    words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
    return words, re.compile(f"[{unknown}]") if unknown else None


class WordBpe:
    """An encoder and decoder for a vocabulary file with word-end pieces."""

    def __init__(self, path: str | None = None):
        self.path = path or vocabulary_path()
        spec = json.load(open(self.path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        symbols = _byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.end) for s in symbols]
        self.byte_symbols = symbols
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self._library = None

    def library(self):
        """The tokenizers library's object for the same file: for code points newer than this Python, and in tests."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word, by a queue of merge ranks over a linked list of symbols."""
        raw = word.encode("utf-8")
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, new = pop(queue)
            j = after[i]
            if ids[i] is None or j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if not found or found[1] != new:
                continue
            k = after[j]
            ids[i], ids[j], after[i] = new, None, k
            if k < n:
                before[k] = i
                found = merges.get((new, ids[k]))
                if found:
                    push(queue, (found[0], i, found[1]))
            p = before[i]
            if p >= 0:
                found = merges.get((ids[p], new))
                if found:
                    push(queue, (found[0], p, found[1]))
        return [i for i in ids if i is not None]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised (NFC, lower case)."""
        if text.isascii():
            return _patterns(ALPHABETS[0])[0].findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        low = text.replace("Σ", "σ").lower()
        top = next((t for t, beyond in zip(ALPHABETS, _BEYOND) if not beyond.search(low)), sys.maxunicode)
        words, unknown = _patterns(top)
        if unknown and unknown.search(text):
            mapped = self.library().pre_tokenizer.pre_tokenize_str(self.library().normalizer.normalize_str(text))
            back = {s: b for b, s in enumerate(self.byte_symbols)}
            return [bytes(back[c] for c in w).decode("utf-8") for w, _ in mapped]
        return words.findall(low)

    def pieces(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(None, words) and (special id, []) in the order of the text."""
        if "<|" not in text:
            yield None, self.words(text)
            return
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:
                yield self.special[part], []
            elif part:
                yield None, self.words(part)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text."""
        out: list[int] = []
        for special, words in self.pieces(text or ""):
            if special is not None:
                out.append(special)
            for w in words:
                out += self.encode_word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids, with one space between them."""
        return " ".join(self.tokens[i] for i in ids)

    def joined(self, text: str, cache: WordCache, special: Callable[[int], bytes]) -> list[bytes]:
        """What the cache holds for each word of a text, in order."""
        out: list[bytes] = []
        get = cache.__getitem__
        for mark, words in self.pieces(text):
            if mark is not None:
                out.append(special(mark))
            out += map(get, words)
        return out


_CODERS: dict[str, WordBpe] = {}


def coder(path: str | None = None) -> WordBpe:
    """This process's encoder for a file; workers keep it between tasks."""
    path = path or vocabulary_path()
    if path not in _CODERS:
        _CODERS[path] = WordBpe(path)
    return _CODERS[path]


def cache(path: str, kind: str, make: Callable[[str], bytes], limit: int = CACHE_WORDS) -> WordCache:
    """This process's memory of encoded words."""
    return remembered((path, kind, limit), lambda: WordCache(make, limit))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text: a full encoding and decoding of each.

    Only doc_id and text are read, so other columns of any name do no harm; repeated rows give repeated results.
    """

    def rows(source):
        bpe = coder(path)
        words = cache(bpe.path, "decimal", lambda w: b" ".join(b"%d" % i for i in bpe.encode_word(w)))
        strings = {b"%d" % i: s.encode("utf-8") for i, s in bpe.tokens.items()}
        for doc_id, text in source:
            ids = b" ".join(bpe.joined(text, words, lambda i: b"%d" % i))
            each = ids.split(b" ") if ids else []
            decoded = b" ".join(map(strings.__getitem__, each))
            yield doc_id, len(each), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return per_row(docs.select("doc_id", whole_text().alias("t")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows, 64, True)


def encode_column(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and its token ids as an array column."""

    def rows(source):
        bpe = coder(path)
        words = cache(bpe.path, "ids", lambda w: tuple(bpe.encode_word(w)))
        for doc_id, text in source:
            yield doc_id, [i for w in bpe.joined(text, words, lambda i: (i,)) for i in w]

    return per_row(docs.select("doc_id", whole_text().alias("t")), "doc_id long, ids array<int>", rows, 64, True)


def decode_column(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded text of an ids column; null ids decode to the empty text."""

    def rows(source):
        bpe = coder(path)
        for doc_id, ids in source:
            yield doc_id, bpe.decode(ids or [])

    return per_row(encoded.select("doc_id", F.col("ids")), "doc_id long, text string", rows, 256)
