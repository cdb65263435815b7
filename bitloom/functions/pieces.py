"""A greedy longest-match tokenizer over a vocabulary of pieces.

Words carry a boundary marker in front. At each place the longest piece of at most MAX_BYTES bytes is taken; where none fits,
the byte's own piece (<0xNN>) or else the unknown piece. Tokens in angle brackets that the vocabulary has are matched whole.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "▁"
MAX_BYTES = 32


class PieceTokenizer:
    """Vocabulary lines in id order. A list of at most one line means one id a byte."""

    def __init__(self, pieces: list[str], marker: str = MARKER, bos: str = "<s>", unknown: str = "<unk>"):
        self.pieces, self.marker = pieces, marker
        self.ids: dict[str, int] = {}
        for i, p in enumerate(pieces):
            self.ids.setdefault(p, i)
        self.bytes_only = len(pieces) <= 1
        self.bos, self.unknown = self.ids.get(bos, -1), self.ids.get(unknown, 0)
        special = [p for p in self.ids if re.fullmatch(r"<[^<>]+>", p) and not p.startswith("<0x")]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.by_bytes = {p.encode(): i for p, i in self.ids.items()}
        self.longest = min(MAX_BYTES, max(map(len, self.by_bytes), default=0))

    def _plain(self, text: str) -> list[int]:
        out = []
        for part in re.split(r"([\n\r\t])", text):
            if part in ("\n", "\r", "\t") and part:
                out.append(self._byte(part.encode()[0]))
                continue
            raw = re.sub(r"(^|[ ]+)([^ ])", self.marker + r"\2", part).encode()
            at = 0
            while at < len(raw):
                for n in range(min(self.longest, len(raw) - at), 0, -1):
                    found = self.by_bytes.get(raw[at : at + n])
                    if found is not None:
                        out.append(found)
                        at += n
                        break
                else:
                    out.append(self._byte(raw[at]))
                    at += 1
        return out

    def _byte(self, b: int) -> int:
        for name in (chr(b), f"<0x{b:02X}>"):
            if name in self.ids and (b < 128 or name.startswith("<0x")):
                return self.ids[name]
        return self.unknown

    def encode(self, text: str) -> list[int]:
        if self.bytes_only:
            return list(text.encode()) or [32]
        out = [self.bos] if self.bos >= 0 else []
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                out.append(self.ids[part])
            elif part:
                out += self._plain(part)
        return out

    def decode(self, ids: list[int]) -> str:
        if self.bytes_only:
            return bytes(ids).decode("utf-8", "replace")
        raw = b""
        for i in ids:
            p = self.pieces[i]
            if i == self.bos:
                continue
            raw += bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.encode()
        return raw.decode("utf-8", "replace").replace(self.marker, " ").removeprefix(" ")


def encode_column(pieces: list[str], text: Column) -> Column:
    """Ids of a text column; the vocabulary (some ten thousand lines) travels with the function."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        tokenizer = PieceTokenizer(pieces)
        return texts.map(lambda t: tokenizer.encode(t) if t is not None else None)

    return run(text)
