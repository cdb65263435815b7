"""Licence scans with a generalised suffix automaton.

The automaton accepts every run of words of the licence templates. A text's words stream through it and give matching
statistics: at each word, the longest run ending there that some template contains. Matches that cannot be extended and
have MIN_MATCH words or more (whose starts and ends both rise) are chained per template (rising in text and template, with gaps of at most MAX_GAP words)
into covered spans. A span that covers MIN_COVERED words of a template adds the template's label. The base phrases are
counted on their own and always keep their labels.

Words outside all templates cut the stream, so only runs of template words are walked. Templates are whole licence texts:
the short ones are below, the long ones are files of the folder licence_texts, named label-version.txt; other templates
can be given.

Defined results: a null or empty text has no words, no labels and score 0; texts of any length are read whole, one
automaton step a word; equal labels of several templates are one label; repeated rows give repeated results; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from bitloom.llm.common import per_row, text_bytes

#: Words of a match, words between chained matches, and covered words that make a label.
MIN_MATCH, MAX_GAP, MIN_COVERED = 4, 24, 12

#: label -> phrase whose consecutive words count as base findings.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: (label, template). Public licence texts without their copyright lines, and the notices that stand in source files.
SHORT = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
    associated documentation files (the "Software"), to deal in the Software without restriction, including without
    limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
    Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of
    the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
    NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
    SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
    CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
    THE SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
    compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
    on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
    the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
    General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
    option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
    WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
    General Public License for more details. You should have received a copy of the GNU General Public License along
    with this program. If not, see https://www.gnu.org/licenses/."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
    that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
    list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
    with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
    endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
    PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
    EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
    OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
    DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
    STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
    EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
    hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
    SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
    AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
    PERFORMANCE OF THIS SOFTWARE."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
    MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc", """This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License. To
    view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
    modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
    binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
    laws, the author or authors of this software dedicate any and all copyright interest in the software to the public
    domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
    successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
    rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
    OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
    NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE."""),
)


def long_texts(folder: Path = Path(__file__).parent / "licence_texts") -> tuple[tuple[str, str], ...]:
    """(label, template) of the text files of a folder, by name; the label is the name up to its first hyphen."""
    return tuple((p.stem.partition("-")[0], p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt")))


TEMPLATES = (*SHORT, *long_texts())

#: Bytes other than 0-9, a-z and those above 127 separate words; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8."""
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of symbols, with the places at which each state's runs end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self._settled = True

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the runs that reach it through p."""
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, sequence: list[int], name: int) -> None:
        """Adds all runs of a sequence; `name` and positions are kept with the states."""
        last = 0
        for at, c in enumerate(sequence):
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state(self.length[last] + 1), last
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p == -1:
                    self.link[new] = 0
                else:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                last = new
            self.ends[last].add((name, at))
        self._settled = False

    def settle(self) -> None:
        """Hands the end places up the suffix links."""
        if not self._settled:
            for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
                if self.link[s] > 0:
                    self.ends[self.link[s]] |= self.ends[s]
            self._settled = True

    def statistics(self, sequence):
        """(state, length of the longest run that ends here) for each symbol."""
        s, n = 0, 0
        following, link, length = self.next, self.link, self.length
        for c in sequence:
            while s and c not in following[s]:
                s = link[s]
                n = length[s]
            t = following[s].get(c)
            if t is not None:
                s, n = t, n + 1
            else:
                s, n = 0, 0
            yield s, n


def chain(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The words that the best chain ending in each match covers, and the match before it (-1: none).

    found: (start, end, start in the template), sorted; ends rise with starts, so the walk back stops at the first match
    that ends too early.
    """
    best, source = [], []
    for i, (start, end, place) in enumerate(found):
        cover, came = end - start, -1
        for j in range(i - 1, -1, -1):
            s, e, p = found[j]
            if start - e > MAX_GAP:
                break
            if s < start and p < place and place - (p + e - s) <= MAX_GAP:
                gained = best[j] + min(end - max(start, e), place + end - start - max(place, p + e - s))
                if gained > cover:
                    cover, came = gained, j
        best.append(cover)
        source.append(came)
    return best, source


class LicenseScanner:
    """Finds template spans and base phrases in texts."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for label, _ in templates]
        sequences = [words_of(t.encode("utf-8")) for _, t in templates]
        bases = {label: words_of(p.encode("utf-8")) for label, p in phrases.items()}
        every = sorted({w for s in [*sequences, *bases.values()] for w in s})
        self.ids = {w: i for i, w in enumerate(every)}
        self.sizes = [len(s) for s in sequences]
        self.bases = {label: [self.ids[w] for w in p] for label, p in bases.items()}
        self.automaton = SuffixAutomaton()
        for name, s in enumerate(sequences):
            self.automaton.add([self.ids[w] for w in s], name)
        self.automaton.settle()

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Template word numbers, -1 for other words."""
        get = self.ids.get
        return np.array([get(w, -1) for w in words], dtype=np.int32)

    def base(self, codes: np.ndarray) -> dict[str, np.ndarray]:
        """Starts of the base phrases by label."""
        out = {}
        for label, phrase in self.bases.items():
            n = len(codes) - len(phrase) + 1
            if n > 0:
                hit = codes[:n] == phrase[0]
                for k, c in enumerate(phrase[1:], 1):
                    hit &= codes[k : k + n] == c
                if hit.any():
                    out[label] = np.flatnonzero(hit)
        return out

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, state) of the longest matches of MIN_MATCH words or more, by start."""
        inside = np.concatenate(([False], codes >= 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        out = []
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if high - low < MIN_MATCH:
                continue
            previous = (0, 0)
            for at, here in enumerate(self.automaton.statistics(codes[low:high].tolist()), low):
                if previous[1] >= MIN_MATCH and here[1] <= previous[1]:
                    out.append((at - previous[1], at, previous[0]))
                previous = here
            if previous[1] >= MIN_MATCH:
                out.append((high - previous[1], high, previous[0]))
        return out

    def spans(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start word, end word, covered words) of the best chain of each place, overlaps resolved by cover."""
        per_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in self.matches(codes):
            for name, at in self.automaton.ends[state]:
                per_template.setdefault(name, []).append((start, end, at - (end - start) + 1))
        out = []
        for name, found in per_template.items():
            found.sort()
            best, source = chain(found)
            used: set[int] = set()
            covered: set[int] = set()
            for i in sorted(range(len(found)), key=lambda i: -best[i]):
                k, walked = i, []
                while k != -1 and k not in used:
                    used.add(k)
                    walked.append(k)
                    k = source[k]
                words = {w for m in walked for w in range(found[m][0], found[m][1])}
                fresh = words - covered
                if walked and k == -1:
                    out.append((name, found[walked[-1]][0], found[i][1], best[i]))
                elif fresh:  # the head belongs to a better chain: the tail is a span of its own, as far as it is not covered
                    out.append((name, min(fresh), max(fresh) + 1, len(fresh)))
                covered |= words
        return sorted(out)

    def scan(self, text: bytes) -> dict:
        """All findings in one text."""
        words = words_of(text)
        codes = self.codes(words)
        base = self.base(codes)
        starts = np.concatenate(list(base.values())) if base else np.empty(0, dtype=int)
        spans = [(n, s, e, min(c, self.sizes[n])) for n, s, e, c in self.spans(codes) if c >= MIN_COVERED]
        cover = max((c / self.sizes[n] for n, _, _, c in spans), default=0.0)
        labels = sorted({*base, *(self.labels[n] for n, _, _, _ in spans)})
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": int(starts.min()) if len(starts) else None, "last_word": int(starts.max()) if len(starts) else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(labels), "score": round(1 - (1 - min(1.0, cover)) * (0.5 if base else 1.0), 6),
            "spans": [(self.labels[n], s, e, c) for n, s, e, c in spans],
        }


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...]) -> LicenseScanner:
    """A worker builds its automaton once."""
    return LicenseScanner(templates)


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Counts, labels and score of each whole text, and its covered spans (label:start:end in words, comma-joined)."""

    def rows(source):
        scanner = _scanner(templates)
        for doc_id, text in source:
            x = scanner.scan(text)
            yield doc_id, x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"], x["labels"], x["score"], ",".join(f"{n}:{s}:{e}" for n, s, e, _ in x["spans"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return per_row(docs.select("doc_id", text_bytes().alias("t")), schema, rows)
