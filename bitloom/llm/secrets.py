"""Secret scans with multipart credential linking.

Base findings (assignments, access identifiers, long hex strings) are reported on their own. On top of them the parts
of a credential are looked for: access identifiers, secret strings and endpoints. A part is strong when a base pattern
vouches for it and weak when only its shape does (a short or client identifier, a high-entropy string, a service
endpoint). Parts are intervals; each access identifier opens a scope of SCOPE code points to either side that ends at
a blank line, and a sweep over the sorted intervals joins the parts that reach into a scope. A weak identifier,
secret or endpoint is reported only when the scope holds complementary parts: an identifier and a secret at least.

Defined results: a null or empty text has no findings; texts of any length are scanned whole and in time linear in
their length and findings, and parts of any length are linked; a weak part that overlaps a base finding is not reported
beside it; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import per_row, text_bytes, whole_text

#: Reported kinds, in the order that breaks ties: three base kinds, then the linked ones.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
#: Code points to either side of an identifier in which complementary parts count.
SCOPE = 400

_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_WORDS = re.compile(rb"(?i)password|passwd|secret|token|api_?key")
#: Weak shapes: identifiers named as such or cut short, and service endpoints.
_WEAK_ID = re.compile(rb"(?i:\b(?:access[_-]?(?:key[_-]?)?id|client[_-]?id|account[_-]?id|app[_-]?id)\b[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9_.-]{6,})|\b(A[KS]IA[A-Z0-9]{8,13})\b")
_WEAK_SECRET = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/=_-])")
#: What stands before a value that is assigned to a name of a secret.
_SECRET_NAME = re.compile(rb"(?i:secret|token|passw|key|credential|signature)[A-Za-z0-9_.-]*[\"']?\x20*[:=]\x20*[\"']?\Z")
_ENDPOINT = re.compile(rb"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~/-]*)?")
_SERVICE = re.compile(rb"\.amazonaws\.com\b")
_HOST = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789.-")


def _entropy(value: bytes) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def _dense(value: bytes, before: bytes) -> bool:
    """Whether a string looks like random key material: mixed classes and high entropy.

    Of fewer than three classes, it must be assigned to a name of a secret or mix its classes about as evenly as random
    characters do, which words, paths and capitalised names do not. Sixteen symbols cannot reach the entropy that three classes are asked for.
    """
    classes = [1 if c <= 57 else 2 if c <= 90 else 3 for c in value if c not in b"+/=_-"]
    if len(set(classes)) == 3:
        return _entropy(value) >= 3.6
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    mixed = 5 * changes >= len(value) and (1 in classes or 3 * min(classes.count(2), classes.count(3)) >= len(value))
    return (mixed or bool(_SECRET_NAME.search(before))) and _entropy(value) >= 3.0


def endpoints(text: bytes) -> list[tuple[int, int]]:
    """Ranges of service addresses: URLs, and host names of a known service, which are read backwards from their end."""
    urls = [m.span() for m in _ENDPOINT.finditer(text)]
    out, last = list(urls), 0
    for m in _SERVICE.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _HOST:
            at -= 1
        while at < m.start() and text[at] in b".-":
            at += 1
        i = bisect.bisect_right(urls, (at, len(text))) - 1
        if at < m.start() and (i < 0 or urls[i][1] <= at):
            out.append((at, m.end()))
        last = m.end()
    return out


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings in bytes, unsorted."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if _WORDS.search(text) else []
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _reach(text: bytes, s: int, e: int) -> tuple[int, int]:
    """Byte places SCOPE code points before s and after e, or the text's ends."""
    before, after = text[max(0, s - 4 * SCOPE) : s], text[e : e + 4 * SCOPE]
    if before.isascii() and after.isascii():
        return max(0, s - SCOPE), min(len(text), e + SCOPE)
    starts = [i for i, b in enumerate(before) if b & 0xC0 != 0x80]
    ends = [i for i, b in enumerate(after) if b & 0xC0 != 0x80]
    return s - len(before) + starts[-SCOPE] if len(starts) >= SCOPE else max(0, s - 4 * SCOPE), e + (ends[SCOPE] if len(ends) > SCOPE else len(after))


def linked_spans(text: bytes, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that complementary parts in their scope confirm."""
    ids = [(s, e, False) for s, e, k in base if k == "access"]
    ids += [(m.start(m.lastindex), m.end(m.lastindex), True) for m in _WEAK_ID.finditer(text)] if b"id" in text.lower() or b"IA" in text else []
    if not ids:
        return []
    taken = sorted((s, e) for s, e, _ in base)
    furthest = list(itertools.accumulate((e for _, e in taken), max))

    def free(s: int, e: int) -> bool:
        """Whether no base finding that starts before e ends after s."""
        i = bisect.bisect_left(taken, (e,)) - 1
        return i < 0 or furthest[i] <= s

    breaks = [m.start() for m in re.finditer(rb"\n[\x20\t\r]*\n", text)]
    named = {e for s, e, weak in ids if weak}
    secrets = [(s, e, False) for s, e, k in base if k in ("assign", "hex")]
    secrets += [(m.start(), m.end(), True) for m in _WEAK_SECRET.finditer(text) if m.end() not in named and _dense(m[0], text[max(0, m.start() - 80) : m.start()]) and free(*m.span())]
    points = [(a, b, True) for a, b in endpoints(text) if free(a, b)]

    def within(parts: list[tuple[int, int, bool]]):
        """A search for the parts that reach into a range, however long they are."""
        by_start, by_end = sorted(parts), sorted(parts, key=lambda x: x[1])
        starts, ends = [x[0] for x in by_start], [x[1] for x in by_end]
        return lambda low, high: {*by_start[bisect.bisect_left(starts, low) : bisect.bisect_left(starts, high)], *by_end[bisect.bisect_right(ends, low) : bisect.bisect_right(ends, high)]}

    secrets_in, points_in = within(secrets), within(points)
    out = set()
    for s, e, weak in ids:
        i = bisect.bisect_right(breaks, s)
        low, high = _reach(text, s, e)
        low = max(low, breaks[i - 1] if i else 0)
        high = min(high, breaks[i] if i < len(breaks) else len(text))
        near = [x for x in secrets_in(low, high) if x[1] <= s or x[0] >= e]
        if not near:
            continue
        if weak and free(s, e):
            out.add((s, e, "linked_id"))
        out.update((a, b, "linked_secret") for a, b, w in near if w)
        out.update((a, b, "linked_endpoint") for a, b, _ in points_in(low, high))
    return list(out)


def scan(text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base and linked spans in code points, each sorted by start and kind."""
    base = base_spans(text)
    linked = linked_spans(text, base)
    if not text.isascii() and (base or linked):
        places = sorted({p for s, e, _ in base + linked for p in (s, e)})
        at, last, seen = {}, 0, 0
        for p in places:
            seen += len(text[last:p].decode("utf-8", "surrogateescape"))
            at[p], last = seen, p
        base = [(at[s], at[e], k) for s, e, k in base]
        linked = [(at[s], at[e], k) for s, e, k in linked]
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=order), sorted(linked, key=order)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of the base spans, and all spans of each whole text."""

    def rows(source):
        for doc_id, text in source:
            base, linked = scan(text)
            n = Counter(k for _, _, k in base)
            both = sorted(base + linked, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
            yield doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both)

    return per_row(docs.select("doc_id", text_bytes().alias("t")), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", rows)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every reported span of `text` replaced by a mark, and n_chars brought up to date.

    A null text stays null. Overlapping spans are replaced together.
    """

    def rows(source):
        for row in source:
            *rest, text = row
            if text:
                base, linked = scan(text.encode("utf-8", "surrogatepass"))
                if base or linked:
                    out, at = [], 0
                    for s, e, _ in sorted(base + linked):
                        if s >= at:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    text = "".join([*out, text[at:]])
            yield (*rest, text)

    names = docs.columns
    arranged = docs.select(*(c for c in names if c != "text"), "text")
    done = per_row(arranged, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in arranged.schema), rows)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length(whole_text()).cast(docs.schema["n_chars"].dataType))
    return done.select(*names)
