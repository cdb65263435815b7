"""Personal data by weak supervision, in DataFrame operations alone.

Candidates are regex matches of four base kinds and of further shapes (national ids, account numbers, titled names,
spelled-out addresses). Labelers vote on each candidate: the shape's own check (octets, Luhn, digit count), context
words before the span, context words after it, a gazetteer of given names, family names and mail providers (a parameter;
its words are looked up in a hash set), and separators in the number. Votes
are counted by pattern; expectation-maximisation over the counts estimates how often each labeler fires on personal
and on other spans, and a logistic classifier over kind and votes is trained on the resulting soft labels. Counts of
patterns are at most KINDS x 2^LABELERS rows whatever the input, so the fit is arithmetic over a bounded table; both
models are applied as column expressions.

Base spans that pass their check are always reported. Further spans are reported where the classifier is sure
(probability >= ACCEPT) and at least two labelers voted for them.

Patterns are written with possessive quantifiers and start at the start of a run or at the end of the last match, which
finds the same spans in time linear in the text; card numbers, whose matches are whole chains of digits, are counted by
the pattern itself. Offsets are sums of the lengths of matches and of the pieces between them, taken in blocks of BLOCK
matches so that texts with very many matches cost little more than a pass.

Defined results: a null or empty text has no spans; texts of any length are searched whole; repeated rows give repeated
results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import materialise, whole_text

#: kind -> (pattern, what a text must contain to be searched). Base kinds first; their order breaks ties.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", ""),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "+"),
}
EXTRA = {
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "account": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", ""),
    "name": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}+(?: [A-Z][a-z]{1,20}+)?", ""),
    "spelled_email": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{2,64}+ ?[\[(]dot[\])] ?[a-z]{2,10}+", "at"),
}
KINDS = (*BASE, *EXTRA)
LABELERS = ("check", "before", "after", "gazetteer", "separated")
CONTEXT = 24
_BEFORE = r"(?i)\b(?:e-?mail|mail|contact|phone|tel|mobile|call|fax|card|visa|mastercard|credit|ssn|social security|passport|iban|account|name|signed|attn|dear|ip|address|login|user)\b[^\n]{0,12}$"
_AFTER = r"(?i)^[^\n]{0,6}\b(?:e-?mail|phone|mobile|expires?|exp|cvv|born|dob|resident|wrote|writes|said)\b"
#: Words of the gazetteer: common given names, family names, and mail providers.
GAZETTEER = tuple("""
    james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven
    paul andrew george kenneth edward brian kevin mary patricia jennifer linda elizabeth barbara susan jessica sarah karen
    nancy lisa margaret sandra ashley emily donna michelle carol amanda laura jane anna emma alice
    jean pierre michel philippe alain nicolas marie nathalie isabelle sylvie catherine camille claire sophie
    hans peter klaus juergen stefan andreas markus ursula monika petra sabine claudia julia katharina
    jose juan antonio manuel francisco javier carlos miguel luis pedro maria carmen ana isabel lucia elena pilar
    smith johnson williams brown jones miller davis wilson anderson taylor moore jackson white harris clark lewis walker
    hall young king wright scott green baker adams nelson carter mitchell roberts turner phillips campbell parker evans
    martin bernard dubois durand leroy moreau laurent lefebvre fournier girard
    mueller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch richter
    garcia gonzalez rodriguez fernandez lopez martinez sanchez perez gomez ruiz diaz
    gmail yahoo hotmail outlook protonmail icloud gmx aol
""".split())
ACCEPT, MIN_VOTES = 0.9, 2
ROUNDS = 60
BLOCK = 256
_SPAN = "struct<k:int,s:int,e:int,ok:boolean,votes:int>"


def _octet() -> str:
    return "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    """Whether the digits of a string sum to a multiple of 10, each second one from the right doubled."""
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    """The check of a kind."""
    if kind == "ip":
        return value.rlike("^" + r"\.".join([_octet()] * 4) + "$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "national_id":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "account":
        return _digits(value) != ""
    return F.lit(True)


def _votes(kind: str, x: Column, names: tuple[str, ...]) -> Column:
    """The labelers' votes on a match as bits, in the order of LABELERS."""
    value = x["m"]
    near = F.right(x["p"], F.lit(CONTEXT))
    gazetteer = F.exists(F.split(F.lower(F.concat(near, F.lit(" "), value)), r"[^a-z\x{00C0}-\x{024F}]+"), lambda w: w.isin(*names))
    separated = F.lit(True) if kind in EXTRA else value.rlike(r"[0-9][ .()-]+[0-9]") if kind in ("card", "phone") else F.lit(False)
    fired = (passes(kind, value), near.rlike(_BEFORE), F.left(x["q"], F.lit(CONTEXT)).rlike(_AFTER), gazetteer, separated)
    bits = F.lit(0)
    for i, f in enumerate(fired):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return bits


def _found(kind: str, pattern: str, must: str, names: tuple[str, ...]) -> Column:
    """The matches of one kind in `t`: array of (kind number, start, end, check passed, votes)."""
    none = F.array().cast(f"array<{_SPAN}>")
    pieces = F.split("t", pattern, -1)
    matches = F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(pieces) - 1).alias("p"), F.slice(pieces, 2, F.size(pieces) - 1).alias("q"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 2) / BLOCK).cast("int")), lambda b: F.slice(zipped, b * BLOCK + 1, BLOCK))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        votes = _votes(kind, x, names)
        span = F.struct(F.lit(KINDS.index(kind)).alias("k"), start.alias("s"), end.alias("e"), votes.bitwiseAND(1).cast("boolean").alias("ok"), votes.alias("votes")).cast(_SPAN)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    outer = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    spans = F.flatten(F.aggregate(blocks, outer, block)["out"])
    there = F.col("t").rlike(pattern)
    return F.when((F.contains("t", F.lit(must)) & there) if must else there, spans).otherwise(none)


def candidates(docs: DataFrame, gazetteer: tuple[str, ...] = GAZETTEER) -> DataFrame:
    """doc_id and all candidate spans of each whole text."""
    texts = docs.select("doc_id", whole_text().alias("t"))
    return texts.select("doc_id", F.concat(*(_found(k, *spec, gazetteer) for k, spec in (BASE | EXTRA).items())).alias("spans"))


def em(patterns: list[tuple[int, int, int]]) -> tuple[float, list[float], list[float], list[float]]:
    """Expectation-maximisation over (kind, votes, n): share of personal spans, how often each labeler fires on personal
    and on other spans, and each pattern's probability of being personal."""
    k = len(LABELERS)
    share, hit, miss = 0.5, [0.8] * k, [0.2] * k
    soft = [0.5] * len(patterns)
    total = sum(n for _, _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        for i, (_, votes, _) in enumerate(patterns):
            a, b = math.log(share), math.log(1 - share)
            for j in range(k):
                fired = votes >> j & 1
                a += math.log(hit[j] if fired else 1 - hit[j])
                b += math.log(miss[j] if fired else 1 - miss[j])
            soft[i] = 1 / (1 + math.exp(min(700.0, b - a)))
        yes = sum(p * n for p, (_, _, n) in zip(soft, patterns))
        share = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        for j in range(k):
            on = sum(p * n for p, (_, v, n) in zip(soft, patterns) if v >> j & 1)
            off = sum((1 - p) * n for p, (_, v, n) in zip(soft, patterns) if v >> j & 1)
            # Prior counts keep a labeler that never fires from ruling alone.
            hit[j] = min(0.995, max(0.005, (on + 4) / (yes + 5)))
            miss[j] = min(0.995, max(0.005, (off + 1) / (total - yes + 5)))
    return share, hit, miss, soft


def classifier(patterns: list[tuple[int, int, int]], soft: list[float], rounds: int = 400) -> tuple[list[float], list[float]]:
    """Logistic regression on the soft labels: a weight per kind and one per labeler, by gradient steps."""
    kinds, votes = [0.0] * len(KINDS), [0.0] * len(LABELERS)
    total = sum(n for _, _, n in patterns) or 1
    for _ in range(rounds):
        gk, gv = [-0.001 * w for w in kinds], [-0.001 * w for w in votes]
        for (k, v, n), y in zip(patterns, soft):
            x = kinds[k] + sum(w for j, w in enumerate(votes) if v >> j & 1)
            error = n / total * (y - 1 / (1 + math.exp(-max(-40.0, min(40.0, x)))))
            gk[k] += error
            for j in range(len(votes)):
                if v >> j & 1:
                    gv[j] += error
        kinds = [w + 4 * g for w, g in zip(kinds, gk)]
        votes = [w + 4 * g for w, g in zip(votes, gv)]
    return kinds, votes


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_spans(docs: DataFrame, gazetteer: tuple[str, ...] = GAZETTEER) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans of each whole text."""
    found = materialise(candidates(docs, gazetteer), "pii-candidates")
    # At most len(KINDS) * 2 ** len(LABELERS) rows, whatever the input.
    counted = found.select(F.explode("spans").alias("x")).groupBy("x.k", "x.votes").count().collect()
    patterns = sorted((r["k"], r["votes"], r["count"]) for r in counted)
    kind_weights, vote_weights = classifier(patterns, em(patterns)[3])
    by_kind = F.array(*map(F.lit, kind_weights))

    def accepted(x: Column) -> Column:
        logit = F.get(by_kind, x["k"])
        for j, w in enumerate(vote_weights):
            logit = logit + F.when(x["votes"].bitwiseAND(1 << j) != 0, w).otherwise(0.0)
        sure = (logit >= math.log(ACCEPT / (1 - ACCEPT))) & (F.bit_count(x["votes"]) >= MIN_VOTES)
        return ((x["k"] < len(BASE)) & x["ok"]) | sure

    kept = found.select("doc_id", F.filter("spans", lambda x: (x["k"] < len(BASE)) & x["ok"]).alias("base"), F.filter("spans", accepted).alias("all"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return kept.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
