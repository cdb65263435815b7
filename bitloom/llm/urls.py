"""URL filters: allow and block rules, and character language models for the URLs that no rule decides.

Two smoothed variable-order Markov models (contexts of ORDER down to 0 bytes, Witten-Bell interpolation; contexts seen
less than MIN_CONTEXT times fall back to shorter ones) are counted over all URLs that a rule allows and that a rule
blocks. A URL is judged by the difference of its log-likelihoods per byte. The cut is calibrated for the best balanced
accuracy on a hash fold of the ruled URLs that is kept out of the counts.

A gram is a byte with its context, in one 64-bit number. The counts are a distributed table with a row per gram of the
input, so they grow with it, and the shorter grams are sums of the longer ones. A context has at most 256 rows in its
table, and a gram of one level at most 256 in the next, so neither the windows nor the joins of the levels meet a hot key.
For scoring, the grams that make up more than one in HOT of all places, of which there can be no more than HOT, go to the
tasks as an array; the places of all others, which are no hot keys for the same reason, are joined with the table.
Differences are integers, so that their sums do not depend on the order.

Defined results: a null URL or one without "://" has an empty host and path and no rule; the models judge it by its
bytes, and a null or empty one, without bytes, is allowed; so is everything where rules leave no URLs of both kinds to
learn from. Repeated rows count and are judged each; a null page_id is judged like any other; an empty table gives an
empty result; URLs of any length are read whole. Columns other than page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import materialise

#: (host and path of the rule, verdict).
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: Bytes of the longest context: with the byte that follows it, a gram fills a 64-bit number.
ORDER = 7
MIN_CONTEXT = 2
#: One in FOLDS ruled URLs calibrates the cut.
FOLDS = 5
#: Grams that are sent to the tasks at most, 16 bytes each.
HOT = 100_000
#: Bytes of URLs that a task takes at once, and units of a log-likelihood.
SLICE_BYTES, UNIT = 1 << 20, 1_000_000_000
#: Bins of the calibration: score per byte times this, cut at +-BINS.
BINS_PER_UNIT, BINS = 100, 1000


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule and ruled (the rule's verdict) of each page; the longest fitting rule counts."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    parts = pages.select("page_id", url.alias("url"), rest.alias("rest"))
    parts = parts.select("page_id", "url", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), upper, lower).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    rule: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return parts.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of the URLs, A-Z as a-z and zeros before the start, and the length of each URL."""
    n = np.array([len(u) for u in urls], dtype=np.int64)
    raw = np.frombuffer(b"".join(bytes(ORDER) + u.lower() for u in urls), dtype=np.uint8).astype(np.uint64)
    codes = np.zeros(len(raw), dtype=np.uint64)
    for k in range(ORDER, -1, -1):
        codes[k:] = (codes[k:] << np.uint64(8)) | raw[: len(raw) - k]
    heads = np.cumsum(n + ORDER) - n - ORDER
    inside = np.ones(len(raw), dtype=bool)
    for k in range(ORDER):
        inside[heads + k] = False
    return codes[inside].view(np.int64), n


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE_BYTES of their first column; a longer value is a part of its own."""
    for batch in batches:
        sizes = np.cumsum([len(u) for u in batch.column(0).to_pylist()])
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def counts(urls: DataFrame) -> DataFrame:
    """(gram, a, b, n): how often each gram occurs in the URLs of side 1 (a), of side 0 (b) and in all, over all rows of (url, side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            codes, n = grams(part.column(0).to_pylist())
            side = np.repeat(part.column(1).to_numpy(), n)
            seen, at = np.unique(codes, return_inverse=True)
            each = [np.bincount(at, weights=w, minlength=len(seen)).astype(np.int64) for w in (side == 1, side == 0, np.ones(len(side)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seen, *each)], names=["gram", "a", "b", "n"])

    found = urls.select(F.col("url").cast("binary"), F.col("side").cast("int")).mapInArrow(run, "gram long, a long, b long, n long")
    return found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in "abn"))


def log_ratios(counted: DataFrame) -> DataFrame:
    """(gram, ratio, n): log P(byte | context) on side 1 less that on side 0, in UNITs, of every gram of a materialised table of counts."""
    levels = [counted]
    for k in range(ORDER - 1, -1, -1):
        shorter = levels[0].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(*(F.sum(c).alias(c) for c in "abn"))
        levels.insert(0, materialise(shorter, f"url-grams-{k}"))
    context = Window.partitionBy("context")

    def totals(level: DataFrame) -> DataFrame:
        at = level.withColumn("context", F.shiftrightunsigned("gram", 8))
        both = [f(c).over(context).alias(f"{name}_{c}") for c in "ab" for name, f in (("total", F.sum), ("kinds", lambda c: F.sum((F.col(c) > 0).cast("long"))))]
        return at.select("gram", "a", "b", "n", *both)

    def longer(known: DataFrame, k: int) -> DataFrame:
        back = known.select(F.col("gram").alias("back"), F.col("p_a").alias("back_a"), F.col("p_b").alias("back_b"))
        here = totals(levels[k])
        met = here.join(back, here["gram"].bitwiseAND(F.lit((1 << 8 * k) - 1)) == back["back"])
        p = [F.when(F.col(f"total_{c}") >= MIN_CONTEXT, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"back_{c}")) / (F.col(f"total_{c}") + F.col(f"kinds_{c}"))).otherwise(F.col(f"back_{c}")) for c in "ab"]
        return met.select("gram", "n", p[0].alias("p_a"), p[1].alias("p_b"))

    base = totals(levels[0]).select("gram", "n", *(((F.col(c) + 1) / (F.col(f"total_{c}") + 256)).alias(f"p_{c}") for c in "ab"))
    top = reduce(longer, range(1, ORDER + 1), base)
    return top.select("gram", F.round((F.log("p_a") - F.log("p_b")) * UNIT).cast("long").alias("ratio"), "n")


def url_sums(urls: DataFrame, ratios: DataFrame, places: int) -> DataFrame:
    """(row, total, places): the sum of the ratios over each URL's grams, from (url, row) and a materialised table of ratios."""
    often = f"n > {places // HOT}"
    common = ratios.filter(often).select("gram", "ratio").orderBy("gram").toArrow()
    keys, values = common.column("gram").to_numpy(), common.column("ratio").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            codes, n = grams(part.column(0).to_pylist())
            at = np.minimum(np.searchsorted(keys, codes), max(0, len(keys) - 1))
            known = keys[at] == codes if len(keys) else np.zeros(len(codes), dtype=bool)
            sums = np.concatenate(([0], np.cumsum(np.where(known, values[at] if len(keys) else 0, 0))))
            ends, rows = np.cumsum(n), part.column(1).to_numpy()
            rare = np.repeat(rows, n)[~known]
            some, none = np.zeros(len(rare), dtype=bool), np.ones(len(rows), dtype=bool)
            columns = [np.concatenate(c) for c in ((rows, rare), (np.zeros(len(rows), dtype=np.int64), codes[~known]), (sums[ends] - sums[ends - n], np.zeros(len(rare), dtype=np.int64)), (n, np.zeros(len(rare), dtype=np.int64)), (none, some))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "gram", "total", "places", "summed"])

    found = materialise(urls.select(F.col("url").cast("binary"), "row").mapInArrow(run, "row long, gram long, total long, places long, summed boolean"), "url-places")
    rare = found.filter("NOT summed").select("row", "gram").join(ratios.filter(f"NOT ({often})").select("gram", "ratio"), "gram")
    parts = found.filter("summed").select("row", "total", "places").unionByName(rare.select("row", F.col("ratio").alias("total"), F.lit(0).cast("long").alias("places")))
    return parts.groupBy("row").agg(F.sum("total").alias("total"), F.sum("places").alias("places"))


def scored(ruled: DataFrame) -> tuple[DataFrame, bool]:
    """Adds `score` to a materialised table with url, ruled, held and row; and whether there are URLs of both kinds to learn from."""
    side = F.when(F.col("ruled").isNull() | F.col("held"), -1).when(F.col("ruled") == "allow", 1).otherwise(0)
    counted = materialise(counts(ruled.select("url", side.alias("side"))), "url-grams")
    a, b, places = counted.agg(F.sum("a"), F.sum("b"), F.sum("n")).first()
    if not a or not b:
        return ruled.withColumn("score", F.lit(0.0)), False
    sums = url_sums(ruled, materialise(log_ratios(counted), "url-ratios"), places)
    score = F.coalesce(F.col("total") / UNIT / F.greatest(F.col("places"), F.lit(1)), F.lit(0.0))
    return materialise(ruled.join(sums, "row", "left").withColumn("score", score).drop("total", "places"), "scored-urls"), True


def calibrated(rows: DataFrame) -> float:
    """The cut with the best balanced accuracy on the held fold."""
    bins = F.least(F.lit(BINS), F.greatest(F.lit(-BINS), F.floor(F.col("score") * BINS_PER_UNIT))).cast("int").alias("bin")
    held = rows.filter("held AND ruled IS NOT NULL").groupBy(bins, (F.col("ruled") == "allow").alias("allowed")).count()
    return best_cut({(r["bin"], r["allowed"]): r["count"] for r in held.collect()})


def best_cut(histogram: dict[tuple[int, bool], int]) -> float:
    """The bin edge with the best balanced accuracy, the middle of a run of equally good ones; 0 if a kind is missing."""
    total = {side: sum(n for (_, s), n in histogram.items() if s == side) for side in (True, False)}
    if not total[True] or not total[False]:
        return 0.0
    best, edges, allowed, blocked = -1.0, [], total[True], 0
    for edge in range(-BINS, BINS + 2):  # bins below the edge are blocked
        value = allowed / total[True] + blocked / total[False]
        if value > best + 1e-12:
            best, edges = value, [edge]
        elif value > best - 1e-12:
            edges.append(edge)
        allowed -= histogram.get((edge, True), 0)
        blocked += histogram.get((edge, False), 0)
    return (edges[0] + edges[-1]) / 2 / BINS_PER_UNIT


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log-likelihood difference per byte) of each page."""
    held = F.crc32(F.col("url").cast("binary")) % FOLDS == 0
    ruled = materialise(with_rules(pages, rules).withColumns({"held": held, "row": F.monotonically_increasing_id()}), "ruled-urls")
    rows, learned = scored(ruled)
    cut = calibrated(rows) if learned else 0.0
    judged = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when((F.col("url") == "") | (F.col("score") >= cut), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", "rule", judged.alias("verdict"), F.round("score", 6).alias("score"))
