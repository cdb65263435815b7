"""Toxic spans and document scores from a linear-chain conditional random field.

Fitting uses a bounded, hash-ordered sample of labelled training rows (`max_toxic` and `max_clean`, counted per label),
and of that sample every feature that passes the test and every segment.
Tokens get labels from their documents: a token is toxic if its document is labelled toxic and the token carries a
feature (the word, or its first 4 or 5 letters) whose document counts are toxic beyond chance, tested against the
number of features tried. The field has two states, weights for these features, a bias and four transition weights, and
is fitted to segments of SEGMENT tokens that hold a feature. The penalised likelihood is concave; limited-memory
quasi-Newton steps climb it, and tasks sum likelihood and gradient over the segments, of which equal ones are counted.

Scoring runs forward-backward over a whole text. Between tokens that carry a feature the potentials are constant, so
a gap of any length is one step with a closed-form power of the 2x2 transfer matrix. The marginals of the feature
tokens aggregate to a document's evidence (largest marginal, expected number of toxic tokens, noisy-or), which a
logistic calibration turns into the score. Neither labels, lang, source nor doc_id enter a score.

Defined results: a null or empty text scores the calibration's intercept; without labelled rows of both kinds every
score is 0; a label row that is null is ignored, and of repeated label rows the largest counts; a null doc_id is never
held out and never used for fitting; of documents that share a labelled doc_id the longest text is fitted once, and each
is scored by its own text; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.bpe import WordCache
from bitloom.llm.common import materialise, per_row, remembered, whole_text

#: Documents above this score are rejected.
THRESHOLD = 0.7
#: Bounds of the fitting sample, in labelled rows.
MAX_TOXIC, MAX_CLEAN = 6_000, 14_000
#: How many times the sample's odds of being toxic a feature's documents have at least: one half at a share of 1 in 8.
#: A ratio of odds is the same whatever share of the sample is toxic.
MIN_ODDS = 7.0
#: Tokens of a training segment.
SEGMENT = 24
#: Penalty of the field's squared weights, halved.
PENALTY = 1.0

#: Words whose features a worker remembers.
MEMORY_WORDS = 60_000

_TOKEN = re.compile(r"[^\W_]+")


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def features(word: str) -> list[str]:
    """A word's features: itself and its beginnings."""
    return ["=" + word, *(f"{k}{word[:k]}" for k in (4, 5) if len(word) > k)]


class Field:
    """A fitted model: feature weights, transfer matrices and calibration."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, calibration: list[float]):
        self.weights, self.bias, self.transitions, self.calibration = weights, bias, transitions, calibration
        t = np.exp(transitions)
        m = t * np.array([1.0, math.exp(bias)])  # step to a token without features
        values, left = np.linalg.eig(m)
        order = np.argsort(-values.real)
        values, left = values.real[order], left.real[:, order]
        right = np.linalg.inv(left)
        self.ratio = float(values[1] / values[0])
        self.stay = np.outer(left[:, 0], right[0]).tolist()
        self.fade = np.outer(left[:, 1], right[1]).tolist()
        self.t = t.tolist()
        #: Names the weights: equal weights, equal key, in every process.
        self.key = hashlib.sha256(repr(sorted(weights.items())).encode()).hexdigest()

    def gap(self, n: int) -> list[list[float]]:
        """The transfer over n tokens without features, up to a factor."""
        r = self.ratio**n
        return [[s + r * f for s, f in zip(a, b)] for a, b in zip(self.stay, self.fade)]

    def marginals(self, places: list[int], emissions: list[float], n: int) -> list[float]:
        """P(toxic) at each feature token of a text of n tokens; emissions are its feature weights' sums."""
        t, e0 = self.t, self.bias
        forward, k = [], len(places)
        a, last = None, -1
        for at, w in zip(places, emissions):
            step = at - last - 1
            if a is None:
                if step:
                    first = [1.0, math.exp(e0)]
                    g = self.gap(step - 1)
                    a = [first[0] * g[0][y] + first[1] * g[1][y] for y in (0, 1)]
                    p = [a[0] * t[0][y] + a[1] * t[1][y] for y in (0, 1)]
                else:
                    p = [1.0, 1.0]
            else:
                if step:
                    g = self.gap(step)
                    a = [a[0] * g[0][y] + a[1] * g[1][y] for y in (0, 1)]
                p = [a[0] * t[0][y] + a[1] * t[1][y] for y in (0, 1)]
            x = min(50.0, max(-50.0, w + e0))
            a = [p[0], p[1] * math.exp(x)]
            z = a[0] + a[1]
            a = [a[0] / z, a[1] / z]
            forward.append(a)
            last = at
        out = [0.0] * k
        b, following = [1.0, 1.0], n
        for i in range(k - 1, -1, -1):
            step = following - places[i] - 1
            if step:
                g = self.gap(step)
                b = [g[y][0] * b[0] + g[y][1] * b[1] for y in (0, 1)]
            u, v = forward[i][0] * b[0], forward[i][1] * b[1]
            out[i] = min(1.0, max(0.0, v / (u + v)))
            x = math.exp(min(50.0, max(-50.0, emissions[i] + e0)))
            b = [t[y][0] * b[0] + t[y][1] * x * b[1] for y in (0, 1)]
            z = b[0] + b[1]
            b, following = [b[0] / z, b[1] / z], places[i]
        return out

    def score(self, evidence: tuple[float, ...]) -> float:
        """Calibrated probability that a document is labelled toxic."""
        if not self.calibration:
            return 0.0
        x = self.calibration[-1] + sum(w * v for w, v in zip(self.calibration, evidence))
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, x))))


def evidence(marginals: list[float]) -> tuple[float, float, float]:
    """Largest marginal, log of the expected toxic tokens, and noisy-or log odds (capped)."""
    none = sum(math.log1p(-min(p, 1 - 1e-9)) for p in marginals)
    return max(marginals, default=0.0), math.log1p(sum(marginals)), min(8.0, -none)


class Scorer:
    """Applies a field to texts; remembers words within a worker."""

    def __init__(self, field: Field):
        self.field = field
        weights = field.weights
        self.words = remembered(field.key, lambda: WordCache(lambda w: tuple(weights[f] for f in features(w) if f in weights), MEMORY_WORDS))

    def read(self, text: str) -> tuple[str, list[int], list[float]]:
        """The lower-cased text, places of feature tokens, and their marginals."""
        low = text.lower()
        found = list(map(self.words.__getitem__, _TOKEN.findall(low)))
        if not any(found):
            return low, [], []
        places = [i for i, x in enumerate(found) if x]
        return low, places, self.field.marginals(places, [sum(found[i]) for i in places], len(found))

    def spans(self, text: str, low: str, places: list[int], marginals: list[float]) -> list[tuple[int, int]]:
        """Offsets (code points) of toxic tokens; adjacent ones together."""
        toxic = {i for i, p in zip(places, marginals) if p >= 0.5}
        out: list[list[int]] = []
        if not toxic or len(low) != len(text):  # lower-casing that changes lengths: tokens are found in the text itself
            low = text
        last = -2
        for i, m in enumerate(_TOKEN.finditer(low) if toxic else ()):
            if i in toxic:
                if i == last + 1:
                    out[-1][1] = m.end()
                else:
                    out.append([m.start(), m.end()])
                last = i
        return [tuple(x) for x in out]


def _sample(labels: DataFrame, max_toxic: int, max_clean: int) -> tuple[DataFrame, dict[int, int]]:
    """Ids and labels of the fitting sample, and how many training rows each label has."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [usable.filter(F.col("toxic") == y).orderBy(*order).limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    return materialise(parts[0].union(parts[1]), "fit-sample"), counts


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Field:
    """Fits the field and its calibration to at most max_toxic and max_clean labelled training rows of `docs`."""
    sample, counts = _sample(labels.select("doc_id", "toxic"), max_toxic, max_clean)
    empty = Field({}, -3.0, np.zeros((2, 2)), [])
    if not counts.get(0) or not counts.get(1):
        return empty
    # At most max_toxic + max_clean rows of two numbers: a bounded broadcast, so that no text is shuffled.
    texts = docs.select("doc_id", whole_text().alias("t")).join(F.broadcast(sample), "doc_id")
    # One row for each sampled id however often it repeats; a hot one is one row of each task before the shuffle.
    texts = texts.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max_by("t", F.struct(F.length("t"), F.xxhash64("t"))).alias("t"))
    texts = materialise(texts.select("toxic", "t"), "fit-texts")

    def count(source):
        held: Counter = Counter()
        for toxic, text in source:
            seen = {f for w in set(_TOKEN.findall(text.lower())) for f in features(w)}
            held.update((f, toxic) for f in seen)
            if len(held) > 50_000:
                yield from ((f, n * y, n) for (f, y), n in held.items())
                held.clear()
        yield from ((f, n * y, n) for (f, y), n in held.items())

    used = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not used.get(0) or not used.get(1):
        return empty
    per_feature = per_row(texts, "f string, toxic_n long, n long", count).groupBy("f").agg(F.sum("toxic_n").alias("a"), F.sum("n").alias("n")).filter("a >= 3 AND n >= 4")
    per_feature = materialise(per_feature, "features")
    base = used[1] / (used[0] + used[1])
    p = F.col("a") / F.col("n")
    gain = F.col("a") * F.log(p / base) + F.when(p < 1, (F.col("n") - F.col("a")) * F.log((1 - p) / (1 - base))).otherwise(0.0)
    tried = max(1, per_feature.count())
    likely = F.col("a") * used[0] > MIN_ODDS * used[1] * (F.col("n") - F.col("a"))
    kept = per_feature.filter(likely).withColumn("gain", gain).filter(F.col("gain") > math.log(100.0 * tried)).orderBy(F.desc("gain"), "f")
    # No more than the words of the sample: features that are toxic beyond chance.
    names = [r["f"] for r in kept.select("f").collect()]
    if not names:
        return empty
    index = {f: i for i, f in enumerate(names)}

    def segments(source):
        memory = WordCache(lambda w: [index[f] for f in features(w) if f in index], MEMORY_WORDS)
        for toxic, text in source:
            found = list(map(memory.__getitem__, _TOKEN.findall(text.lower())))
            for at in range(0, len(found), SEGMENT):
                part = found[at : at + SEGMENT]
                if any(part):
                    yield toxic, len(part), [i for i, x in enumerate(part) for _ in x], [f for x in part for f in x]

    cut = per_row(texts, "toxic int, n int, places array<int>, feature array<int>", segments)
    cut = materialise(cut.groupBy("toxic", "n", "places", "feature").agg(F.count(F.lit(1)).alias("times")), "fit-segments")
    theta = np.zeros(len(names) + 5)
    theta[len(names)] = -2.0
    theta = climb(lambda at: likelihood(cut, at, len(names)), theta)
    field = Field(dict(zip(names, theta[: len(names)].tolist())), float(theta[len(names)]), theta[len(names) + 1 :].reshape(2, 2), [])

    def measure(source):
        scorer = Scorer(field)
        for toxic, text in source:
            _, _, m = scorer.read(text)
            yield (toxic, *evidence(m))

    # A row for each row of the sample: max_toxic + max_clean at most.
    rows = per_row(texts, "toxic int, a double, b double, c double", measure, remembers=True).toArrow()
    y, x = rows.column(0).to_numpy().astype(float), np.column_stack([rows.column(i).to_numpy() for i in (1, 2, 3)])
    field.calibration = _logistic(x, y, np.where(y > 0, counts[1] / used[1], counts[0] / used[0]))
    return field


def segment_sums(theta: np.ndarray, toxic: np.ndarray, n: np.ndarray, times: np.ndarray, seg: np.ndarray, place: np.ndarray, feat: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of labelled segments and its gradient; segment i counts times[i].

    Entry j says that segment seg[j] has feature feat[j] at its token place[j]; those tokens are toxic in toxic segments.
    """
    s, k = len(n), len(theta) - 5
    w, b, t = theta[:k], theta[k], theta[k + 1 :].reshape(2, 2)
    inside = np.arange(SEGMENT)[None, :] < n[:, None]
    gold = np.zeros((s, SEGMENT), dtype=int)
    gold[seg, place] = toxic[seg]
    x = np.bincount(seg * SEGMENT + place, weights=w[feat], minlength=s * SEGMENT).reshape(s, SEGMENT) + b
    e = np.ones((SEGMENT, s, 2))
    e[:, :, 1] = np.exp(np.clip(x, -30, 30)).T
    move = np.exp(t)
    alpha, beta = np.empty((SEGMENT, s, 2)), np.ones((SEGMENT, s, 2))
    log_z = np.zeros(s)
    for i in range(SEGMENT):
        a = e[0] if i == 0 else (alpha[i - 1] @ move) * e[i]
        size = a.sum(1, keepdims=True)
        alpha[i] = a / size
        log_z += np.where(inside[:, i], np.log(size[:, 0]), 0.0)
    for i in range(SEGMENT - 2, -1, -1):
        following = (e[i + 1] * beta[i + 1]) @ move.T
        following /= following.sum(1, keepdims=True)
        beta[i] = np.where(inside[:, i + 1][:, None], following, 1.0)
    p = alpha * beta
    p1 = (p[:, :, 1] / p.sum(2)).T * inside
    both = inside[:, 1:]
    pairs, expected = np.zeros((2, 2)), np.zeros((2, 2))
    weight = np.repeat(times[:, None], SEGMENT - 1, axis=1)[both]
    np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), weight)
    for i in range(1, SEGMENT):
        joint = alpha[i - 1][:, :, None] * move[None] * (e[i] * beta[i])[:, None, :]
        joint *= (times / joint.sum((1, 2)))[:, None, None]
        expected += joint[inside[:, i]].sum(0)
    value = float(((gold * inside * x).sum(1) - log_z) @ times + (pairs * t).sum())
    grad = np.empty_like(theta)
    grad[:k] = np.bincount(feat, weights=(gold[seg, place] - p1[seg, place]) * times[seg], minlength=k)
    grad[k] = (gold * inside - p1).sum(1) @ times
    grad[k + 1 :] = (pairs - expected).ravel()
    return value, grad


def likelihood(cut: DataFrame, theta: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """Penalised log-likelihood and gradient over a table of counted segments; each task sums its own and gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, grad = 0.0, np.zeros(n_features + 5)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = pa.record_batch([pa.concat_arrays([c]) for c in batch.slice(at, 4096).columns], names=batch.schema.names)
                toxic, n, places, feature, times = part.columns
                seg = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy())
                flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (places, feature)]
                v, g = segment_sums(theta, toxic.to_numpy(), n.to_numpy(), times.to_numpy().astype(float), seg, *flat)
                value, grad = value + v, grad + g
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([grad.tolist()])], names=["value", "grad"])

    found = cut.select("toxic", "n", "places", "feature", "times").mapInArrow(run, "value double, grad array<double>").collect()
    value = math.fsum(r["value"] for r in found) - PENALTY / 2 * float(theta @ theta)
    return value, np.sum([np.zeros(n_features + 5), *(r["grad"] for r in found)], axis=0) - PENALTY * theta


def climb(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, steps: int = 60, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """The top of a concave function that gives (value, gradient): limited-memory quasi-Newton steps, halved until they climb."""
    value, grad = objective(theta)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = grad.copy(), []
        for ds, dg in reversed(held):
            a = (ds @ d) / (ds @ dg)
            d -= a * dg
            used.append(a)
        d = d * ((held[-1][0] @ held[-1][1]) / (held[-1][1] @ held[-1][1])) if held else d / max(1.0, float(np.linalg.norm(d)))
        for (ds, dg), a in zip(held, reversed(used)):
            d += ds * (a - (dg @ d) / (ds @ dg))
        length, slope = 1.0, float(d @ grad)
        while length > 1e-6:
            after, turned = objective(theta + length * d)
            if after >= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            break
        moved, change = length * d, grad - turned
        if moved @ change > 1e-12:
            held = [*held[1 - memory :], (moved, change)]
        done = after - value <= tolerance * max(1.0, abs(value))
        theta, value, grad = theta + moved, after, turned
        if done:
            break
    return theta


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> list[float]:
    """Penalised logistic regression by Newton steps; the intercept is last."""
    design = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(design.shape[1])
    ridge = penalty * np.eye(len(theta))
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -40, 40)))
        grad = design.T @ (weight * (y - p)) - ridge @ theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(len(theta))
        step = np.linalg.solve(hessian, grad)
        theta = theta + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return theta.tolist()


def scores(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score, predicted, and the offending spans (start:end in code points, comma-joined)."""

    def rows(source):
        scorer = Scorer(field)
        for doc_id, out, text in source:
            low, places, marginals = scorer.read(text)
            score = field.score(evidence(marginals))
            spans = scorer.spans(text, low, places, marginals)
            yield doc_id, out, score, int(score >= THRESHOLD), len(spans), ",".join(f"{s}:{e}" for s, e in spans)

    return per_row(docs.select("doc_id", held_out().alias("held"), whole_text().alias("t")), "doc_id long, held_out boolean, score double, predicted int, n_spans long, spans string", rows, remembers=True)


def keep_clean(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    text_at = docs.columns.index("text")

    def rows(source):
        scorer = Scorer(field)
        for row in source:
            if field.score(evidence(scorer.read(row[text_at] or "")[2])) < threshold:
                yield row

    return per_row(docs, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), rows, remembers=True)
