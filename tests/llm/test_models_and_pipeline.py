import itertools
import math
import random
import re
import zlib
from collections import Counter

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import common, toxicity, urls


def labelled(spark, n=600, seed=5):
    """Documents of random words; toxic ones hold stems of two kinds."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(5, 80))]
        if toxic:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["blarg", "Quxorum", "quxoral", "quxoring", "BLARG!"]))
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, 1, int(toxic)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_marginals_equal_enumeration():
    r = random.Random(2)
    field = toxicity.Field({}, -1.1, np.array([[0.3, -0.9], [-0.4, 0.8]]), [])
    for _ in range(30):
        n = r.randint(1, 9)
        places = sorted(r.sample(range(n), r.randint(1, n)))
        emissions = [r.uniform(-2, 3) for _ in places]
        weight = dict(zip(places, emissions))
        total, on = 0.0, Counter()
        for tags in itertools.product((0, 1), repeat=n):
            x = sum(field.bias + weight.get(i, 0.0) for i in range(n) if tags[i]) + sum(field.transitions[a, b] for a, b in zip(tags, tags[1:]))
            total += math.exp(x)
            for i in places:
                on[i] += math.exp(x) * tags[i]
        got = field.marginals(places, emissions, n)
        assert np.allclose(got, [on[i] / total for i in places])


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    field = toxicity.fit(docs, labels)
    rows = toxicity.scores(docs, field).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r for r in rows if r.held_out]
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in out)
    assert right / len(out) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        for span in filter(None, r.spans.split(",")):
            s, e = map(int, span.split(":"))
            assert re.match("blarg|quxor", texts[r.doc_id][s:e].lower())
    kept = toxicity.keep_clean(docs, field)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.7}


@pytest.mark.parametrize("clean_in_ten", [5, 3])
def test_fitting_on_balanced_and_mostly_toxic_labels(spark, clean_in_ten):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 10 >= clean_in_ten
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(r.randint(5, 40))]
        if toxic or r.random() < 0.03:  # the word is in some clean documents as well
            w.insert(r.randrange(len(w)), "blarg")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = [x for x in toxicity.scores(docs, field).collect() if x.held_out]
    assert "=blarg" in field.weights
    assert sum(x.predicted == (x.doc_id % 10 >= clean_in_ten) for x in out) / len(out) > 0.9


def test_training_reads_no_held_out_label(spark):
    docs, labels = labelled(spark, 240)
    flipped = labels.withColumn("toxic", labels.toxic.cast("int"))
    flipped = flipped.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert one.weights == pytest.approx(two.weights) and one.calibration == pytest.approx(two.calibration)


def brute_likelihood(theta, k, segments):
    w, b, t = theta[:k], theta[k], theta[k + 1 :].reshape(2, 2)
    value = 0.0
    for toxic, n, entries, times in segments:
        x = [b + sum(w[f] for p, f in entries if p == i) for i in range(n)]
        gold = [int(toxic and any(p == i for p, _ in entries)) for i in range(n)]
        score = lambda tags: sum(x[i] * y for i, y in enumerate(tags)) + sum(t[a, c] for a, c in zip(tags, tags[1:]))  # noqa: E731, B023
        value += times * (score(gold) - math.log(sum(math.exp(score(tags)) for tags in itertools.product((0, 1), repeat=n))))
    return value


def test_likelihood_and_gradient_against_enumeration(spark):
    r, k = random.Random(3), 4
    segments = [(r.randrange(2), n := r.randint(1, 7), sorted((r.randrange(n), r.randrange(k)) for _ in range(r.randint(1, 5))), r.randint(1, 3)) for _ in range(12)]
    theta = np.array([r.uniform(-2, 2) for _ in range(k + 5)])
    rows = [(y, n, [p for p, _ in entries], [f for _, f in entries], times) for y, n, entries, times in segments]
    cut = spark.createDataFrame(rows, "toxic int, n int, places array<int>, feature array<int>, times long").repartition(3)
    value, grad = toxicity.likelihood(cut, theta, k)
    penalised = lambda at: brute_likelihood(at, k, segments) - toxicity.PENALTY / 2 * float(at @ at)
    assert np.isclose(value, penalised(theta))
    for i in range(k + 5):
        step = np.eye(k + 5)[i] * 1e-5
        assert np.isclose(grad[i], (penalised(theta + step) - penalised(theta - step)) / 2e-5, atol=1e-5)


def test_climbing_ends_at_the_top():
    r = np.random.default_rng(1)
    a = r.normal(size=(6, 6))
    a, top = a @ a.T + np.eye(6), r.normal(size=6)
    found = toxicity.climb(lambda x: (float(-(x - top) @ a @ (x - top)), -2 * a @ (x - top)), np.zeros(6), tolerance=1e-14)
    assert np.allclose(found, top, atol=1e-4)


def test_a_repeated_labelled_document_is_fitted_once(spark):
    docs, labels = labelled(spark, 240)
    again = docs.unionByName(docs.filter("doc_id IN (5, 6, 7)")).withColumn("toxic", F.lit(9)).withColumn("t", F.lit("x")).withColumn("score", F.lit(0.5))
    one, two = toxicity.fit(docs, labels), toxicity.fit(again, labels)
    assert one.weights == pytest.approx(two.weights) and one.calibration == pytest.approx(two.calibration) and one.key
    assert toxicity.scores(again, two).count() == 243


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 240)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for some in (none, labels.filter("toxic = 0"), spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")):
        assert {r.score for r in toxicity.scores(edge.docs(spark), toxicity.fit(edge.docs(spark), some)).collect()} == {0.0}
    field = toxicity.fit(docs, labels.union(labels))
    scores = {r.doc_id: r.score for r in toxicity.scores(edge.docs(spark), field).collect()}
    assert len(scores) == len(edge.texts()) and scores[0] == scores[1] < 0.7
    assert toxicity.scores(edge.empty(spark), field).count() == 0
    assert toxicity.scores(edge.odd_docs(spark), field).count() == 5


URLS = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/71?x#y", "https://a.com/en", "https://a.com/en/", "http://example.com/en/7", "http://badexample.com/en/7", "http://x.net/de/1", "http://m.example.net/de/89", "ftp://org/es/", "http://com/en/x://z/en/", "http://a.org:80/es/1", "http://a.com?/en/", "http://a.com#/en/", "http://é.com/en/ü", "x" * 20_000 + "://b.com/en/1", "http://a.com/en/\n?q"]


def by_hand(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, says in urls.RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "host") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.with_rules(pages).collect()}
    for i, u in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].ruled) == by_hand(u), u
    judged = {r.page_id: r for r in urls.judge(pages).collect()}
    assert all(r.verdict in ("allow", "block") for r in judged.values()) and judged[0].verdict == judged[1].verdict == "allow"
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_edges(spark):
    rows = [(1, "http://a.com/en/1"), (1, "http://a.com/en/1"), (None, "http://b.net/de/2"), (None, "http://c.io/" + "y" * 200_000), (4, "http://c.io/x")]
    schema = "page_id long, url string"
    plain = spark.createDataFrame(rows, schema)
    clashing = plain
    for c in ("rule", "ruled", "rest", "score", "verdict", "host", "path", "allowed", "held"):
        clashing = clashing.withColumn(c, F.lit("z"))
    order = lambda df: sorted(map(repr, df.collect()))
    got = urls.judge(clashing)
    assert order(got) == order(urls.judge(plain)) and got.count() == 5
    assert sum(x.page_id is None for x in got.collect()) == 2
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0


def symbols(url):
    return [0] * urls.ORDER + list(url.encode().lower())


def brute_probability(known, context, symbol):
    """Witten-Bell interpolation of one byte by counting in the texts (lists of symbols)."""
    p = None
    for k in range(urls.ORDER + 1):
        tail = context[len(context) - k :]
        after = Counter(s[i] for s in known for i in range(urls.ORDER, len(s)) if s[i - k : i] == tail)
        n, kinds = sum(after.values()), len(after)
        if p is None:
            p = (after[symbol] + 1) / (n + 256)
        elif n >= urls.MIN_CONTEXT:
            p = (after[symbol] + kinds * p) / (n + kinds)
    return p


@pytest.mark.parametrize("hot", [1, 40, 100_000])
def test_url_probabilities_and_verdicts_against_plain_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(urls, "HOT", hot)  # none, some and all grams go to the tasks
    monkeypatch.setattr(urls, "SLICE_BYTES", 100)
    r = random.Random(8)
    make = lambda letters, end: "http://" + "".join(r.choice(letters) for _ in range(6)) + end
    known = [(make("abc", ".net/de/1"), True) for _ in range(60)] + [(make("bcd", ".com/en/1"), False) for _ in range(60)]
    open_ = [make("abcd", ".io/q") for _ in range(10)] + ["http://\u00e9\u00fc.io/" + "abc" * 60, "Http://ABC.io/\0\0", "x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([u for u, _ in known] + open_)], "page_id long, url string")
    judged = {x.page_id: x for x in urls.judge(pages).collect()}
    sides = {y: [symbols(u) for u, a in known if a == y and zlib.crc32(u.encode()) % urls.FOLDS] for y in (True, False)}

    def score(u):
        s = symbols(u)
        logs = [math.log(brute_probability(sides[True], s[j - urls.ORDER : j], s[j]) / brute_probability(sides[False], s[j - urls.ORDER : j], s[j])) for j in range(urls.ORDER, len(s))]
        return sum(logs) / len(logs)

    held = Counter((math.floor(score(u) * urls.BINS_PER_UNIT), a) for u, a in known if not zlib.crc32(u.encode()) % urls.FOLDS)
    cut = urls.best_cut(dict(held))
    for i, u in enumerate(open_, len(known)):
        want = score(u)
        assert judged[i].score == pytest.approx(want, abs=1e-5)
        assert judged[i].verdict == ("allow" if want >= cut else "block") or abs(want - cut) < 1e-5


def test_url_counts_against_plain_counting(spark):
    r = random.Random(4)
    known = [("".join(r.choice("abC/.7\u00e9") for _ in range(r.randint(0, 12))), r.choice((-1, 0, 1))) for _ in range(300)]
    table = {x.gram: (x.a, x.b, x.n) for x in urls.counts(spark.createDataFrame(known, "url string, side int")).collect()}
    a, b, n = Counter(), Counter(), Counter()
    for u, side in known:
        s = [0] * urls.ORDER + list(u.encode().lower())
        for i in range(urls.ORDER, len(s)):
            code = int.from_bytes(bytes(s[i - urls.ORDER : i + 1]), "big", signed=True)
            a[code] += side == 1
            b[code] += side == 0
            n[code] += 1
    assert table == {code: (a[code], b[code], n[code]) for code in n}


def test_url_models_judge_held_out_urls(spark):
    r = random.Random(6)
    make = lambda good: "http://" + "".join(r.choice("aeiou" if good else "xqzkj") for _ in range(8)) + (".net/de/" if good else ".com/en/") + str(r.randrange(99))
    pages = [(i, make(i % 2 == 0)) for i in range(400)]
    pages += [(1000 + i, "http://" + "".join(r.choice("aeiou" if i % 2 == 0 else "xqzkj") for _ in range(8)) + ".io/aa") for i in range(100)]
    got = {x.page_id: x for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert sum((got[1000 + i].verdict == "allow") == (i % 2 == 0) for i in range(100)) >= 90


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    extra = [(1000 + i, t, "en", "s", 3) for i, t in enumerate(["same words in here", "same  words in here", "Same words in here", None, "", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more', "y" * 9000])]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = at.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.materialise(stage(spark, at, str(tmp_path)), name)
        assert at.columns == columns
        seen.append({r.doc_id for r in at.collect()})
    clean = {i for i in range(300) if i % 5}
    assert len(clean - seen[0]) <= 2 and len(seen[0] & {i for i in range(300) if i % 5 == 0}) <= 4
    assert 1001 in seen[1] and 1000 not in seen[1] and 1002 in seen[1] and 1003 in seen[1] and 1004 not in seen[1]
    assert 1001 in seen[2] and 1002 not in seen[2] and seen[3] == seen[2]
    texts = {r.doc_id: r.text for r in at.collect()}
    assert "24be64" not in texts[1005] and "and more" in texts[1005] and texts[1006] == "y" * 9000
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3]


def test_pipeline_keeps_rows_that_share_an_id_or_have_none(spark, tmp_path):
    docs, labels = labelled(spark, 300)
    r = random.Random(11)
    prose = lambda: " ".join("".join(r.choice("ijklmnopq") for _ in range(5)) for _ in range(50))
    texts = [prose() for _ in range(8)]
    odd = [(None, t, None, None, None) for t in texts[:4]] + [(7000, t, None, None, None) for t in texts[4:]] + [(None, texts[0], None, None, None), (7000, texts[4], None, None, None)]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for c in ("key", "kept", "row", "number", "block", "digest", "score", "toxic"):
        every = every.withColumn(c, F.lit(1))
    every.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = common.materialise(stage(spark, at, str(tmp_path)), name)
        assert at.columns == every.columns
        assert sorted(x.text for x in at.filter("doc_id IS NULL OR doc_id = 7000").collect()) == sorted(texts + ([texts[0], texts[4]] if name == "toxicity" else []))
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert sum(x.doc_id is None for x in packed) == 4 and sum(x.doc_id == 7000 for x in packed) == 4


def test_pipeline_of_an_empty_table(spark, tmp_path):
    edge.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


class Session:
    """A stand-in for a session with some settings."""

    def __init__(self, master, **settings):
        self.conf, self.sparkContext = settings, type("Context", (), {"master": master, "applicationId": "app-1"})


def test_shared_folder_is_read_from_the_session():
    assert common.shared_dir(Session("spark://x", **{"spark.checkpoint.dir": "hdfs://y/z/"})) == "hdfs://y/z"
    assert common.shared_dir(Session("local[2]")).startswith("file:///tmp/checkpoints/")
    with pytest.raises(ValueError):
        common.shared_dir(Session("local-cluster[2,1,512]"))


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"])
def test_registered(name):
    from bitloom.llm import queries

    assert sum(q.startswith(name) for q in queries.QUERIES) == 1
