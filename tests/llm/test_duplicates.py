import hashlib
import random
import re

import edge
import xxhash

from bitloom.llm import common, dedup, simhash


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(spark):
    values = edge.texts()
    got = {r.doc_id: r for r in dedup.exact_dedup(edge.docs(spark)).collect()}
    groups = {}
    for i, t in enumerate(values):
        groups.setdefault(normal(t), []).append(i)
    for key, members in groups.items():
        keep = min(members, key=lambda i: (-len(values[i] or ""), i))
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(members), i == keep)
            assert got[i].text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert dedup.exact_dedup(edge.empty(spark)).count() == 0
    odd = dedup.exact_dedup(edge.odd_docs(spark)).collect()
    assert len(odd) == 5 and {r.keep_id for r in odd if r.text_sha256 == hashlib.sha256(b"sametext").hexdigest()} == {7}


def test_index_keeps_earlier_batches_and_may_be_fed_again(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = dedup.DigestIndex(spark, path, 4)
    first = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "a  b "), (4, "d"), (5, "d")], "doc_id long, text string")
    once = sorted(map(tuple, index.ingest(first).collect()))
    assert [r[:4] for r in once] == [(1, 1, 1, True), (2, 2, 1, True)]
    want = [(3, 1, 1, False), (4, 4, 2, True), (5, 4, 2, False)]
    assert [r[:4] for r in sorted(map(tuple, index.ingest(second).collect()))] == want
    again = dedup.DigestIndex(spark, path)  # as another session would open it
    assert [r[:4] for r in sorted(map(tuple, again.ingest(second).collect()))] == want
    assert again.table().count() == 3 and again.version() == (1, 4)
    assert sorted(map(tuple, index.ingest(first).collect())) == once
    index.drop()
    assert index.version() is None


def test_batches_and_compaction_against_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "MAX_FILES", 2)
    r = random.Random(5)
    rows = [(i, r.choice("abcdefgh") * r.randint(1, 9)) for i in range(240)]
    index = dedup.DigestIndex(spark, f"file://{tmp_path}/index", 3)
    seen, versions = {}, []
    for k in range(4):
        batch = rows[60 * k : 60 * (k + 1)]
        got = {x.doc_id: x for x in index.ingest(spark.createDataFrame(batch, "doc_id long, text string")).collect()}
        for i, t in batch:
            seen.setdefault(t, min(j for j, u in batch if u == t))
        for i, t in batch:
            assert (got[i].keep_id, got[i].kept, got[i].group_size) == (seen[t], seen[t] == i, sum(u == t for _, u in batch))
        versions.append((index.version(), index.files()))
    assert versions[-1][0][0] > 1 and all(n <= 2 * v[1] for v, n in versions)
    held = {bytes(x.digest): x.keep_id for x in index.table().collect()}
    assert held == {hashlib.sha256(t.encode()).digest(): i for t, i in seen.items()}
    index.close()
    # Digests are in order within each file of a compacted version.
    for part in (tmp_path / "index").glob("v*/*.parquet"):
        found = [bytes(x.digest) for x in spark.read.parquet(f"file://{part}").collect()]
        assert found == sorted(found)


def test_joins_are_as_wide_as_the_session(spark):
    values = [(i, str(i % 50)) for i in range(400)]
    index = dedup.DigestIndex(spark, f"{common.shared_dir(spark)}/bitloom/test-index")
    decided = index.ingest(spark.createDataFrame(values, "doc_id long, text string"))
    assert index.version() == (1, 4)
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" in plan and ", 16)" not in plan and "SortMergeJoin" in plan
    index.drop()


def fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    root = dict.fromkeys(prints)
    for i in prints:
        root[i] = i
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = list(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(spark):
    values = edge.texts(n=120)
    base = "the quick brown fox jumps over the lazy dog while many other words follow in a long sentence " * 4
    r = random.Random(2)
    for _ in range(30):
        w = base.split()
        w[r.randrange(len(w))] = r.choice("abcdef")
        values.append(" ".join(w))
    prints = {i: fingerprint(t) for i, t in enumerate(values)}
    want = classes(prints)
    for bound in (simhash.MAX_BUCKET, 2):
        got = {x.doc_id: x for x in simhash.near_duplicates(edge.docs(spark, values), max_bucket=bound).collect()}
        assert {i: x.fingerprint for i, x in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
        assert {i: x.component_id for i, x in got.items()} == want
    assert simhash.near_duplicates(edge.empty(spark)).count() == 0
    assert simhash.near_duplicates(edge.odd_docs(spark)).count() == 5


def test_links_between_close_fingerprints(spark):
    r = random.Random(9)
    centre = r.getrandbits(64)
    prints = {0: centre}
    for i in range(1, 120):
        bits = r.sample(range(64), r.randint(1, 4))
        prints[i] = centre
        for b in bits:
            prints[i] ^= 1 << b
    seen, nodes = set(), []
    for i, p in prints.items():
        if p not in seen:
            seen.add(p)
            nodes.append((i, p - (1 << 64) if p >> 63 else p))
    alone = {i: prints[i] for i, _ in nodes}
    df = common.materialise(spark.createDataFrame(nodes, "node long, fp long"), "test")
    found = simhash.links(df).collect()
    pairs = {(min(x.u, x.v), max(x.u, x.v)) for x in found}
    assert len(pairs) == len(found)
    assert pairs == {(a, b) for a in alone for b in alone if a < b and (alone[a] ^ alone[b]).bit_count() <= 2}
    want = {i: c for i, c in classes(alone).items()}
    for bound in (128, 3):
        got = {x.node: x.component for x in simhash.components(simhash.links(df, bound)).collect()}
        assert {i: got.get(i, i) for i in alone} == want


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(5, 5)]
    got = {x.node: x.component for x in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 180))


def test_rounds_write_as_many_files_as_their_edges_need(spark, monkeypatch):
    files, write = [], simhash.materialise

    def counted(df, label, *rows):
        out = write(df, label, *rows)
        if label in ("large-star", "small-star"):
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)], "u long, v long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x.node: x.component for x in simhash.components(edges).collect()}
        assert files and max(files) == 1
        # More rows than a file is made for.
        monkeypatch.setattr(common, "ROWS_PER_FILE", 20)
        files.clear()
        assert {x.node: x.component for x in simhash.components(edges).collect()} == got
        assert 1 < max(files) <= 14  # of 2 * 139 edges at most
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 180))


def test_a_task_counts_the_variants_of_a_bounded_number_of_fingerprints(spark, monkeypatch):
    r = random.Random(4)
    prints = {r.getrandbits(63) for _ in range(100)}
    prints |= {p ^ 1 << r.randrange(63) for p in list(prints)[:40]}
    nodes = common.materialise(spark.createDataFrame(list(enumerate(prints)), "node long, fp long").coalesce(1), "test")
    pairs = lambda: sorted((x.u, x.v) for x in simhash.links(nodes).collect())
    want = pairs()
    assert len(want) >= 40
    monkeypatch.setattr(simhash, "NODES_PER_TASK", 10)
    dealt = simhash._dealt(nodes)
    assert dealt.rdd.getNumPartitions() == -(-len(prints) // 10) and dealt.count() == len(prints)
    assert pairs() == want


def test_keep_ids(spark):
    docs = edge.odd_docs(spark)
    flags = spark.createDataFrame([(7, True), (7, True), (None, False), (3, True), (None, True)], "doc_id long, kept boolean")
    kept = common.keep_ids(docs, flags)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (True, 0)]


def test_keep_ids_groups_the_decisions_once(spark, monkeypatch):
    tables, write = [], common.materialise

    def counted(df, label, *rows):
        tables.append(write(df, label, *rows))
        return tables[-1]

    monkeypatch.setattr(common, "materialise", counted)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e"), (None, "f")], "doc_id long, text string")
    flags = spark.createDataFrame([(1, True, "a"), (2, False, "b"), (3, True, "c"), (3, False, "d"), (4, None, "e"), (None, False, "f")], "doc_id long, kept boolean, key string")
    kept = common.keep_ids(docs, flags, docs["text"])
    # An undecided id is not dropped by the anti-join, as before.
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (3, "c"), (4, "e")]
    assert len(tables) == 1


def test_keep_ids_with_clashing_columns(spark):
    docs = edge.docs(spark)
    n = docs.count()
    flags = spark.createDataFrame([(i, i % 4 != 0) for i in range(n)] + [(1, True)], "doc_id long, kept boolean")
    kept = common.keep_ids(docs.unionByName(docs.filter("doc_id = 1")), flags)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(n) if i % 4]


def test_stages_keep_rows_that_share_an_id_or_have_none(spark):
    import corpus_pipeline

    r = random.Random(7)
    a, b, c, d = (" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(999)) for _ in range(60)) for _ in range(4))
    schema = "doc_id long, text string, key long, row long, id long"
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in [(7, a), (7, b), (3, a), (None, c), (None, c + " "), (None, d), (None, d), (9, "other words here")]], schema)
    kept = corpus_pipeline.exact_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(3, a), (7, b), (9, "other words here"), (None, c + " "), (None, d)]
    order = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert order((x.doc_id, x.text) for x in kept.collect()) == order(want)
    # By fingerprint: a and b are two components although both have id 7; documents without id are told apart.
    once = corpus_pipeline.simhash_stage(spark, docs, "")
    assert once.columns == docs.columns and order((x.doc_id, x.text) for x in once.collect()) == order(want)
    near = spark.createDataFrame([(7, a), (7, b), (3, a), (None, c), (None, d), (9, b), (None, b), (5, d)], "doc_id long, text string")
    left = order((x.doc_id, x.text) for x in corpus_pipeline.simhash_stage(spark, near, "").collect())
    assert left == order([(3, a), (7, b), (5, d), (None, c)])
