import hashlib
import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from hyperloom.llm import components, dedup, mixing, simhash
from hyperloom.llm.shared import lookup

from .common import SCHEMA, awkward, empty


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_classes(spark):
    df = awkward(spark)
    got = dedup.DigestIndex(spark, buckets=3).deduplicate(df).collect()
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t), i is None, i))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    for key, members in groups.items():
        found = by[hashlib.sha256(key.encode()).hexdigest()]
        assert len(found) == len(members) and {r.group_size for r in found} == {len(members)}
        assert {r.keep_id for r in found} == {min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]} and sum(r.kept for r in found) == 1
    assert dedup.DigestIndex(spark).deduplicate(empty(spark)).count() == 0


def test_index_without_a_name_goes_with_its_object(spark):
    index = dedup.DigestIndex(spark)
    name, docs = index.name, awkward(spark)
    found = index.deduplicate(docs)
    assert spark.catalog.tableExists(name)
    del index
    assert not spark.catalog.tableExists(name) and found.count() == docs.count()


def test_index_persists_over_batches(spark):
    a = spark.createDataFrame([(5, "one", None, None, 0), (6, "two", None, None, 0)], SCHEMA)
    b = spark.createDataFrame([(1, "o n e", None, None, 0), (2, "three", None, None, 0)], SCHEMA)
    index = dedup.DigestIndex(spark, "persistent_index_test", buckets=2)
    index.deduplicate(a).count()
    got = {r.doc_id: (r.keep_id, r.kept) for r in dedup.DigestIndex(spark, "persistent_index_test").deduplicate(b).collect()}
    assert got == {1: (5, False), 2: (2, True)}
    assert index.read().count() == 3
    plan = index.read().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE persistent_index_test")


def test_index_is_compacted_and_rerun(spark):
    """A batch run again after its digests were appended gets the same answer; a compact index lies sorted, one file a bucket."""
    name = "compact_index_test"
    rows = [(i, f"text {i % 40} of a batch", None, None, 0) for i in range(100)]
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(500 + i, f"text {i} of a batch", None, None, 0) for i in range(60)], SCHEMA)
    try:
        index = dedup.DigestIndex(spark, name, buckets=3)
        first = sorted(tuple(r)[:5] for r in index.deduplicate(a, batch=1).collect())
        again = sorted(tuple(r)[:5] for r in dedup.DigestIndex(spark, name).deduplicate(a, batch=1).collect())
        assert first == again and sum(r[3] for r in first) == 40
        assert sum(r.kept for r in index.deduplicate(b, batch=2).collect()) == 20 and index.read().count() == 60
        index.compact(buckets=4)
        index = dedup.DigestIndex(spark, name)
        assert index.buckets == 4 and len(index.read().inputFiles()) <= 4 and index.read().count() == 60
        some = spark.createDataFrame([(bytearray(b"x"),)], "digest binary")
        plan = some.join(index.read().hint("merge"), "digest")._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index(name) - 400 :] if name in plan else plan
        assert plan.count("Sort [") == 1 and "SortMergeJoin" in plan, side
        assert not [r for r in index.deduplicate(b, batch=3).collect() if r.kept]
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_compact")  # as a compaction leaves it that was cut off
        assert dedup.DigestIndex(spark, name).read().count() == 60
    finally:
        for t in (name, f"{name}_compact"):
            spark.sql(f"DROP TABLE IF EXISTS {t} PURGE")


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints(spark):
    got = {r.doc_id: r.fp for r in simhash.fingerprints(awkward(spark)).collect() if r.doc_id}
    want = {r.doc_id: fingerprint(r.text) for r in awkward(spark).collect() if r.doc_id}
    assert {k: v & (1 << 64) - 1 for k, v in got.items()} == want


def test_golay_anchors_meet():
    rng = np.random.default_rng(0)
    anchors = simhash.GolayAnchors()
    x = rng.integers(-(1 << 63), 1 << 63, 300, dtype="i8")
    for flips in (0, 1, 2):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, flips, replace=False):
                y[i] ^= np.int64(np.uint64(1 << int(b)).view("i8"))
        home, near = anchors.home(x), [set() for _ in y]
        for i, a in zip(range(len(y)), anchors.home(y)):
            near[i].add(int(a))
        for i, a in anchors.near(y):
            for j, v in zip(i.tolist(), a.tolist()):
                near[j].add(v)
        assert all(int(h) in n for h, n in zip(home, near))


@pytest.mark.parametrize("homes", [4096, 8])
def test_links_equal_brute_force(spark, homes):
    random.seed(homes)
    base = [random.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for _ in range(600):
        x = random.choice(sorted(fps)[:200])
        for b in random.sample(range(64), random.randint(1, 3)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")
    labels = {r.node: r.component for r in components.components(simhash.links(df, homes)).collect()}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert all(labels.get(i, i) == find(i) for i in range(len(fps)))


def test_near_duplicates_of_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == 14
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[6] == by[7] == by[12] == 1 and by[2] == by[3] == by[4] == 2 and by[None] is None
    assert simhash.near_duplicates(empty(spark)).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def trees(n, links):
    """The smallest node of each node's tree."""
    parent = {i: i for i in n}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


@pytest.mark.parametrize("homes, rounds", [(4096, 2), (8, 2), (8, 0), (4096, 0)])
def test_similar_joins_all_that_are_similar(spark, homes, rounds):
    """Large families, texts of 0.8 and just below, the same words in another order, few and many words; whatever the
    rounds, and where places are split, the groups are those of brute force."""
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (12, 60, 104, 400, 1600):
        for family in range(4):
            base = random.choices(vocabulary, k=n)
            texts.append(base)
            for c in range(12 if family == 0 else 3):
                words = list(base)
                for i in range(max(1, n // 55) + (c > 5)):
                    words[min(n - 1, i * 55 + random.randrange(20))] = random.choice(vocabulary)
                texts.append(random.sample(words, n) if c == 2 and n > 60 else words)
    texts += [["one", "two"], ["ONE", "two"], [], ["x"]]
    rows = [(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)] + [(None, " ".join(texts[0]), None, None, 0), (len(texts), None, None, None, 0)]
    df = spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA)
    sets = [shingles(" ".join(t)) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = trees(range(len(texts) + 1), links)
    groups = df.where("doc_id IS NOT NULL").selectExpr("doc_id", "doc_id AS component_id")
    got = {r.node: r.component for r in simhash.similar(df, groups, homes=homes, rounds=rounds).collect()}
    assert {i: got.get(i, i) for i in want} == want and len(got) > 50
    assert simhash.similar(empty(spark), empty(spark).selectExpr("doc_id", "doc_id AS component_id")).count() == 0


def test_similar_joins_groups(spark):
    """Groups that are given count as joined, and only what joins others is told."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(3, base, None, None, 0), (5, base.replace("w50", "x"), None, None, 0), (7, "one two three four five six", None, None, 0), (9, "other words", None, None, 0)]
    groups = spark.createDataFrame([(3, 3), (5, 5), (7, 5), (9, 9)], "doc_id long, component_id long")
    assert [tuple(r) for r in simhash.similar(spark.createDataFrame(rows, SCHEMA), groups).collect()] == [(5, 3)]


def test_a_large_family_makes_few_pairs(spark):
    """What the rounds emit is at most one row a text, and what is left to compare afterwards is little."""
    random.seed(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in random.sample(range(150), 2):
            words[at] = f"v{random.randrange(10_000)}"
        rows.append((i, " ".join(words), None, None, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    labelled = simhash.shared_places(df).withColumn("comp", simhash.F.col("doc_id"))
    met = simhash.first_met(labelled, 0, 0.8)
    assert met.count() <= 400 and met.groupBy("doc_id").count().where("count > 1").isEmpty()
    got = simhash.similar(df, df.selectExpr("doc_id", "doc_id AS component_id")).collect()
    sets = [shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(400) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert {i: {r.node: r.component for r in got}.get(i, i) for i in range(400)} == trees(range(400), links)


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(12)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 180), (60, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {i: 0 for i in range(1, 13)} | {101: 100, 200: 150, 180: 150}
    hub = spark.createDataFrame([(0, i) for i in range(1, 200)], "a long, b long")
    assert components.components(hub, few).count() == 199 and components.components(hub.limit(0), few).count() == 0


def test_lookup_splits_hot_keys(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id < 600 THEN 0 ELSE id END AS k", "id")
    keys = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS v")
    got = lookup(rows, keys, "k", "n", 1000)
    assert got.count() == 1000 and got.where("v = 2 * k").count() == 1000


def test_mixing(spark):
    random.seed(1)
    rows = [(i, "w " * random.randint(0, 40), None, random.choice(["b", "a", "z", "é", None]), 0) for i in range(500)] + [(i, "one two", None, "tiny", 0) for i in range(500, 503)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, weights = {}, {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (3, 1, 2)[i % 3]
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weights[s] for s in sizes if s not in full)
        new = {s for s in sizes if s not in full and weights[s] * level >= 2 * sizes[s]}
        if not new:
            break
        full |= new
    taken = {}
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(min(weights[r.source] * level, 2 * sizes[r.source]))
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - min(weights[s] * level, 2 * sizes[s])) <= 1 for s in sizes) and "tiny" in full


def test_mixing_awkward_rows(spark):
    df = awkward(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, "a", 0)], SCHEMA)).first().taken == 0
