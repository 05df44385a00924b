import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectionmill.llm import components as C
from sectionmill.llm import dartminhash as D

SCHEMA = "doc_id long, text string, source string, words string, class_id long"


def shingles(text, size=5):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if (a and b and len(a & b) >= 0.8 * len(a | b)) or (not a and not b and dict(rows)[i] is not None and dict(rows)[i] == dict(rows)[j]):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: find(i) for i, _ in rows}


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = base[:]
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
            i += 1
    for _ in range(60):  # one large group around a common text
        words = [f"hot{j}" for j in range(100)]
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
        i += 1
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, None, "x", 5) for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    together = [(i, j) for i in want for j in want if i < j and want[i] == want[j]]
    assert sum(got[i] == got[j] for i, j in together) >= 0.98 * len(together)
    assert all(want[i] == want[j] for i in got for j in got if i < j and got[i] == got[j])


def test_repeated_texts_are_found(spark):
    rng = random.Random(8)
    bases = [[f"t{k}w{rng.randrange(5000)}" for _ in range(150)] for k in range(40)]
    rows = [(3 * k + m - 1, " ".join(base * m)) for k, base in enumerate(bases) for m in (1, 2, 3)]
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and len(set(got.values())) == 40


def test_all_pairs_of_a_bucket_are_compared(spark):
    rng = random.Random(5)
    rows = []
    for k in range(30):  # a chain: each text is near the next only, the first leads the bucket
        words = [f"c{k}w{i}" for i in range(100)]
        for step in range(4):
            rows.append((len(rows), " ".join(words)))
            for i in range(10 * step, 10 * step + 10):
                words[(i + 90) % 100] = f"c{k}s{step}w{rng.randrange(10**6)}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(df, bands=2, rows=1).collect()}
    words = df.select("doc_id", D.word_hashes(D.normal_words(df.text)).alias("w")).orderBy("doc_id").collect()
    r, x, _ = D.weighted_shingles(np.array([h for row in words for h in row.w], np.int64).view(np.uint64), np.array([len(row.w) for row in words]))
    bands = D.band_hashes(D.throw(r, x, np.ones(len(r)), len(rows), 2), 2, 1)
    sets, want, old = [shingles(t) for _, t in rows], list(range(len(rows))), None
    while old != want:
        old = want[:]
        for i in range(len(rows)):
            for j in range(i - i % 4, i):
                if (bands[i] == bands[j]).any() and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want))


def test_edges(spark):
    rows = [(1, "Alpha beta."), (2, "alpha  BETA"), (3, None), (4, None), (5, ""), (6, ""), (7, "!!"), (8, "??"), (9, "!!"), (None, "alpha beta"), (11, "alpha beta gamma"), (2, "alpha  BETA"), (None, "of none"), (2, "its own text"), (12, None), (12, "x y"), (12, "x y")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in D.near_duplicates(df).collect())
    want = [(1, 1, True), (2, 1, False), (2, 1, False), (None, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 7, True), (9, 7, False), (8, 8, True), (11, 11, True), (None, None, True), (2, 2, True), (12, 12, True), (12, 12, True), (12, 12, False)]
    assert got == Counter(want)
    left = D.deduplicated(df.withColumn("row", F.lit("own")))
    assert left.columns == [*df.columns, "row"] and Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _, kept in want if kept)
    named = D.near_duplicates(spark.createDataFrame([("b", "x y"), ("a", "X y!")], "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["class_id"], r["kept"]) for r in named} == {("a", "a", True), ("b", "a", False)}
    assert D.near_duplicates(df.limit(0)).count() == 0
    long = " ".join(f"x{i % 977}y{i % 31}" for i in range(60_000))
    two = spark.createDataFrame([(1, long), (2, long + " tail of it")], "doc_id long, text string")
    assert {r["class_id"] for r in D.near_duplicates(two).collect()} == {1}


def test_sketches_agree_as_the_weighted_similarity():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    sketch = D.throw(np.repeat([0, 2], 300), np.concatenate([items, items]), np.concatenate([a, b]), 3, 3000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sketch[0] == sketch[2]).mean() - want) < 0.04 and not sketch[1].any()
    alone = D.throw(np.zeros(300, int), items, a, 1, 3000)
    assert (alone[0] == sketch[0]).all()


def test_bitmaps_bound_the_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8, 0.95, 1.0):
        n = 3000 if share == 0.8 else 200
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: n - int(n * share)] = rng.integers(0, 2**63, n - int(n * share)).astype(np.uint64)
        x, y = D.bitmaps(np.repeat([0, 1], n), np.concatenate([a, b]), 2)
        both = min(n - np.bitwise_count(x & ~y).sum(), n - np.bitwise_count(y & ~x).sum())
        assert both / (2 * n - both) >= len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))


def test_drifting_families_stay_whole(spark):
    """Links between members that lead no bucket: each text is near the next few only."""
    rng = random.Random(4)
    rows, vocabulary = [], [f"v{i}" for i in range(3000)]
    for _ in range(3):
        words = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(60):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rng.choice([1, 1, 1, 2])):
                words[rng.randrange(120)] = rng.choice(vocabulary)
    got = {r["doc_id"]: r["class_id"] for r in D.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(30)]
    star = [(100, i) for i in range(101, 140)]
    extra = [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(30)]
    edges = chain + star + extra + extra[:5] + [(7, 7)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
