"""The pipeline's near copies against brute-force Jaccard similarity."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from oculith.llm import near

SCHEMA = "doc_id long, text string"


def brute_shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(rows, threshold=0.8):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [brute_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= threshold * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sorted((rows[i] for i in {find(i) for i in range(len(rows))}), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def edited_copies(seed=3):
    rng, rows = random.Random(seed), []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        rows += [" ".join(base), edited(rng, base, len(base) // 60), edited(rng, base, len(base) // 40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_stage_catches_edited_copies(spark):
    rows = edited_copies()
    want = brute_kept(rows)
    assert len(want) < 100
    got = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_parts_of_a_hot_key_meet(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(rng, base, 3)) for i in range(60)] + edited_copies(5)[:20]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = near.keep_one(spark.createDataFrame(rows, SCHEMA), most=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute_kept(rows)


def test_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (None, text), (3, text.upper()), (3, text), (1, "alone"), (1, "other"), (None, "last"), (None, ""), (4, None), (4, None)]
    got = sorted((r["doc_id"], (r["text"] or "").lower()) for r in near.keep_one(spark.createDataFrame(rows, SCHEMA)).collect() if r["doc_id"] is not None)
    assert got == [(1, "alone"), (1, "other"), (3, text), (4, "")]
    assert near.keep_one(spark.createDataFrame(rows, SCHEMA)).filter("doc_id is null").count() == 1


def test_fingerprints_lose_no_pair_at_the_threshold():
    """Pairs at Jaccard similarity 0.8 or more, of 20 to 2,000 words, are near by fingerprints or too short for them."""
    rng, missed, apart = random.Random(6), 0, 0
    for k in range(600):
        n = rng.choice([20, 60, 100, 300, 1000, 2000])
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        other = edited(rng, base, max(1, n // 55)).split() if k % 2 else base[: int(n * 0.85)]
        far = [f"v{rng.randrange(10**6)}" for _ in range(n)] if n > 80 else base
        a, b, c = (near.shingles(" ".join(x).encode()) for x in (base, other, far))
        same = len(np.intersect1d(a, b))
        prints = np.stack([np.frombuffer(near.sketch(x), np.uint64) for x in (a, b, c)])
        if same >= 0.8 * (len(a) + len(b) - same):
            missed += not near.partnered(prints[:2], np.array([len(a), len(b)])).all()
        if n > 80:
            apart += near.partnered(prints[[0, 2]], np.array([len(a), len(c)])).any()
    assert missed == 0 and apart == 0


def test_simhash_links_alone_propose_copies(spark):
    """Without min-hashes, what fingerprints within four bits connect is still compared and linked."""
    rng = random.Random(11)
    rows = []
    for k in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-1] + ["other"]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = near.with_simhash_keys(near.signatures(docs).withColumn("keys", F.array().cast("array<long>")))
    pairs = {tuple(sorted((near.node_of(a.encode()), near.node_of(b.encode())))) for (_, a), (_, b) in zip(rows[::2], rows[1::2])}
    assert {(r["v"], r["u"]) for r in near.near_links(docs, found).collect()} == pairs
