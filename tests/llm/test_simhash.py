"""SimHash near-dedup against all pairs: fingerprints, bit-sliced distances, links of full buckets, components."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oculith.llm import simhash
from oculith.llm.shared import looked_up

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def within_four(a, b):
    return (a ^ b).bit_count() <= 4


def brute_components(prints, near=within_four):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(prints[a], prints[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_simhash_against_all_pairs(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]
    base = rows[11][1]
    rows += [(1000 + i, base + f" tail{i}") for i in range(60)] + [(2000, ""), (2001, None)]
    got = {r["doc_id"]: r for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {d: brute_fingerprint(t) for d, t in rows}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == prints
    assert {d: r["component_id"] for d, r in got.items()} == brute_components(prints)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    values[::7] = values[0] ^ (np.uint64(1) << rng.integers(0, 63, len(values[::7]), dtype=np.uint64))
    for radius in (0, 3, 4, 7):
        want = np.bitwise_count(values ^ values[0]) <= radius
        assert (simhash.within(simhash.planes(values), len(values), radius, int(values[0])) == want).all()


def test_links_of_a_large_bucket_connect_as_all_pairs_do(spark):
    rng = np.random.default_rng(2)
    fps, at = [], 12345
    for _ in range(300):  # chains and clusters that share most bits
        at ^= 1 << int(rng.integers(0, 24)) | 1 << int(rng.integers(0, 24))
        fps.append(at)
    fps = sorted(set(fps))
    want = brute_components({x: x for x in fps})
    for most in (4096, 20):  # whole buckets; pairs of parts
        links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), most=most)
        roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
        assert {x: roots.get(x, x) for x in fps} == want


def test_forest_stores_planes_anew_without_losing_links():
    rng = np.random.default_rng(4)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 900, dtype=np.uint64)) for base in rng.integers(0, 1 << 63, 5, dtype=np.uint64)] + [rng.integers(0, 1 << 63, 700, dtype=np.uint64)]))
    rng.shuffle(values)
    root = list(range(len(values)))
    for a, b in simhash.forest(values, 4):
        assert (int(values[a]) ^ int(values[b])).bit_count() <= 4
        root = [root[a] if r == root[b] else r for r in root]
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    reach = np.arange(len(values))
    while True:
        now = np.where(near, reach[None, :], len(values)).min(axis=1)
        if (now == reach).all():
            break
        reach = now
    assert len(set(root)) == len(set(reach.tolist()))


def test_hot_keys_are_looked_up_like_others(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(900)], "k int, x int")
    right = left.groupBy("k").agg(F.count("x").alias("n"), F.max("x").alias("y"))
    assert sorted(map(tuple, looked_up(left, right, "k", 900, most=200).select("k", "x").collect())) == sorted(map(tuple, left.collect()))
