"""Neighbours, collocations and ranked search against brute force, and on awkward tables."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from oculith.llm import collocation, lexical, neighbours
from oculith.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n long, rank string"
LONG = "long cat " * 30_000
ROWS = [(1, "The cat. The cat sat; the CAT", "en"), (1, "The cat. The cat sat; the CAT", "en"), (2, None, None), (None, "no id, the cat", None), (3, "", "en"), (4, " \t.\n;", "en"), (5, LONG, "en"), (6, "Éa b\tc\x0bd e-f 12", "fr"), (7, "the cat " * 12, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 3, "x") for r in ROWS], DOCS).repartition(3)


@pytest.mark.parametrize("name", ["op12_collocations", "op13_lexical"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def phrases(rows, support, covered=50):
    """Collocations counted plainly."""
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    f = {k: v for k, v in f.items() if v >= support}
    out = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or any(len(q) > len(p) and other == lang and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= covered * a for (other, q), b in f.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


@pytest.mark.parametrize("sample", [1, 1 << 25])
def test_phrases_equal_plain_counts_whatever_the_sample(docs, sample):
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocation.collocations(docs, support=2, sample_bytes=sample).collect()}
    assert got == phrases(ROWS, 2) and ("en", "cat long cat") in got


def test_phrases_of_many_chunks_and_failures_of_the_border(spark, monkeypatch):
    random = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in random.zipf(1.6, 40) % 50), "en") for i in range(300)]
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], DOCS).repartition(4)
    monkeypatch.setattr(collocation, "CHUNK", 2_000)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocation.collocations(docs, support=4, sample_bytes=2_000).collect()}
    assert got == phrases(rows, 4)


def test_counts_beyond_64_bits(spark):
    a = 4_000_000_000
    assert collocation.collocations(spark.createDataFrame([], DOCS)).count() == 0
    row = spark.createDataFrame([(a,)], "a long").selectExpr("cast(cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(31,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div cast(cast(a as decimal(16,0)) * cast(a + 1 as decimal(16,0)) as decimal(38,0)) as s").first()
    assert row["s"] == 10**6 * a * a // (a * (a + 1))


def ranking(rows, items, best):
    """Ranked search done plainly."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    said = [(i, Counter(split(t))) for i, t, *_ in rows if split(t)]
    total, length = len(said), sum(sum(c.values()) for _, c in said)
    df = Counter(t for _, c in said for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in said:
            m = 75 + 25 * sum(c.values()) * total // length
            score = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in Counter(split(text)).items() if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=str)


def test_ranked_search_equals_plain_scores(spark, docs, monkeypatch):
    items = [(1, "the cat the"), (2, ""), (3, None), (4, "Éa zebra 12"), (5, "no id cat"), (1, "the cat the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = ranking(ROWS, [items[0], *items[3:5]], 20)
    assert sorted([tuple(r) for r in lexical.search(docs, table).collect()], key=str) == want
    monkeypatch.setattr(lexical, "ITEM_BYTES", 8)  # many passes, small trees
    monkeypatch.setattr(lexical, "DOCUMENTS", 2)
    assert sorted([tuple(r) for r in lexical.search(docs, table).collect()], key=str) == want
    assert lexical.search(docs.limit(0), table).count() == lexical.search(docs, table.limit(0)).count() == 0


def test_ball_tree_finds_the_best_and_prunes():
    random = np.random.default_rng(5)
    n, width = 3_000, 300
    sizes = random.integers(1, 12, n)
    columns = np.concatenate([random.choice(width, k, replace=False, p=(p := 1 / np.arange(1, width + 1)) / p.sum()) for k in sizes])
    rows = lexical.Rows(np.concatenate([[0], np.cumsum(sizes)]), columns, random.integers(1, 10**9, sizes.sum()))
    tree, opened = lexical.BallTree(rows, width, 16), 0
    for _ in range(50):
        item = np.zeros(width, np.int64)
        item[random.choice(width, 5)] = random.integers(1, 4, 5)
        best = lexical.Best(7)
        best.ids = list(range(n))
        opened += tree.search(item, best)
        scores = rows.dot(item)
        assert [(r, i) for r, _, i in sorted(best.rows)] == sorted((-s, i) for i, s in enumerate(scores) if s > 0)[:7]
    assert opened < 50 * sum(c is None for c in tree.children)


def nearest(ids, x, every, best=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        cos = u @ u[k]
        cos[ids == ids[k]] = -9
        out[ids[k]] = [(int(ids[j]), cos[j]) for j in np.lexsort((ids, -cos.round(12)))[:best] if cos[j] > -9]
    return out


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_neighbours_recall(spark, kind):
    random = np.random.default_rng(2)
    x = random.normal(size=(4_000, 24)) + (0 if kind == "noise" else 4 * random.normal(size=(40, 24))[random.integers(0, 40, 4_000)])
    ids = random.permutation(4_000)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    got, want = neighbours.search(table, every=20, leaf=32, cell=256).collect(), nearest(ids, x, 20)
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    hits = sum((q, v) in found and abs(found[q, v] - c) < 1e-12 for q, own in want.items() for v, c in own)
    assert hits >= 0.93 * sum(map(len, want.values())) and len(got) == 5 * len(want)


def test_neighbours_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [1e-300, 1e-300]), (9, [-1.0, 0.0]), (50, []), (100, [0.0, 3.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.search(table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, round(math.sqrt(0.5), 9)), (0, 3, 100, 0.0), (0, 4, 9, -1.0), (100, 1, 8, round(math.sqrt(0.5), 9)), (100, 2, 0, 0.0), (100, 3, 1, 0.0), (100, 4, 9, 0.0)]
    assert neighbours.search(table.limit(0)).count() == 0


def test_neighbours_among_copies_and_ids_with_several_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(2_000, 0, -1)] + [(5_000, [1.0, 2.0])] * 3 + [(6_000 + i, [1.0, 2.1 + i / 1000]) for i in range(50)] + [(0, [2.0, 1.0]), (0, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in neighbours.search(table, leaf=64, cell=128).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[5_000] == [0, 1, 2, 3, 4] and got[50] == [0, 1, 2, 3, 4] and got[0] == [1, 2, 3, 4, 5] and len(got) == 43
