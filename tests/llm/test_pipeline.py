"""The pipeline's stages against brute force, each on what the one before it kept; and the pipeline on awkward tables."""

import zlib

import pytest

import corpus_pipeline
from oculith.llm import mixing, quality
from oculith.llm.shared import written
from tests.llm.test_operators import AWKWARD, DOCS
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), f"test-{name}")
        kept = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        ids = {r["doc_id"] for r in kept}
        if name == "quality":
            scored = quality.score_quality(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert ids == {r["doc_id"] for r in scored if r["predicted"]}
        elif name == "exact_dedup":
            best = {}
            for r in before:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                best[text] = max(best.get(text, -1), r["doc_id"])
            assert ids == set(best.values())
        elif name == "simhash_dedup":
            roots = brute_components({r["doc_id"]: shingles(r["text"]) for r in before}, near)
            assert ids == set(roots.values())
        elif name == "mixing":
            mixed = {r["doc_id"]: r["sampled"] for r in mixing.mix(spark.createDataFrame(before, docs.schema)).collect()}
            assert ids == {d for d, sampled in mixed.items() if sampled} and 0 < len(ids) < len(before)
        else:
            sizes = {}
            for r in kept:
                sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
                assert r["doc_tokens"] >= r["length"]
            assert sizes == {r["doc_id"]: r["doc_tokens"] for r in kept} and sizes.keys() == {r["doc_id"] for r in before}


@pytest.mark.parametrize("rows", [[(*r, "x", "y", "z", "p", 7) for r in AWKWARD], []])
def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, DOCS).withColumnRenamed("part", "a.b")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), f"awkward-{name}")
        assert docs.columns == table.columns
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({repr(r["doc_id"]) for r in pieces}) == sorted({repr(r["doc_id"]) for r in docs.collect()})
    assert bool(pieces) == bool(rows)


def test_folds_follow_crc32():
    assert zlib.crc32(b"12") % 5 in range(5)
