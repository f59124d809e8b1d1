"""A training corpus from `documents`: reject poor texts, drop exact and near copies, mix sources, pack.

Each stage works on all that the one before it kept and is written as Parquet; all but the last return the columns of
documents, the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oculith.llm import exact_dedup, mixing, near, packing, quality
from oculith.llm.queries import TOKENIZER
from oculith.llm.shared import lasting, remove, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the training folds of `labels`, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id."""
    return exact_dedup.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest doc_id. SimHash fingerprints linked as by operator 4, and
    min-hashes for what these miss, propose; Jaccard similarity of 5-word shingles from 0.8 decides."""
    return near.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights."""
    return mixing.keep_sampled(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, near copies and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; what each returns is written to the shared folder and read again, in place of
    what the stage before it returned."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        with scratch():
            docs, path = lasting(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(before)
        before = [path]
    return docs
