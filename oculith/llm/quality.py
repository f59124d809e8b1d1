"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its words (hashed to `WORDS` terms), trigrams of character classes (case, digits, blanks, each kind of
punctuation, letters beyond ASCII) and the shares of repeated, shouted and punctuated words, over the whole text. A bounded sample of labelled documents
(`per_class` of each label, by hash order) gives term weights and a truncated SVD; its projected vectors, at most
2 * per_class * rank numbers, are broadcast. Every document is projected and compared with all of them by exact cosine
products in blocks; the nearest vote with their similarity, corrected for the sample's class balance.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oculith.llm.shared import crc_fold, numbered_columns, slices, texts

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bound of the labelled sample and shape of the model.
PER_CLASS, RANK, NEIGHBOURS = 1000, 64, 25
SHAPES, SHARES = 4096, 12
WORDS, WORD_WEIGHT = 2048, 0.5
TERMS = SHAPES + 3 * SHARES + WORDS


def _classes() -> np.ndarray:
    table = np.full(256, 15, np.uint16)
    table[:128] = 14
    for code, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "'\"()-", "|", "#$%&*+=<>^~@", "/\\", "[]{}", "_`")):
        table[[ord(c) for c in chars]] = code
    return table


CLASSES = _classes()


def terms(raw: bytes) -> np.ndarray:
    """Term frequencies of one text: square roots, of length 1 in each of the five parts (WORD_WEIGHT for words)."""
    out = np.zeros(TERMS, np.float32)
    if not raw:
        return out
    c = CLASSES[np.frombuffer(raw, np.uint8)]
    if len(c) > 2:
        shape = np.sqrt(np.bincount(c[:-2] << 8 | c[1:-1] << 4 | c[2:], minlength=SHAPES))
        out[:SHAPES] = shape / np.linalg.norm(shape)
    words = raw.split()
    if words:
        repeated = sum(map(eq, words, words[1:])) / len(words)
        shouted = int((c == 1).sum()) / max(1, int((c <= 1).sum()))
        marked = int(np.isin(c, (7, 9, 10)).sum()) / len(raw)
        for part, share in enumerate((repeated, shouted, min(1.0, 4 * marked))):
            at = share * (SHARES - 1)
            low = int(at)
            out[SHAPES + part * SHARES + low] = 1 - (at - low)
            if at > low:
                out[SHAPES + part * SHARES + low + 1] = at - low
        held = np.sqrt(np.bincount(np.fromiter(map(crc32, words), np.uint32, len(words)) % WORDS, minlength=WORDS))
        out[-WORDS:] = held * (WORD_WEIGHT / np.linalg.norm(held))
    return out


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1; the smallest of several) of the labelled documents of the training folds."""
    rows = labels.filter((crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))


def labelled_terms(docs: DataFrame, labels: DataFrame, label: str, per_class: int, shares: dict[int, int]) -> pd.DataFrame:
    """label, at and value (places and values of the terms that aren't zero, as bytes) of at most `per_class` labelled
    training documents of each class, by hash order. `shares` has the number of labelled documents of each class."""
    order = F.xxhash64("doc_id")
    ids, n = labelled(labels, label), shares
    # The first of a class by hash lie below this hash: about twice as many as needed go on to be ranked, however many there are.
    below = {y: min(1.0, (2 * per_class + 200) / n.get(y, 1)) * 2.0**64 - 2.0**63 for y in (0, 1)}
    ids = ids.filter(order.cast("double") <= F.when(F.col("label") == 1, below[1]).otherwise(below[0]))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "doc_id"))
    ids = ids.withColumn("rank", rank).filter(F.col("rank") <= per_class).select("doc_id", "label")
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # 2 * per_class ids
    chosen = chosen.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row an id, however often it is there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [terms(x) for x in texts(batch)]
            at = [np.flatnonzero(x).astype(np.uint16) for x in found]
            columns = [pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x[k].tobytes() for x, k in zip(found, at)], pa.binary())]
            yield pa.record_batch([batch.column("doc_id").cast(pa.string()), batch.column("label").cast(pa.int32()), *columns], names=["doc_id", "label", "at", "value"])

    out = chosen.select("doc_id", "label", "text").mapInArrow(run, "doc_id string, label int, at binary, value binary").toPandas()
    return out.sort_values("doc_id")


class Model:
    """Projection, labelled vectors and vote weights; everything is bounded by per_class, rank and TERMS."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.prior, self.neighbours, self.y = prior, neighbours, y
        if not len(y):
            return
        self.idf = (np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
        x = self.weigh(x)
        rng = np.random.default_rng(0)
        q = x @ rng.standard_normal((x.shape[1], rank + 16), dtype=np.float32)
        for _ in range(4):  # randomised subspace iteration
            q = x @ (x.T @ np.linalg.qr(q)[0])
        _, _, v = np.linalg.svd(np.linalg.qr(q)[0].T @ x, full_matrices=False)
        self.v = np.ascontiguousarray(v[:rank].T)
        self.vectors = np.ascontiguousarray(self.project(x).T)
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        self.vote = (np.array([1 - prior, prior]) / np.maximum(n, 1) * len(y))[y].astype(np.float32)

    def weigh(self, x: np.ndarray) -> np.ndarray:
        x = x * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.v
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, raws: list[bytes]) -> np.ndarray:
        """Weighted share of label 1 among the nearest; the prior for texts without terms."""
        out = np.full(len(raws), self.prior)
        some = [i for i, x in enumerate(raws) if x]
        if not len(self.y) or not some:
            return out
        x = np.stack([terms(raws[i]) for i in some])
        near = self.project(self.weigh(x)) @ self.vectors
        k = min(self.neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        s = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** 8 * self.vote[at]
        total = s.sum(axis=1)
        out[some] = np.where(total > 0, (s * self.y[at]).sum(axis=1) / np.maximum(total, 1e-30), self.prior)
        return out.clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from training folds only. Without any label the model gives 0.5."""
    n = {r["label"]: r["count"] for r in labelled(labels, label).groupBy("label").count().collect()}  # two rows at most
    rows = labelled_terms(docs, labels, label, per_class, n)
    x = np.zeros((len(rows), TERMS), np.float32)
    for row, at, value in zip(x, rows["at"], rows["value"]):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    return Model(x, rows["label"].to_numpy(np.int64), n.get(1, 0) / sum(n.values()) if n else 0.5)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no terms: they score the share of label 1 among labelled documents, as nothing speaks for
    or against them. A null doc_id isn't held out and never learned from. Several labels of a document count as the
    smallest, labels other than 0 and 1 as none; repeated rows score alike; texts of any length are read whole; other
    columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.score(texts(batch)))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject (see score_quality), whole rows in one pass. Each row is decided
    by its own text, so null and repeated ids don't matter, nor do the names of other columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = model.value.score([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(score >= THRESHOLD))

    plain = numbered_columns(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
