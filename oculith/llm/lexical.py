"""Ranked lexical search: exact inner products of sparse integer vectors, found through ball trees.

A document is the vector of what its terms are worth times their weights, an item the vector of its terms' counts; the
score is their inner product in whole numbers. Documents become rows of (term numbers, counts) once. Each task then builds
ball trees over blocks of its documents: a node has the centroid and the radius of its documents, and no document of it
can score more than item . centroid + |item| * radius, nor more than item . (the largest value of each term). Nodes are
opened best first, until the best left can't reach the scores that an item's best documents have already; bounds are
rounded up by more than doubles can be off, so nothing is lost. Leaves are scored in 64-bit integers. Each task keeps the
best of an item; those are ranked over all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush
from math import floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oculith.llm.shared import slices, texts, written

#: Separators of terms become blanks, A-Z their lower case; all other bytes stay, so letters beyond ASCII belong to terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
BEST, LEAF = 20, 64
#: Documents and term counts of a block, which one tree holds; bytes of items that are searched in one pass.
DOCUMENTS, COUNTS, ITEM_BYTES = 8_192, 2_000_000, 1 << 18


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


class Rows:
    """Sparse rows: term numbers and values of all rows in two arrays, and where each row starts. No row is empty."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.starts, self.columns, self.values = starts, columns, values

    def take(self, which: np.ndarray) -> Rows:
        sizes = np.diff(self.starts)[which]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[which] - starts[:-1], sizes)
        return Rows(starts, self.columns[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.columns], self.starts[:-1])


class BallTree:
    """Nodes over sparse rows, in lists: centroid, radius, largest values, range of rows (in the tree's own order) and
    children."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        self.centres, self.radii, self.tops, self.ranges, self.children = [], [], [], [], []
        self.order = np.arange(len(rows.starts) - 1)
        square = np.add.reduceat(rows.values.astype(float) ** 2, rows.starts[:-1])
        self._build(rows, square, 0, len(self.order), width, leaf)
        self.rows = rows.take(self.order)

    def _build(self, rows: Rows, square: np.ndarray, low: int, high: int, width: int, leaf: int) -> None:
        todo = [(low, high, None)]
        while todo:
            low, high, parent = todo.pop()
            own, node = self.order[low:high], len(self.ranges)
            part = rows.take(own)
            centre = np.bincount(part.columns, part.values, width) / len(own)
            away = self._distance(part, square[own], centre)
            # What doubles may be off in the difference of squares is added back before the root is taken.
            self.radii.append(sqrt(away.max() + 1e-11 * (square[own].max() + centre @ centre)))
            self.centres.append(centre)
            top = np.zeros(width)
            np.maximum.at(top, part.columns, part.values)
            self.tops.append(top)
            self.ranges.append((low, high))
            self.children.append(None)
            if parent is not None:
                self.children[parent] = (*(self.children[parent] or ()), node)
            if high - low <= leaf or away.max() <= 1e-9 * square[own].max():  # copies of one document stay together
                continue
            one = self._dense(part, int(away.argmax()), width)
            to_one = self._distance(part, square[own], one)
            two = self._dense(part, int(to_one.argmax()), width)
            near = to_one <= self._distance(part, square[own], two)
            split = low + int(near.sum())
            if low < split < high:
                self.order[low:high] = np.concatenate([own[near], own[~near]])
                todo += [(split, high, node), (low, split, node)]

    @staticmethod
    def _dense(rows: Rows, row: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        at = slice(rows.starts[row], rows.starts[row + 1])
        out[rows.columns[at]] = rows.values[at]
        return out

    @staticmethod
    def _distance(rows: Rows, square: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, square - 2.0 * rows.dot(to) + to @ to)

    def bound(self, node: int, columns: np.ndarray, weights: np.ndarray, length: float) -> float:
        """No row below the node has a larger inner product with the item."""
        ball = self.centres[node][columns] @ weights + length * self.radii[node]
        return min(ball, self.tops[node][columns] @ weights) * (1 + 1e-9) + 1.0

    def search(self, item: np.ndarray, found: Best) -> int:
        """Offers the rows of the leaves that may matter to `found`; says how many leaves that were."""
        columns = np.flatnonzero(item)
        weights = item[columns].astype(float)
        length, opened = sqrt(weights @ weights), 0
        heap = [(-self.bound(0, columns, weights, length), 0)]
        while heap and -heap[0][0] >= found.least:  # an equal score may still win by its id
            _, node = heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heappush(heap, (-self.bound(child, columns, weights, length), child))
                continue
            low, high = self.ranges[node]
            part = slice(self.rows.starts[low], self.rows.starts[high])
            scores = np.add.reduceat(self.rows.values[part] * item[self.rows.columns[part]], self.rows.starts[low:high] - self.rows.starts[low])
            found.offer(scores, self.order[low:high])
            opened += 1
        return opened


class Best:
    """The best rows of an item so far, by score and then id (null last); `least` is what a row must reach."""

    def __init__(self, size: int = BEST):
        self.size, self.least, self.rows, self.ids = size, 1, [], None

    def offer(self, scores: np.ndarray, order: np.ndarray) -> None:
        for at in np.flatnonzero(scores >= self.least):
            doc_id = self.ids[order[at]]
            self.rows.append((-int(scores[at]), doc_id is None, doc_id or 0))
        if len(self.rows) > self.size:
            self.rows = sorted(self.rows)[: self.size]
        if len(self.rows) == self.size:
            self.least = max(1, -max(self.rows)[0])


def counted(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and numbers and counts of the wanted terms, of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(doc_id, len(found), Counter([wanted[t] for t in found if t in wanted])) for doc_id, found in zip(batch.column("doc_id").to_pylist(), map(terms, texts(batch))) if found]
            ids, n, counts = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "terms": pa.array([list(c) for c in counts], pa.list_(pa.int32())), "tf": pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def weight(total: int, df: int) -> int:
    return floor(1000 * log((2 * total + 2) / (2 * df + 1)))


def worth(tf: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What a term that occurs tf times is worth in a document of n terms, before its weight; whole numbers, rounded down."""
    m = 100 - 25 + (25 * n * total) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, total: int, length: int) -> Iterator[tuple[list, Rows]]:
    """Ids and rows of a tree's documents at a time."""

    def block() -> tuple[list, Rows]:
        sizes = np.concatenate([b.column("terms").value_lengths().to_numpy() for b in held])
        tf = np.concatenate([b.column("tf").flatten().to_numpy() for b in held])
        n = np.repeat(np.concatenate([b.column("n").to_numpy() for b in held]), sizes)
        columns = np.concatenate([b.column("terms").flatten().to_numpy() for b in held])
        ids = [x for b in held for x in b.column("doc_id").to_pylist()]
        return ids, Rows(np.concatenate([[0], np.cumsum(sizes)]), columns, worth(tf, n, total, length) * weights[columns])

    held, documents, counts = [], 0, 0
    for batch in slices(batches):
        held.append(batch)
        documents, counts = documents + batch.num_rows, counts + len(batch.column("terms").flatten())
        if documents >= DOCUMENTS or counts >= COUNTS:
            yield block()
            held, documents, counts = [], 0, 0
    if documents:
        yield block()


def _ranked(docs: DataFrame, items: list[tuple], best: int) -> DataFrame:
    """The best documents of each item that the tasks found: item_id, item (its number), doc_id, score."""
    said = [terms((text or "").encode()) for _, text in items]
    wanted = {t: k for k, t in enumerate(sorted({t for own in said for t in own}))}
    table = written(counted(docs, wanted), "lexical")
    total, length = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(wanted), np.int64)
    for row in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the items
        df[row["term"]] = row["count"]
    weights = np.array([weight(total, int(d)) for d in df], np.int64)
    own = [Counter(wanted[t] for t in said_) for said_ in said]
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, item = [Best(best) for _ in shared.value], np.zeros(len(weights), np.int64)
        for ids, rows in blocks(batches, weights, total, length):
            tree = BallTree(rows, len(weights))
            for counts, best_ in zip(shared.value, found):
                for k, n in counts.items():
                    item[k] = n
                best_.ids = ids
                tree.search(item, best_)
                item[list(counts)] = 0
        out = [(k, None if none else doc_id, -score) for k, b in enumerate(found) for score, none, doc_id in b.rows]
        yield pa.record_batch({name: pa.array(column, kind) for name, column, kind in zip(("item", "doc_id", "score"), zip(*out) if out else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()))})

    found = table.filter(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long")
    names = docs.sparkSession.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(items)], "item int, item_id long")
    return found.join(F.broadcast(names), "item")  # the items of one pass


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The best documents of every item: item_id, rank (from 1), doc_id, score; scores above 0 only, equal ones by doc_id.

    Items are searched in passes of about ITEM_BYTES of text (by a hash of the item); each pass reads the documents once.
    Null texts have no terms; documents without a term count for nothing. Items without a hit have no row. Rows that repeat
    id and text of an item count once; an item id with several texts ranks them together. Repeated documents each count and
    rank; a null doc_id ranks last among equals. Whole texts are read, in time that grows with their length; other columns
    are ignored. Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes, out = max(1, -(-size // ITEM_BYTES)), None
    for k in range(passes):
        rows = [(r["item_id"], r["text"]) for r in asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()]
        if rows:
            part = _ranked(docs, rows, best)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # First within parts of an item's rows, so that no task holds all of an item's.
    part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))).orderBy(*order)
    out = out.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= best)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= best)
    return out.select("item_id", "rank", "doc_id", "score")
