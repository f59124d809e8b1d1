"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one priority queue, exact reranking.

A tree splits at the medians of a bounded sample along random directions, a direction for each level, all orthogonal. Every
vector lies in one leaf of each tree. A query puts the roots of all trees in one queue and opens nodes by the chance that a
neighbour lies below: a neighbour with cosine s is s * query plus a random direction across, so its place along a
direction is normal, and the chance of either side of a split is known. s is the query's fifth best cosine in the sample,
so the chances are for neighbours that are no nearer than the true ones. The search ends when the chance that all trees
miss such a neighbour is small: few leaves where vectors cluster, most of them where vectors are noise.

Leaves are dealt in cells of neighbouring leaves, and a query goes once to each cell that holds leaves of it. There the
leaf's candidates are scored exactly, and the best of all cells are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from math import ceil, erf, log2, prod, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEST, EVERY = 5, 50
#: Trees, vectors of a leaf and of a cell (as far as the sample allows), chance to find a neighbour.
TREES, LEAF, CELL, FOUND = 3, 256, 16_384, 0.97
#: Vectors of the sample (by a hash of their ids) that splits are learned from; leaves of a tree never hold under eight of it.
SAMPLE = 65_536
#: Queries scored at a time.
AT_ONCE = 128


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their vectors as doubles, scaled by powers of two so that squares stay in range."""
    ids, lists = batch.column("id"), batch.column("vector")
    sized = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
    at = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[fine]
    return at[fine], np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Forest:
    """Directions and thresholds of the trees; level l of a tree has 2^l thresholds."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, depth: int, trees: int = TREES, seed: int = 11):
        """sample: unit vectors."""
        self.sample, self.ids, self.depth, dim = sample, ids, depth, sample.shape[1]
        random = np.random.default_rng(seed)
        self.turns = [np.linalg.qr(random.normal(size=(dim, dim)))[0][:, :depth] for _ in range(trees)]
        self.splits = []
        for turn in self.turns:
            along, node, levels = sample @ turn, np.zeros(len(sample), int), []
            for level in range(depth):
                order = np.lexsort((along[:, level], node))
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                middle = (ends[:-1] + np.maximum(ends[1:] - 1, ends[:-1])) // 2
                levels.append(along[order[np.minimum(middle, len(order) - 1)], level])
                node = 2 * node + (along[:, level] > levels[-1][node])
            self.splits.append(levels)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector in each tree."""
        out = np.zeros((len(self.turns), len(x)), np.int32)
        for tree, (turn, levels) in enumerate(zip(self.turns, self.splits)):
            along = x @ turn
            for level in range(self.depth):
                out[tree] = 2 * out[tree] + (along[:, level] > levels[level][out[tree]])
        return out

    def nearest(self, x: np.ndarray, own: np.ndarray, best: int) -> np.ndarray:
        """The best-th cosine of each query within the sample, the query's own row left out."""
        cos = x @ self.sample.T
        cos[own[:, None] == self.ids[None, :]] = -1.0
        return -np.partition(-cos, min(best, cos.shape[1]) - 1, axis=1)[:, min(best, cos.shape[1]) - 1]

    def visits(self, x: np.ndarray, cosine: float, found: float) -> list[tuple[int, int]]:
        """(tree, leaf) of one query, best first, until a neighbour with this cosine is missed with chance 1 - found."""
        cosine = min(max(cosine, 0.0), 1.0)
        across = sqrt(max((1 - cosine * cosine) / max(1, len(x) - 1), 1e-12))
        along = [x @ turn for turn in self.turns]
        queue, missed, out = [(-1.0, tree, 0, 0) for tree in range(len(self.turns))], [1.0] * len(self.turns), []
        while queue and prod(missed) > 1 - found:
            chance, tree, level, node = heappop(queue)
            if level == self.depth:
                out.append((tree, node))
                missed[tree] = max(0.0, missed[tree] + chance)
                continue
            at = float(along[tree][level])
            z = (self.splits[tree][level][node] - cosine * at) / (across * sqrt(max(1 - at * at, 1e-12)))
            left = 0.5 * (1 + erf(z / sqrt(2)))
            heappush(queue, (chance * left, tree, level + 1, 2 * node))
            heappush(queue, (chance * (1 - left), tree, level + 1, 2 * node + 1))
        return out


class Copies:
    """Leaves out repeated rows, and rows of vectors that many rows share where enough with smaller ids have passed: a
    query's best hold no more of a vector's copies than the `most` with the smallest ids."""

    def __init__(self, most: int):
        self.most, self.seen = most, {}

    def keep(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        groups: dict[bytes, list[int]] = {}
        for k, row in enumerate(x):
            groups.setdefault(row.tobytes(), []).append(k)
        out = []
        for key, rows in groups.items():
            known = self.seen.get(key)
            if known is None and len(rows) == 1:
                out += rows
                continue
            once = {ids[k]: k for k in rows if known is None or (ids[k] not in known and (len(known) < self.most or ids[k] < known[-1]))}
            kept = sorted(once.items())[: self.most]
            out += [k for _, k in kept]
            if known is not None or len(self.seen) < 10_000:
                self.seen[key] = sorted([*(known or []), *(i for i, _ in kept)])[: self.most]
        return np.sort(np.array(out, int))


def fitted(vectors: DataFrame, dim: int, total: int, leaf: int, sample: int, trees: int) -> Forest:
    """The forest of a table of id and vector, from about `sample` of them."""
    below = min(1.0, sample / max(1, total)) * 2.0**64 - 2.0**63  # as many as wanted lie below this hash, on average
    rows = vectors.filter(F.col("id").isNotNull() & (F.xxhash64("id").cast("double") <= below)).toArrow().combine_chunks()
    batches = [(b, *usable(b, dim)) for b in rows.to_batches()]
    ids = np.concatenate([b.column("id").to_numpy()[at] for b, at, _ in batches] or [np.zeros(0, int)])
    x = np.concatenate([x for *_, x in batches] or [np.zeros((0, dim))])
    order = np.lexsort((*x.T[::-1], ids))
    depth = max(0, min(dim, ceil(log2(max(1, total / leaf))), int(log2(max(1, len(x) / 8)))))
    return Forest(units(x[order]), ids[order], depth, trees)


def search(embeddings: DataFrame, best: int = BEST, every: int = EVERY, trees: int = TREES, leaf: int = LEAF, cell: int = CELL, found: float = FOUND, sample: int = SAMPLE) -> DataFrame:
    """Each query's nearest rows: query_id, rank (from 1), vec_id, score (cosine), ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; rows with the query's own id are no candidates. Every row is
    indexed; a sample of bounded size only places the splits. Vectors that are null, all zero, or hold a null, an infinity
    or a NaN take no part, nor do null ids and vectors of another length than most. Repeated rows count once; an id with
    several vectors is several candidates, the best of which counts, and as a query the best of its vectors' neighbours.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    lengths = vectors.filter("id is not null and size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = lengths[0]
    kind = vectors.schema["vector"].dataType.simpleString()
    forest = spark.sparkContext.broadcast(fitted(vectors, dim, total, leaf, sample, trees))
    leaves = 1 << forest.value.depth
    together = min(leaves, 1 << int(log2(max(1.0, cell * leaves / total))))  # leaves of a cell, which is of one tree
    parts = max(1, ceil(total / leaves / cell))  # a leaf of more rows than a cell is dealt in parts
    schema = f"cell int, part int, query boolean, id long, leaves array<int>, vector {kind}"

    def dealt(batch: pa.RecordBatch, at: np.ndarray, cells: list, own: list, query: bool, part: np.ndarray) -> pa.RecordBatch:
        picked = batch.take(pa.array(at))
        return pa.record_batch({"cell": pa.array(cells, pa.int32()), "part": pa.array(part, pa.int32()), "query": pa.array(np.full(len(at), query)), "id": picked.column("id"), "leaves": pa.array(own, pa.list_(pa.int32())), "vector": picked.column("vector")})

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies = Copies(best + 1)
        for batch in batches:
            at, x = usable(batch, dim)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[at].astype(np.int64)
            keep = copies.keep(ids, x)
            at, x, ids = at[keep], x[keep], ids[keep]
            for tree, own in enumerate(forest.value.leaves(units(x))):
                number = tree * leaves + own
                yield dealt(batch, at, number // together, number[:, None].tolist(), False, (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % parts)

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                at, x = usable(batch, dim)
                if not len(at):
                    continue
                ids, x = batch.column("id").to_numpy(zero_copy_only=False)[at].astype(np.int64), units(x)
                rows, cells, own = [], [], []
                for k, cosine in enumerate(forest.value.nearest(x, ids, best)):
                    to: dict[int, list[int]] = {}
                    for tree, node in forest.value.visits(x[k], float(cosine), found):
                        to.setdefault((tree * leaves + node) // together, []).append(tree * leaves + node)
                    rows += [at[k]] * len(to)
                    cells += to
                    own += to.values()
                for part in range(parts):
                    yield dealt(batch, np.array(rows), cells, own, True, np.full(len(rows), part))

    both = vectors.mapInArrow(candidates, schema).unionByName(vectors.filter(F.col("id") % every == 0).mapInArrow(queries, schema))
    both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "query")  # a cell's candidates come before its queries

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "part", "query")])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if current != tuple(keys[:2, low]):
                    current, held, index = tuple(keys[:2, low]), [], None
                if not keys[2, low]:
                    held.append(batch.slice(low, high - low))
                    continue
                index = index or (Cell(held, dim) if held else None)
                for at in range(low, high, AT_ONCE):
                    if index:
                        yield index.nearest(batch.slice(at, min(AT_ONCE, high - at)), best)

    found_ = both.mapInArrow(score, "query_id long, vec_id long, score double")
    found_ = found_.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # trees find the same rows
    ranked = found_.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")


class Cell:
    """Candidates of a cell by leaf, and their exact cosines to queries."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        table = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        own, ids, x = table.column("leaves").flatten().to_numpy(), table.column("id").to_numpy(), usable(table, dim)[1]
        self.dim, self.repeated = dim, len(np.unique(ids)) < len(ids)
        order = np.lexsort((*x.T, ids, own)) if self.repeated else np.argsort(own, kind="stable")
        own, ids, x = own[order], ids[order], x[order]
        if self.repeated:  # rows that other tasks have let through too
            new = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(ids) != 0) | (np.diff(x, axis=0) != 0).any(axis=1)])
            own, ids, x = own[new], ids[new], x[new]
        self.ids, self.x, self.lengths, self.units = ids, x, np.sqrt((x * x).sum(axis=1)), units(x)
        self.leaves, starts = np.unique(own, return_index=True)
        self.ends, self.by_id = [*starts, len(own)], np.argsort(ids, kind="stable")

    def nearest(self, batch: pa.RecordBatch, best: int) -> pa.RecordBatch:
        """query_id, vec_id, score of at least the best rows of each query in the leaves that it visits."""
        queries, ids, x = batch.column("leaves"), batch.column("id").to_numpy(), usable(batch, self.dim)[1]
        owner = np.repeat(np.arange(len(ids)), queries.value_lengths().to_numpy())
        wanted, u = queries.flatten().to_numpy(), units(x)
        cos = np.full((len(ids), len(self.ids)), -np.inf)
        for k, leaf in enumerate(self.leaves):
            rows, span = owner[wanted == leaf], slice(self.ends[k], self.ends[k + 1])
            if len(rows):
                cos[rows, span] = u[rows] @ self.units[span].T
        cos[ids[:, None] == self.ids[None, :]] = -np.inf
        if self.repeated:  # of an id's vectors, the nearest counts
            sorted_ids = self.ids[self.by_id]
            starts = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            own = cos[:, self.by_id]
            top = np.repeat(np.maximum.reduceat(own, starts, axis=1), np.diff([*starts, len(sorted_ids)]), axis=1)
            cos[:, self.by_id] = np.where(own < top, -np.inf, own)
        last = min(best, cos.shape[1]) - 1
        least = -np.partition(-cos, last, axis=1)[:, last]
        # What lies within rounding of the last of the best is scored again, row by row, so that copies score alike.
        row, at = np.nonzero((cos >= (least - 1e-9)[:, None]) & (cos > -np.inf))
        exact = (self.x[at] * x[row]).sum(axis=1) / (self.lengths[at] * np.sqrt((x[row] * x[row]).sum(axis=1)))
        order = np.lexsort((self.ids[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < 4 * best
        return pa.record_batch({"query_id": pa.array(ids[row[keep]]), "vec_id": pa.array(self.ids[at[keep]]), "score": pa.array(exact[keep])})
