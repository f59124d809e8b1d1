"""Near duplicates by SimHash: fingerprints, bit-sliced comparison, and components.

Fingerprints within `radius` bits agree on at least two of radius + 2 blocks of bits, so each is dealt once for each
pair of blocks and compared only with those that agree there. Only different fingerprints are dealt, never documents.
Within a bucket, bit planes are stored vertically (one machine word holds a bit of 64 fingerprints); distances to all
of them are counted by carry-save adders on whole words, and blocks are abandoned once all their lanes exceed the
radius. A bucket gives a spanning forest of its links, never all pairs. Components are then found by alternating
large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from oculith.llm.shared import looked_up, numbered_columns, one_row, slices, texts, written

LANES = 64
#: Words of lanes that are abandoned together.
BLOCK = 16
#: Most fingerprints of one bucket that are compared in one task's block.
MOST = 4096


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text: A-Z lower-cased, split at ASCII white space, XXH64 of shingles of `width` words with repeats.

    A bit is set if more than half of the hashes have it. Fewer words give one shingle; none give 0.
    """
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return int.from_bytes(xxhash.xxh64_digest(joined, seed), "big")
    starts = np.concatenate(([0], ends[:-width] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 4096):
        counts += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


def planes(values: np.ndarray) -> np.ndarray:
    """Vertical bit planes: row b has bit b of all values, 64 of them in a word."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    pad = -len(values) % LANES
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, pad), (0, 0))).T, axis=1)).view(np.uint64)


def within(vertical: np.ndarray, n: int, radius: int, query: int = 0) -> np.ndarray:
    """Which of the `n` lanes differ from `query` in at most `radius` bits."""
    return near_lanes(blocked(vertical), radius, query)[:n]


def blocked(vertical: np.ndarray) -> np.ndarray:
    """Planes in blocks of words, the form that near_lanes() reads again for every query."""
    blocks = -(-vertical.shape[1] // BLOCK)
    padded = np.zeros((64, blocks * BLOCK), np.uint64)
    padded[:, : vertical.shape[1]] = vertical
    return padded.reshape(64, blocks, BLOCK)


def near_lanes(store: np.ndarray, radius: int, query: int, alive: np.ndarray | None = None) -> np.ndarray:
    """One flag a lane: whether it differs from `query` in at most `radius` bits. Only blocks in `alive` are read.

    Two planes at a time go through a carry-save adder into bitwise counters. After every eight planes, blocks of
    words whose lanes all exceed the radius are abandoned.
    """
    blocks = store.shape[1]
    depth = max(radius, 1).bit_length()
    alive = np.arange(blocks) if alive is None else alive
    counters = [np.zeros((len(alive), BLOCK), np.uint64) for _ in range(depth)]
    over = np.zeros((len(alive), BLOCK), np.uint64)
    ones = ~np.uint64(0)
    for plane in range(0, 64, 2):
        a = store[plane, alive]
        b = store[plane + 1, alive]
        if query >> (63 - plane) & 1:
            a = a ^ ones
        if query >> (62 - plane) & 1:
            b = b ^ ones
        half = counters[0] ^ a
        carry = (counters[0] & a) | (half & b)
        counters[0] = half ^ b
        for i in range(1, depth):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if plane % 8 == 6:
            exceed = over | _greater(counters, radius)
            keep = (exceed != ones).any(axis=1)
            if not keep.all():
                alive, over, counters = alive[keep], over[keep], [c[keep] for c in counters]
                if not len(alive):
                    break
    near = np.zeros((blocks, BLOCK), np.uint64)
    if len(alive):
        near[alive] = ~(over | _greater(counters, radius))
    return np.unpackbits(near.reshape(-1).view(np.uint8)).astype(bool)


def _greater(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            more |= equal & counters[i]
            equal = equal & ~counters[i]
    return more


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indices) that connect what is connected within the radius: a search from each lane not yet reached.

    The bit planes are stored once and read by every query, with a mask for the lanes that are left; blocks without any
    are skipped, and the planes are stored anew only when half of the lanes are gone.
    """
    at, links = np.arange(len(values)), []
    left, store, queue, seed = np.ones(len(values), bool), blocked(planes(values)), [], 0
    lanes = LANES * BLOCK
    while left.any():
        if not queue:
            seed += int(np.argmax(left[seed:]))
            left[seed] = False
            queue.append(seed)
        query = queue.pop()
        own = np.zeros(store.shape[1] * lanes, bool)
        own[: len(left)] = left
        hit = np.flatnonzero(near_lanes(store, radius, int(values[at[query]]), np.flatnonzero(own.reshape(-1, lanes).any(axis=1)))[: len(left)] & left)
        links += [(at[query], x) for x in at[hit]]
        left[hit] = False
        queue += hit.tolist()
        if len(left) > 2 * lanes and 2 * np.count_nonzero(left) < len(left):
            keep = left.copy()
            keep[queue] = True
            moved = np.cumsum(keep) - 1
            at, left, queue, seed = at[keep], left[keep], moved[queue].tolist(), 0
            store = blocked(planes(values[at]))
    return links


def bucket_links(batches: Iterator[pa.RecordBatch], radius: int, small: int = 16) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys; rows (key, fp) come sorted by key. A run may span batches."""
    rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        size, values = ends - starts, fp.view(np.uint64)
        left, right = [], []
        for gap in range(1, small):
            at = np.repeat(starts, np.where(size <= small, np.maximum(size - gap, 0), 0))
            if not len(at):
                break
            own = np.where(size <= small, np.maximum(size - gap, 0), 0)
            at = at + np.arange(len(at)) - np.repeat(np.cumsum(own) - own, own)
            for lo in range(0, len(at), 1 << 16):
                a = at[lo : lo + (1 << 16)]
                hit = within(planes(values[a] ^ values[a + gap]), len(a), radius)
                left.append(fp[a[hit]])
                right.append(fp[a[hit] + gap])
        for i in np.flatnonzero(size > small):
            found = np.array(forest(values[starts[i] : ends[i]], radius), np.int64).reshape(-1, 2) + starts[i]
            left.append(fp[found[:, 0]])
            right.append(fp[found[:, 1]])
        empty = np.zeros(0, np.int64)
        a, b = np.concatenate([empty, *left]), np.concatenate([empty, *right])
        return pa.record_batch({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    for batch in batches:
        key = np.concatenate((rest[0], batch.column("key").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((rest[1], batch.column("fp").to_numpy(zero_copy_only=False)))
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        rest = (key[last:], fp[last:])
        if last:
            yield links(key[:last], fp[:last])
    if len(rest[0]):
        yield links(*rest)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x, width) for x in texts(batch)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def near_links(fps: DataFrame, radius: int = 4, most: int = MOST) -> DataFrame:
    """Links u > v that connect all fingerprints (column fp, distinct) which pairs within the radius connect.

    A key with more than `most` fingerprints is dealt as pairs of parts: no task holds more than two parts of it, and
    every pair still meets.
    """
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(F.col("fp"), 64 - b).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    width = -(-64 // blocks)
    keys = [
        F.shiftleft(F.lit(t).cast("long"), 2 * width) + F.shiftleft(parts[i].cast("long"), width) + parts[j]
        for t, (i, j) in enumerate(combinations(range(blocks), 2))
    ]
    keyed = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    full = written(keyed.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "full-keys")
    pairs = keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    if full.head(1):
        part = keyed.join(full, "key", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int"))
        other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")))
        part = part.select("key", "fp", "part", F.explode(other).alias("other"))
        pairs = part.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
    dealt = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select(F.xxhash64("key", "i", "j").alias("key"), "fp")
    return dealt.mapInArrow(lambda batches: bucket_links(batches, radius), "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for all nodes of links u > v."""
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    links = written(links, "links")
    before = state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        links = written(small, "links")
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """fp, n (its rows), rep (its smallest doc_id), root of its component; one row for each different fingerprint."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(near_links(nodes.select("fp"), radius))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", "rep", F.coalesce("root", "fp").alias("root"))
    return written(grouped, "roots")


def simhash_dedup(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts, and texts of white space only, have fingerprint 0 and are linked like any other. Repeated
    rows share a component. A null doc_id is larger than any other; a component of null ids only has a null id. Texts of
    any length are read whole; other columns are ignored; an empty table gives no rows.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    grouped = grouped_fingerprints(fps, radius)
    best = grouped.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labels = looked_up(grouped.select("fp", "root", F.col("n").alias("docs")), best, "root", grouped.count())
    labels = written(labels.select("fp", "component_id", F.col("docs").alias("n")), "labels")
    return looked_up(fps, labels, "fp", fps.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """Of each component one row, that with the smallest doc_id (null last); whole rows, whatever their columns are called.
    Of rows that repeat an id within a component, one stays. An empty table gives an empty result."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            fps = np.array([fingerprint(x, width) for x in raws], np.uint64).view(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "fp"])

    plain = numbered_columns(docs)
    rows = plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("fp", LongType())]))
    rows = written(rows.select(F.struct(*(F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns))).alias("whole"), "fp"), "fingerprinted")
    roots = grouped_fingerprints(rows.select(F.col("whole")["doc_id"].alias("doc_id"), "fp"), radius).select("fp", "root")
    return one_row(rows.join(roots, "fp"), ["root"], largest=False)
