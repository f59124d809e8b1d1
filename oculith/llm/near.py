"""Near copies by exact Jaccard similarity of word shingles, for the corpus pipeline.

The texts' 64-bit SimHash fingerprints are linked within four bits as in operator 4, and what they connect is a key. That
can't find all pairs of Jaccard similarity 0.8, which differ in ten bits on average, so more keys come from min-hashes: BANDS keys of ROWS minima each, of which a pair at similarity s shares one with
probability 1 - (1 - s**ROWS)**BANDS (0.9996 at 0.8). What shares a key is first compared by SimHash fingerprints of
SKETCH bits, small enough to be dealt for every key: pairs at 0.8 differ in 39 of 256 bits on average (deviation 5.7), and
texts with nobody within RADIUS bits in a key leave it. Texts of few shingles have no reliable fingerprint and stay. What is
left of a key is compared by whole shingle sets, and only pairs at or over the threshold are links. A key with more than
`most` texts is dealt as pairs of parts, so that no task holds more than two parts of it and every pair still meets. Texts
that differ in case and white space only are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from oculith.llm import simhash
from oculith.llm.shared import kept_row, looked_up, numbered_columns, row_order, slices, written
from oculith.llm.simhash import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
#: Bits of a fingerprint, by how many a pair at the threshold may differ (4.4 deviations over its mean), and the fewest
#: shingles that a reliable fingerprint needs.
SKETCH, RADIUS, FEW = 256, 64, 64
#: Most texts of one key that are compared in one block: by fingerprints, and by whole sets.
MOST = 4096
#: Most nodes (8 bytes each) that are broadcast, by their count.
SMALL = 1_000_000
MULTIPLIERS, OFFSETS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def node_of(raw: bytes) -> int:
    """XXH64 (signed) of the words, A-Z lower-cased."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(raw.lower().split()))).view(np.int64))


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """The set of XXH64 of all runs of `width` words, sorted; fewer words give one shingle, none an empty set."""
    words = raw.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One signed key for each band of min-hashes; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), 512):
        np.minimum(least, (MULTIPLIERS * found[at : at + 512] + OFFSETS).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


MIXERS = np.random.default_rng(43).integers(0, 1 << 63, SKETCH // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(found: np.ndarray) -> bytes:
    """SimHash of a shingle set: a bit is set if more than half of the mixed hashes have it."""
    counts = np.zeros(SKETCH, np.int64)
    for at in range(0, len(found), 4096):
        h = found[at : at + 4096, None] * MIXERS
        h = (h ^ (h >> np.uint64(32))) * MIXERS
        counts += np.unpackbits(np.ascontiguousarray(h ^ (h >> np.uint64(29))).view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(found)).tobytes()


def partnered(prints: np.ndarray, size: np.ndarray, radius: int = RADIUS, threshold: float = THRESHOLD) -> np.ndarray:
    """Which rows of a key have another one of a size that allows the threshold and within the radius; for rows of few
    shingles the size alone counts."""
    n, out = len(prints), np.zeros(len(prints), bool)
    for at in range(0, n, 64):
        own = slice(at, at + 64)
        low, high = np.minimum(size[own, None], size), np.maximum(size[own, None], size)
        near = low >= threshold * high - 1e-9
        far = near & (low >= FEW)
        a, b = np.nonzero(far)
        near[a, b] = np.bitwise_count(prints[own][a] ^ prints[b]).sum(axis=1, dtype=np.int32) <= radius
        out[own] = near.sum(axis=1) > 1  # itself is one
    return out


def near_forest(sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links (indices) at or over the threshold that connect all that such pairs connect: a search from each set not
    yet reached, which compares with those that are left."""
    size = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    starts = np.concatenate(([0], np.cumsum(size)))
    by_shingle = np.argsort(flat, kind="stable")
    first = np.searchsorted(flat[by_shingle], np.arange(flat.max(initial=-1) + 2))
    owners = owner[by_shingle]  # posting lists: who holds shingle k is owners[first[k]:first[k + 1]]
    left, links = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed], queue = False, [seed]
        while queue and left.any():
            at = queue.pop()
            own = flat[starts[at] : starts[at + 1]]
            held = [owners[first[k] : first[k + 1]] for k in own.tolist()]
            common = np.bincount(np.concatenate(held), minlength=len(sets))
            hit = np.flatnonzero(left & (common >= threshold * (size + len(own) - common) - 1e-9))
            left[hit] = False
            links += [(at, x) for x in hit.tolist()]
            queue += hit.tolist()
    return links


def block_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links u > v within runs of equal (key, i, j); rows come sorted by them. A run may span batches."""
    run, nodes, sets = None, [], []

    def links() -> pa.RecordBatch:
        at = np.array(nodes, np.int64)
        found = np.array(near_forest(sets, threshold) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
        a, b = at[found[:, 0]], at[found[:, 1]]
        return pa.record_batch({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    for whole in batches:
        for batch in slices([whole]):
            for *key, node, raw in zip(*(batch.column(name).to_pylist() for name in ("key", "i", "j", "node", "hashes"))):
                if key != run:
                    if len(nodes) > 1:
                        yield links()
                    run, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, np.uint64))
    if len(nodes) > 1:
        yield links()


def with_node(docs: DataFrame) -> DataFrame:
    """whole (the row) and node, the hash of its words."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = [node_of(x or b"") for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "node"])

    plain = numbered_columns(docs)
    rows = plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("node", LongType())]))
    return rows.select(F.struct(*(F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns))).alias("whole"), "node")


def signatures(docs: DataFrame) -> DataFrame:
    """node, size (its shingles), its sketch, its band keys, its 64-bit SimHash (fp), and the row's order among copies, one
    row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            found = [shingles(x) for x in raws]
            columns = [pa.array([node_of(x) for x in raws], pa.int64()), pa.array(map(len, found), pa.int32()), pa.array(map(sketch, found), pa.binary()), pa.array(map(band_keys, found), pa.list_(pa.int64())), pa.array(np.array([simhash.fingerprint(x) for x in raws], np.uint64).view(np.int64))]
            yield pa.record_batch([*columns, *batch.columns[1:]], names=["node", "size", "sketch", "keys", "fp", *batch.schema.names[1:]])

    whole = docs.select(F.struct("*").alias("whole"))
    rows = whole.select(F.col("whole")["text"].cast("string").alias("text"), row_order(docs.schema, largest=False).alias("order")).select("text", "order.*")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"node long, size int, sketch binary, keys array<long>, fp long, no_id boolean, doc_id {kind}, hash long")


def with_simhash_keys(found: DataFrame, radius: int = 4) -> DataFrame:
    """Signatures with one more key: what the text's SimHash is connected with by links of fingerprints within the radius."""
    roots = written(components(simhash.near_links(found.select("fp").distinct(), radius)), "near-simhash")
    grouped = found.join(roots, found["fp"] == roots["node"], "left").drop(roots["node"])
    key = F.when(F.col("size") > 0, F.array(F.coalesce("root", "fp"))).otherwise(F.array().cast("array<long>"))
    return grouped.withColumn("keys", F.concat("keys", key)).drop("root")


def in_parts(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """keyed with i and j: rows of keys in `parts` (key, parts > 1) once for every pair that their part makes with another
    one of its key, others once."""
    part = keyed.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.coalesce("parts", F.lit(1))).cast("int"))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")))
    part = part.withColumn("other", F.explode(other))
    return part.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "part", "other")


def partners(found: DataFrame, most: int) -> DataFrame:
    """key, node of the texts that have another one near to them, by fingerprints, among those of a key."""
    keyed = written(found.dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node", "size", "sketch"), "near-keys")
    full = written(keyed.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("parts")), "near-full")
    dealt = in_parts(keyed, full) if full.head(1) else keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            at = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            cut = np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1
            last = int(cut[-1]) if len(cut) else 0
            rest = table.slice(last)
            if last:
                yield from near(table.slice(0, last), np.concatenate(([0], cut)))
        if rest is not None and rest.num_rows:
            yield from near(rest, np.array([0, rest.num_rows]))

    def near(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        prints = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
        size, hit = table.column("size").to_numpy(), np.zeros(table.num_rows, bool)
        for k in np.flatnonzero(np.diff(bounds) > 1):
            a, b = bounds[k], bounds[k + 1]
            hit[a:b] = partnered(prints[a:b], size[a:b])
        if hit.any():
            yield from table.select(["key", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()

    own = dealt.select("key", "i", "j", "node", "size", "sketch").mapInArrow(run, "key long, node long")
    return written(own.distinct(), "near-partners")


def blocks(keyed: DataFrame, most: int) -> DataFrame:
    """key, i, j, node: what is compared together. Keys that hold the same texts are dealt once."""
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    shared = shared.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    chosen = keyed.join(shared.select("key"), "key", "left_semi")
    return written(in_parts(chosen, shared.filter("parts > 1")).select("key", "i", "j", "node"), "near-blocks")


def near_links(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """Links u > v of nodes that connect all nodes which pairs at or over the threshold connect; `found` has the
    documents' signatures."""
    dealt = blocks(partners(found, most), most)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array([shingles(x).tobytes() for x in raws], pa.binary())], names=["node", "hashes"])

    nodes = written(dealt.select("node").distinct(), "near-nodes")
    nodes = F.broadcast(nodes) if nodes.count() <= SMALL else nodes  # else texts are dealt by node
    texts = with_node(docs.select(F.col("text").cast("string").alias("text"))).join(nodes, "node", "left_semi")
    sets = texts.groupBy("node").agg(F.first("whole.text").alias("text")).mapInArrow(hashes, "node long, hashes binary")
    together = dealt.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return together.select("key", "i", "j", "node", "hashes").mapInArrow(lambda batches: block_links(batches, threshold), "u long, v long").distinct()


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """Of each component of near copies, the row with the smallest doc_id (null last); whole rows, whatever their columns
    are called.

    Null and empty texts, and texts of white space only, are copies of each other. Of rows that repeat an id within a
    component, one stays; texts of any length are compared by all their shingles. An empty table gives an empty result.
    """
    found = written(signatures(docs), "near-signatures")
    roots = written(components(near_links(docs, with_simhash_keys(found), threshold, most)), "near-roots")
    # Small rows decide which node of a component stays; whole rows move once, to be folded by node.
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    first = found.groupBy("node").agg(F.min(F.struct("no_id", "doc_id", "hash")).alias("order"))
    member = written(member.join(first, "node"), "near-members")
    stays = member.groupBy("root").agg(F.min_by("node", "order").alias("stays"))
    gone = looked_up(member.select("node", "root"), stays.join(member.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root"), "root", member.count()).filter("node <> stays")
    kept = with_node(docs).groupBy("node").agg(kept_row(docs.schema, largest=False).alias("whole"))
    return kept.join(gone.select("node"), "node", "left_anti").select("whole.*")
