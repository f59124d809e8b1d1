"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

1. Hashes of the texts (A-Z lower-cased) are counted by their first `max_depth` bits. The directory starts with one
   bucket and doubles until no bucket holds more than `capacity` rows, or its bits are used up; what is then still
   overfull (copies of one text share all bits) is a chain, which is dealt to as many parts as its rows ask for.
2. Whole rows are dealt once, by the bucket and part that the directory names: buckets lie in order along the tasks, each
   task taking an equal share of the bytes. There are as many tasks as the bytes ask for, up to a bound; what a task holds
   beyond its memory it sorts on disk. Owner tasks fold what they own by hash and bytes: texts that collide in their hash
   stay apart. Parts of a chain are folded again, one row for each part.
3. The index (one small row for each text: bucket, hash, digest, the id to keep, the number of rows) is written to the
   shared folder, in ranges of buckets.
4. Documents ask the directory for their bucket and look their entry up there by hash and digest; only ids and digests
   move. Entries of many rows are broadcast, so that no task holds all copies of a hot text.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oculith.llm.shared import ascii_lower, kept_row, looked_up, written

#: Rows of a bucket before it is split, and bits of the hash that the directory can use.
CAPACITY, MAX_DEPTH = 4096, 16
#: Bytes of text that a task is dealt, about, and the most tasks.
SHARE, TASKS = 8 << 20, 20_000


def double_directory(histogram: dict[int, int], bits: int, capacity: int) -> list[tuple[int, int, int]]:
    """(slot, bucket, rows of the bucket) for all slots of the directory, given counts by the first `bits` bits.

    Starts with one bucket and splits any overfull one by its next bit; the directory doubles when a bucket is split
    whose depth equals the directory's.
    """
    below = list(accumulate((histogram.get(k, 0) for k in range(1 << bits)), initial=0))  # counts before each slot
    depth, full, split = 0, [(0, 0)], {}
    while full:
        again = []
        for prefix, local in full:
            first, last = prefix << (bits - local), (prefix + 1) << (bits - local)
            held = below[last] - below[first]
            if held > capacity and local < bits:
                depth = max(depth, local + 1)
                again += [(prefix << 1, local + 1), (prefix << 1 | 1, local + 1)]
            else:
                split[first] = held
        full = again
    slots, bucket, held = [], -1, 0
    for slot in range(1 << depth):
        if (first := slot << (bits - depth)) in split:
            bucket, held = bucket + 1, split[first]
        slots.append((slot, bucket, held))
    return slots


def normal(text: Column) -> Column:
    """The text that is compared: A-Z lower-cased, null as empty."""
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def slot_of(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


class Directory:
    """Which bucket, which part of it, and which task a row belongs to; at most 2**max_depth slots."""

    def __init__(self, docs: DataFrame, capacity: int, max_depth: int, share: int = SHARE, tasks: int = TASKS):
        size = F.sum(F.octet_length(normal(F.col("text"))) + 64).alias("bytes")  # a row is more than its text
        found = docs.groupBy(slot_of(F.xxhash64(normal(F.col("text"))), max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("rows"), size).collect()  # 2**max_depth rows at most
        slots = double_directory({r["slot"]: r["rows"] for r in found}, max_depth, capacity)
        self.depth, self.buckets = len(slots).bit_length() - 1, slots[-1][1] + 1
        held = [0] * self.buckets
        for r in found:
            held[slots[r["slot"] >> (max_depth - self.depth)][1]] += r["bytes"]
        before = list(accumulate(held, initial=0))
        parts = sum({b: self.split(n, capacity) for _, b, n in slots}.values())
        self.tasks = max(1, min(tasks, parts, -(-before[-1] // share)))
        wide = self.tasks / max(1, before[-1])
        rows = [(s, b, self.split(n, capacity), before[b] * wide, held[b] * wide) for s, b, n in slots]
        self.chains = max(parts for _, _, parts, *_ in rows) > 1
        self.table = docs.sparkSession.createDataFrame(rows, "slot long, bucket int, parts int, first double, wide double")

    @staticmethod
    def split(rows: int, capacity: int) -> int:
        return max(1, -(-rows // capacity))

    def find(self, rows: DataFrame) -> DataFrame:
        """rows with `bucket`, `parts`, and where the bucket lies along the tasks (`first`, `wide`), by column h."""
        return rows.withColumn("slot", slot_of(F.col("h"), self.depth)).join(F.broadcast(self.table), "slot").drop("slot")

    def deal(self, rows: DataFrame) -> DataFrame:
        """rows at their owners, with bucket, part and task. In a chain, rows of the same text go to any of its parts, by id.
        A part belongs to the task that its middle lies in."""
        part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(0)
        middle = F.col("first") + (F.col("part") + 0.5) * F.col("wide") / F.col("parts")
        task = F.least(F.floor(middle).cast("int"), F.lit(self.tasks - 1))
        return rows.withColumn("part", part.cast("int")).withColumn("task", task).drop("first", "wide").repartitionById(self.tasks, "task")


def folded(rows: DataFrame, text: Column, directory: Directory, first: dict[str, Column], again: dict[str, Column]) -> DataFrame:
    """bucket, h, norm and the aggregates of each different text, folded by the owners of its bucket. Only what chains
    leave, one row a text and part, is dealt and folded a second time."""
    rows = directory.find(rows)
    fold = lambda some: directory.deal(some).withColumn("norm", normal(text)).groupBy("task", "bucket", "part", "h", "norm").agg(*[c.alias(k) for k, c in first.items()]).drop("task", "part")
    if not directory.chains:
        return fold(rows)
    return fold(rows.filter("parts = 1")).unionByName(fold(rows.filter("parts > 1")).groupBy("bucket", "h", "norm").agg(*[c.alias(k) for k, c in again.items()]))


def build_index(docs: DataFrame, directory: Directory) -> DataFrame:
    """The index on shared files: bucket, h, text_sha256, keep_id, group_size; one row for each different text."""
    rows = docs.select("doc_id", "text", F.xxhash64(normal(F.col("text"))).alias("h"))
    first = {"keep_id": F.max("doc_id"), "group_size": F.count(F.lit(1))}
    entries = folded(rows, F.col("text"), directory, first, {"keep_id": F.max("keep_id"), "group_size": F.sum("group_size")})
    entries = written(entries.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-entries")
    return written(entries.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Of equal texts the row with the largest doc_id stays. Null text is empty; empty texts are equal to each other.
    Rows that repeat a doc_id count in group_size and share `kept`. A null doc_id loses to any other; a group of null
    ids only has a null keep_id and is kept. Texts of any length are compared whole, as one value of a row. Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    directory = Directory(docs, capacity, max_depth)
    index = build_index(docs, directory)
    norm = normal(F.col("text"))
    probe = directory.find(docs.select("doc_id", F.xxhash64(norm).alias("h"), F.sha2(norm, 256).alias("text_sha256")))
    probe = written(probe.select("doc_id", F.struct("bucket", "h", "text_sha256").alias("entry")), "exact-probe")
    index = index.select(F.struct("bucket", "h", "text_sha256").alias("entry"), "keep_id", "group_size", F.col("group_size").alias("n"))
    found = looked_up(probe, index, "entry", probe.count())
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "entry.text_sha256", "entry.bucket")


def keep_distinct(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Of each set of equal texts one row, that with the largest doc_id; whole rows, whatever their columns are called.

    Dealt and folded like the index, with rows in place of ids, so that nothing is joined back. A null doc_id loses to
    any other; of rows that repeat an id and a text, one stays; rows that share only their id are told apart. Null text
    is empty. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("whole"))
    text, doc_id = F.col("whole")["text"], F.col("whole")["doc_id"]
    rows = rows.select("whole", doc_id.alias("doc_id"), F.xxhash64(normal(text)).alias("h"))
    best = kept_row(docs.schema, largest=True)
    return folded(rows, text, Directory(docs, capacity, max_depth), {"whole": best}, {"whole": best}).select("whole.*")
