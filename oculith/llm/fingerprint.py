"""Document fingerprints from statistically improbable features.

Every 64-byte window of a text has a Shannon entropy; windows whose entropy is rare in prose (by a fixed table of measured
frequencies) are improbable. In each neighbourhood of 64 windows the rarest (leftmost on ties) scores a point, and windows
with enough points are the text's features. Texts under 512 bytes, which have few of them, carry all their windows of 12
bytes beside them, as features of their own kind. Features of a kind go in order into chained Bloom filters of 2,048 bits.
Two fingerprints are compared by the shorter kind where both have it, else by the longer, so that a length on one side of
a bound and a length on the other are compared alike. Filter by filter: the overlap beyond chance, as a share of what it
could be, of the best partner, averaged by features.

Fingerprints depend on the text alone, so they can be compared across tables.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from oculith.llm.shared import whole_text

WINDOW, NEIGHBOURS, POINTS = 64, 64, 16
BITS, HASHES, CAPACITY = 2048, 5, 128
#: Texts of fewer bytes than BRIEF have windows of SHORT bytes beside those of WINDOW.
BRIEF, SHORT = 8 * WINDOW, 12
#: Bytes of texts that are worked on together.
TOGETHER = 1 << 19
#: n log2 n in fixed point, so that sliding sums are exact.
NLOGN = np.array([0, *(round(n * np.log2(n) * 65536) for n in range(1, WINDOW + 2))], np.int64)
GAIN = np.diff(NLOGN)
#: Bytes of texts that one range of documents holds, about, and the most ranges: a task streams its range, which may be
#: larger.
RANGE, RANGES = 1 << 24, 16_384
#: How many windows of each entropy level (64 steps from 0 to 6 bits) were counted in 4.4 million windows of
#: prose in four languages. A window is the rarer the fewer windows have its level.
LEVELS = (
    0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 886, 0, 2, 3, 4, 3258,
    326, 4980, 92, 515, 2671, 11629, 828, 1853, 14003, 1329, 4446, 14720, 2893, 21445, 3659, 20074,
    12521, 24025, 44966, 125934, 264847, 430208, 547845, 576158, 547706, 474048, 354318, 205902, 87997, 27914, 6740, 1363,
    294, 72, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
)
#: Rank of each level by its count (0: rarest); levels counted alike share a rank.
RANK = np.searchsorted(np.sort(LEVELS), LEVELS).astype(np.int64)


def ranks(data: np.ndarray) -> np.ndarray:
    """Rarity rank (low: rare) of the window that ends at each byte, from WINDOW - 1 on.

    The entropy follows from how often each byte occurs among the 63 before and after it, which 63 shifted comparisons
    count for all positions at once.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    change = GAIN[before].copy()
    change[WINDOW:] -= GAIN[after[:-WINDOW]]
    entropy = 6 - np.cumsum(change)[WINDOW - 1 :] / (65536 * WINDOW)
    level = np.rint(entropy * (63 / 6)).astype(np.int64)
    return RANK[level]


def features(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Starts of the selected windows of each text; texts lie one after the other in `data`, from bounds[i] to bounds[i + 1]."""
    if len(data) < WINDOW:
        return [np.zeros(0, np.int64)] * (len(bounds) - 1)
    rank = ranks(data)
    key = rank << 40 | np.arange(len(rank))
    width = 1
    while width < NEIGHBOURS and len(key) > width:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    chosen = key & ((1 << 40) - 1)
    out = []
    for a, b in pairwise(bounds.tolist()):
        windows = b - a - WINDOW + 1
        if windows <= 0:
            out.append(np.zeros(0, np.int64))
        elif windows < NEIGHBOURS:
            out.append(np.array([a + int(np.argmin(rank[a : a + windows]))]))
        else:
            at, n = np.unique(chosen[a : a + windows - NEIGHBOURS + 1], return_counts=True)
            out.append(at[n >= min(POINTS, windows - NEIGHBOURS + 1)] if (n >= POINTS).any() else at[[np.argmax(n)]])
    return out


class Print(NamedTuple):
    """Bloom filters (rows of BITS / 8 bytes) of the two kinds of features; an empty text has none."""

    short: np.ndarray
    long: np.ndarray


def short_windows(raw: bytes) -> list[bytes]:
    """The different windows of SHORT bytes in order; the text itself if it is shorter."""
    return list(dict.fromkeys(raw[a : a + SHORT] for a in range(max(1, len(raw) - SHORT + 1)))) if raw else []


def filled(features: list[list[bytes]]) -> list[np.ndarray]:
    """Chains of Bloom filters, CAPACITY features each, for each list of features."""
    filters = np.concatenate(([0], np.cumsum([-(-len(own) // CAPACITY) for own in features]))).astype(np.int64)
    bits = np.zeros((filters[-1], BITS), bool)
    hashed = b"".join(xxhash.xxh3_128_digest(x) for own in features for x in own)
    if hashed:
        value = np.frombuffer(hashed, "<u2").reshape(-1, 8)[:, :HASHES] % BITS
        at = np.concatenate([first + np.arange(len(own)) // CAPACITY for first, own in zip(filters.tolist(), features)])
        bits[np.repeat(at, HASHES), value.reshape(-1)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[a:b] for a, b in pairwise(filters.tolist())]


def digests(raws: list[bytes]) -> list[Print]:
    """The fingerprint of each text."""
    out, lo = [], 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) <= TOGETHER):
            size += len(raws[hi])
            hi += 1
        joined = b"".join(raws[lo:hi])
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in raws[lo:hi]])))
        starts = features(np.frombuffer(joined, np.uint8), bounds)
        short = filled([short_windows(x) if len(x) < BRIEF else [] for x in raws[lo:hi]])
        long = filled([list(dict.fromkeys(joined[a : a + WINDOW] for a in at.tolist())) for at in starts])
        out += map(Print, short, long)
        lo = hi
    return out


def likeness(a: Print, b: Print) -> float:
    """From 0 to 1, by the shorter kind of features that both have. Two empty texts are alike; an empty one and another, or
    two that share no kind (one under WINDOW bytes, one of BRIEF or more), aren't."""
    if len(a.short) and len(b.short):
        return overlap(a.short, b.short)
    if len(a.long) and len(b.long):
        return overlap(a.long, b.long)
    return float(not any(map(len, (*a, *b))))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """For each filter of the shorter chain, the best overlap beyond chance; averaged by filled bits."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(axis=1).astype(float), np.bitwise_count(y).sum(axis=1).astype(float)
    best = np.zeros(len(x))
    for lo in range(0, len(y), 64):
        own = ny[lo : lo + 64]
        for i in range(len(x)):
            shared = np.bitwise_count(x[i] & y[lo : lo + 64]).sum(axis=1)
            chance, most = nx[i] * own / BITS, np.minimum(nx[i], own)
            best[i] = max(best[i], float(((shared - chance) / np.maximum(most - chance, 1e-9)).max()))
    return float(np.clip((best * nx).sum() / max(nx.sum(), 1), 0, 1))


def encode(own: Print) -> str:
    """Base64 of the number of filters of the short kind (one byte), these, and the others; empty without any."""
    if not any(map(len, own)):
        return ""
    return base64.b64encode(bytes([len(own.short)]) + own.short.tobytes() + own.long.tobytes()).decode()


def decode(text: str) -> Print:
    raw = base64.b64decode(text)
    filters = np.frombuffer(raw[1:], np.uint8).reshape(-1, BITS // 8)
    return Print(filters[: raw[0]], filters[raw[0] :]) if raw else Print(filters, filters)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each whole text; null and empty texts have the empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                raws = [(x or "").encode("utf-8", "replace") for x in own.column("text").to_pylist()]
                yield pa.record_batch([own.column("doc_id"), pa.array(map(encode, digests(raws)), pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def place(cuts: list[float], value: Column, step: int = 128) -> Column:
    """Number of the descending `cuts` that lie above the value: coarse steps first, so that many cuts cost little."""
    above = lambda some: F.size(F.filter(some, lambda c: c > value))
    if len(cuts) <= step:
        return above(F.array(*map(F.lit, cuts))) if cuts else F.lit(0)
    return F.when(value.isNull(), len(cuts)).otherwise((coarse := above(F.array(*map(F.lit, cuts[step - 1 :: step]))) * step) + above(F.slice(F.array(*map(F.lit, cuts)), coarse + 1, step)))


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """part, tail, doc_id, text: documents dealt by ranges of doc_id; `tail` marks a copy of the document that follows
    a range's last one, so that each range has all it needs. In a part: doc_id descending, the tail last. All rows that
    repeat an id are in one part, sorted on disk and streamed.

    Only range bounds and the largest id of each range (at most `ranges` of each) come to the driver.
    """
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)), reverse=True) if ranges > 1 else []
    part = place(cuts, F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))  # 0 holds the largest ids
    rows = docs.select("doc_id", F.coalesce(whole_text(), F.lit("")).alias("text"), part.alias("part"))
    heads = rows.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    spark = docs.sparkSession
    if not heads:
        return rows.select("part", F.lit(False).alias("tail"), "doc_id", "text")
    parts = [r["part"] for r in heads]
    before = dict(zip(parts, parts[-1:] + parts[:-1]))
    table = spark.createDataFrame([(r["part"], r["head"], before[r["part"]]) for r in heads], f"part int, head {docs.schema['doc_id'].dataType.simpleString()}, before int")
    own, copy = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(True).alias("tail"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.join(F.broadcast(table), "part", "left").select(F.explode(copies).alias("to"), "doc_id", "text").select("to.part", "to.tail", "doc_id", "text")
    return dealt.repartitionByRange(len(parts), "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "text")


def fingerprint_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the code points (rounded down) replaced by the first as many, or all, of the
    next document in descending doc_id; after the last comes the first. Null text is empty; a single document follows
    itself; repeated ids stand in order of their texts; a null id comes last. Other columns are ignored; an empty table
    gives no rows. Ids must be numbers. Bytes that aren't UTF-8 count as U+FFFD. Texts of any length are worked on whole; two texts of n and m filters (128
    features each) take n x m comparisons of filters.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not isinstance(docs.schema["doc_id"].dataType, NumericType):
        raise ValueError(f"doc_id must be a number, not {kind}")
    docs = docs.select("doc_id", "text")
    if not ranges:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        ranges = min(RANGES, max(1, -(-size // RANGE)))

    def rows_of(pairs: list[tuple]) -> pa.RecordBatch:
        texts = [t for _, t, _ in pairs]
        edited = []
        for _, text, following in pairs:
            n = len(text) // 3
            edited.append((text[: len(text) - n] + following[:n]).encode("utf-8", "replace"))
        raws = [t.encode("utf-8", "replace") for t in [*texts, pairs[-1][2]]]
        own = digests([*raws, *edited])
        first, second = own[: len(raws)], own[len(raws) :]
        columns = {
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in edited],
            "fingerprint": list(map(encode, first[:-1])),
            "edited_fingerprint": list(map(encode, second)),
            "near_edited": [likeness(a, b) for a, b in zip(first, second)],
            "near_next": [likeness(a, b) for a, b in pairwise(first)],
        }
        return pa.record_batch([pa.array([p[0] for p in pairs], own_kind[0]), *map(pa.array, columns.values())], names=["doc_id", *columns])

    own_kind: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, pairs, size = None, [], 0
        for batch in batches:
            own_kind[:] = [batch.column("doc_id").type]
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for p, tail, doc, text in zip(*[part.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")]):
                    if waiting and waiting[0] == p and not waiting[1]:
                        pairs.append((waiting[2], waiting[3], text))
                        size += len(text)
                        if size >= TOGETHER:
                            yield rows_of(pairs)
                            pairs, size = [], 0
                    elif pairs:
                        yield rows_of(pairs)
                        pairs, size = [], 0
                    waiting = (p, tail, doc, text)
        if pairs:
            yield rows_of(pairs)

    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, ranges).mapInArrow(run, out)
