"""Phrase collocations by Toivonen's method: a sample proposes, full passes count exactly, failures widen the count.

A bounded sample of documents proposes phrases. What a full pass counts is the proposed phrases and their negative border:
phrases that weren't proposed, but all of whose parts were (of single words, all). Where the border holds phrases that turn
out frequent, their extensions may be frequent too, so a further pass counts what has become possible; this ends when a
pass finds no new frequent phrase that could be extended. A phrase is counted by one pass and wholly there, so counts are
exact whatever the sample was.

The sets that decide what a pass counts are Bloom filters of a fixed size: they never miss a phrase, and what they let
through by mistake is only counted in vain. Tasks count word numbers in whole arrays, not strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from oculith.llm.shared import texts, written

SUPPORT, LONGEST, COVERED, BEST = 10, 3, 50, 2000
#: Bytes of text in the sample (by a hash of the rows), bytes of text that a task counts at a time, bits of a filter.
SAMPLE_BYTES, CHUNK, BITS = 32 << 20, 2 << 20, 1 << 26
#: A-Z become lower case, and what ends a piece a full stop, which no word can hold.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
STOP = b"."
NONE = "und"


class Filter:
    """A set of 64-bit hashes as a Bloom filter with two probes."""

    def __init__(self, words: np.ndarray | None = None):
        self.words = np.zeros(BITS >> 6, np.uint64) if words is None else words

    @staticmethod
    def probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
        yield hashes & np.uint64(BITS - 1)
        yield (hashes >> np.uint64(32)) & np.uint64(BITS - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.probes(hashes):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @staticmethod
    def of(phrases: DataFrame) -> Filter:
        """A filter of the rows' phrases of one or two words; its words are put together by Spark."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                split = [(lang, *phrase.split(b" ")) for lang, phrase in zip(texts(batch, "lang"), texts(batch, "phrase"))]
                one = np.array([word_hash(x[0], x[1]) for x in split], np.uint64)
                if split and len(split[0]) > 2:
                    one = pair_hash(one, np.array([word_hash(x[0], x[2]) for x in split], np.uint64))
                at = np.concatenate(list(Filter.probes(one))).astype(np.int64)
                yield pa.record_batch({"word": pa.array(at >> 6), "bits": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))})

        bits = phrases.select("lang", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        found = bits.toArrow()  # as many rows as the filter has words, at most
        words = np.zeros(BITS >> 6, np.uint64)
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return Filter(words)


def word_hash(lang: bytes, word: bytes) -> int:
    return xxh64_intdigest(b"%b\x00%b" % (lang, word))


def pair_hash(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hash of two words in a row, from theirs."""
    out = one * np.uint64(0x9E3779B97F4A7C15) + two
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ out >> np.uint64(32)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    """lang and joined texts, about CHUNK bytes at a time; a text is never cut."""
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for lang, text in zip(texts(part, "lang"), texts(part)):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
            while sum(sizes.values()) >= CHUNK:
                lang = max(sizes, key=sizes.get)
                yield lang, STOP.join(held.pop(lang))
                del sizes[lang]
    for lang, own in held.items():
        yield lang, STOP.join(own)


def grams(blob: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the blob's words as numbers, and where each lies within its piece (0 before a piece's first word)."""
    tokens = pa.array(blob.translate(PIECES).replace(STOP, b" . ").split(), pa.binary()).dictionary_encode()
    words, codes = tokens.dictionary, tokens.indices.to_numpy()
    stop = pc.index(words, pa.scalar(STOP, pa.binary())).as_py()
    codes = np.where(codes == stop, -1, codes)
    at = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes < 0, at, -1))
    return words, codes, at - last


class Counted:
    """Distinct phrases of one length: how often each stands there, the first place of each among the occurrences given,
    and the phrase's number at every occurrence."""

    def __init__(self, words: int, parts: np.ndarray):
        """words: how many distinct words there are; parts: a row for each occurrence, with the numbers of its words."""
        key = parts[:, 0].astype(np.int64)
        for k in range(1, parts.shape[1]):
            if k > 1:  # numbers of pairs, so that three words fit in 64 bits
                _, key = np.unique(key, return_inverse=True)
            key = key * words + parts[:, k]
        _, self.first, self.number, self.n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.parts = parts[self.first]

    def phrases(self, words: pa.Array, which: np.ndarray) -> pa.Array:
        columns = [words.take(pa.array(c)) for c in self.parts[which].T]
        return pc.binary_join_element_wise(*columns, b" ") if len(columns) > 1 else columns[0]


def first_pass(hits: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first pass whose set holds both parts of a phrase; the number of passes where none does."""
    out = np.full(len(one), len(hits))
    for k in reversed(range(len(hits))):
        out[hits[k][one] & hits[k][two]] = k
    return out


#: What a pass counts: phrases whose parts lie in its sets of words and of pairs. None holds all.
Pass = tuple["Filter | None", "Filter | None"]


def counts_of(lang: bytes, blob: bytes, passes: list[Pass], longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Length, phrases and counts of what the last pass counts in a blob; in the first pass, words too. Length 0 has the
    number of all words."""
    words, codes, place = grams(blob)
    last, at = len(passes) - 1, np.flatnonzero(codes >= 0)
    if not len(at):
        return
    hashes = np.array([word_hash(lang, w) for w in words.to_pylist()], np.uint64)
    found = Counted(len(words), codes[at][:, None])
    if last == 0:
        yield 0, pa.array([b""], pa.binary()), np.array([len(at)])
        yield 1, found.phrases(words, slice(None)), found.n
    due, own_hashes = np.zeros(len(found.n), int), hashes[found.parts[:, 0]]
    for level in range(2, longest + 1):
        # A phrase is of a pass's set only from the pass on that counted it, so that every pass draws the same lines.
        hits = [np.ones(len(due), bool) if own[level - 2] is None else own[level - 2].holds(own_hashes) & (due <= k) for k, own in enumerate(passes)]
        number = np.full(len(codes) + 1, -1)
        number[at] = found.number
        at = np.flatnonzero(place >= level) - (level - 1)
        at = at[(number[at] >= 0) & (number[at + 1] >= 0)]
        due = first_pass(hits, number[at], number[at + 1])
        keep = due == last if level == longest else due <= last
        at, due = at[keep], due[keep]
        if not len(at):
            return
        found = Counted(len(words), np.stack([codes[at + k] for k in range(level)], axis=1))
        due = due[found.first]
        if level < longest:
            own_hashes = pair_hash(hashes[found.parts[:, 0]], hashes[found.parts[:, 1]])
        yield level, found.phrases(words, due == last), found.n[due == last]


def count(docs: DataFrame, passes: list[Pass], longest: int = LONGEST) -> DataFrame:
    """lang, words (number of the phrase's), phrase, n of what the last of the passes counts."""
    shared = docs.sparkSession.sparkContext.broadcast([[f and f.words for f in own] for own in passes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [tuple(f if f is None else Filter(f) for f in pair) for pair in shared.value]
        for lang, blob in chunks(batches):
            for level, phrases, n in counts_of(lang, blob, own, longest):
                for at in range(0, len(n), 100_000):
                    some = phrases.slice(at, 100_000)
                    yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.binary()), "words": pa.array(np.full(len(some), level, np.int32)), "phrase": some, "n": pa.array(n[at : at + 100_000])})

    rows = docs.mapInArrow(run, "lang binary, words int, phrase binary, n long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).withColumn("lang", F.col("lang").cast("string"))


def part(phrase: Column, low: Column, high: Column) -> Column:
    """Words low to high (from 0, the last excluded) of a phrase; words hold no blanks."""
    return F.array_join(F.slice(F.split(phrase, " "), low + 1, high - low), " ")


def frequent(docs: DataFrame, support: int = SUPPORT, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """lang, words, phrase (bytes), n of every phrase of 1 to 3 words with n >= support; words = 0: all words of a lang."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(0.25, sample_bytes / max(1, size))
    sample = rows.filter(F.xxhash64("doc_id", "text").cast("double") <= share * 2.0**64 - 2.0**63)
    least = max(1, int(share * support / 2))  # lower than the share of the support, so that few phrases escape the sample
    proposed = written(count(sample, [(None, None)], 2).filter(F.col("n") >= least), "collocation-sample")
    sets = [proposed.filter(F.col("words") == k) for k in (1, 2)]
    passes, frequent_ = [(Filter.of(sets[0]), Filter.of(sets[1]))], (F.col("words") == 0) | (F.col("n") >= support)
    found = written(count(rows, passes).filter(frequent_), "collocation-counts")
    for _ in range(1, LONGEST):  # phrases can only come up once their parts have: a pass for each further length at most
        # The border's failures: frequent phrases that no pass has let extensions of through.
        missed = [found.filter(F.col("words") == k).join(sets[k - 1].select("lang", "phrase"), ["lang", "phrase"], "left_anti") for k in (1, 2)]
        if not any(m.limit(1).count() for m in missed):
            break
        sets = [found.filter(F.col("words") == k) for k in (1, 2)]
        passes = [*passes, (Filter.of(sets[0]), Filter.of(sets[1]))]
        found = found.unionByName(written(count(rows, passes).filter(frequent_), "collocation-counts"))
    return found


def collocations(docs: DataFrame, support: int = SUPPORT, best: int = BEST, covered: int = COVERED, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The best phrases of 2 to 3 words of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its two parts at the cut with the lowest score floor(10^6 a a / (l r)), n the
    words of the language. Phrases inside a longer candidate with at least `covered` percent of their count are left out.
    Ranked by score, a, phrase (bytes). Null texts are empty, a null lang is `und`; other columns and ids are ignored,
    repeated rows count each. A text is counted whole, in one task. An empty table gives no rows.
    """
    found = frequent(docs, support, sample_bytes).withColumn("phrase", F.col("phrase").cast("string"))
    total = found.filter("words = 0").select("lang", "n")
    known = found.filter("words > 0").select("lang", "words", "phrase", F.col("n").alias("a"))
    longer = known.filter(F.col("words") == LONGEST)
    inside = longer.select("lang", F.explode(F.array_distinct(F.array(part(F.col("phrase"), F.lit(0), F.lit(2)), part(F.col("phrase"), F.lit(1), F.lit(3))))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    cuts = F.when(F.col("words") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    cut = known.filter("words > 1").join(inside, ["lang", "phrase"], "left").filter(f"words = {LONGEST} or over is null or 100 * over < {covered} * a").select("lang", "words", "phrase", "a", F.explode(cuts).alias("k"))
    cut = cut.withColumns({"first": part(F.col("phrase"), F.lit(0), F.col("k")), "rest": part(F.col("phrase"), F.col("k"), F.col("words"))})
    sides = known.filter(F.col("words") < LONGEST)
    for name, count_of in (("first", "l"), ("rest", "r")):
        cut = cut.join(sides.select("lang", F.col("phrase").alias(name), F.col("a").alias(count_of)), ["lang", name])
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cut = cut.withColumn("_square", (exact("a") * exact("a")).cast("decimal(31,0)")).withColumn("_sides", (exact("l") * exact("r")).cast("decimal(31,0)"))
    cut = cut.withColumn("score", F.expr("cast(_square * cast(1000000 as decimal(7,0)) as decimal(38,0)) div cast(_sides as decimal(38,0))"))
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language's phrases, so that no task ranks all of them.
    lowest = lowest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).filter(F.col("rank") <= best)
    lowest = lowest.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= best)
    return lowest.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
