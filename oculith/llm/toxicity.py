"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Folding: compatibility forms and full-width letters, homoglyphs of other scripts, and digits or signs that stand for
letters inside words. The lexicon is learned from labelled training documents: beginnings of words (and whole words)
whose odds in toxic documents are high enough, each weighted by its log odds; a longer entry is dropped where a
shorter one already carries its weight. Matches inside exception phrases don't count. The score falls with length.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oculith.llm.shared import crc_fold, slices, whole_text, written

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Letters of a stem (whole words have any number), least number of toxic documents with an entry, least log odds.
SHORTEST, LONGEST, SUPPORT, ODDS = 4, 12, 3, 2.5
#: Bound of the labelled sample (by hash order of ids); entries and calibration come from these documents alone.
LABELLED = 20_000
#: What stands for which letter, and harmless phrases around harsh words.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏбкмнтвαοερντικυχ", "aeopcyxijsdhlbkmhtbaoepvtikux"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "scum line", "pond scum", "stupid simple", "worthless cheque", "sore loser")
DISGUISED = regex.compile(r"(?<=\p{L})[0134578@$!9]+(?=\p{L})|(?<![\p{L}\p{N}$@!])[0134578@$9]+(?=\p{L}[\p{L}0134578@$])|(?<=\p{L}{2})[013457@$](?![\p{L}\p{N}$@!#%&*])")
WORD = regex.compile(r"\p{L}+")
GLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None, 0xFEFF: None}
LETTERS = {ord(k): v for k, v in SIGNS.items()}


def fold(text: str) -> str:
    """Lower case, without disguises; words keep their order."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower()
        if SCRIPTS.search(text):
            text = text.translate(GLYPHS)
    else:
        text = text.lower()
    return DISGUISED.sub(lambda m: m[0].translate(LETTERS), text)


SCRIPTS = regex.compile("[" + "".join(map(chr, GLYPHS)) + "]")


def beginnings(text: str) -> set[str]:
    """Whole words of the text (with a closing blank) of any length, and their stems of SHORTEST to LONGEST letters."""
    out = set()
    for word in set(WORD.findall(fold(text))):
        out.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
        out.add(word + " ")
    return out


def weight(bad: float, good: float, n_bad: int, n_good: int) -> float:
    return log((bad + 0.25) / (n_bad + 0.5)) - log((good + 0.25) / (n_good + 0.5))


def choose(found: list[tuple[str, int, int]], n_bad: int, n_good: int) -> dict[str, tuple[int, int]]:
    """Entries (toxic, clean documents) without those that a longer entry nearly covers, and without longer ones that
    say no more than a shorter one."""
    counts = {e: (b, g) for e, b, g in found}
    covered = {e[:k] for e, (b, _) in counts.items() for k in range(SHORTEST, len(e)) if e[:k] in counts and b >= 0.8 * counts[e[:k]][0]}
    lexicon: dict[str, tuple[int, int]] = {}
    for e in sorted(counts.keys() - covered, key=lambda e: (len(e), e)):
        own = weight(*counts[e], n_bad, n_good)
        if all(e[:k] not in lexicon or weight(*lexicon[e[:k]], n_bad, n_good) < own - 0.5 for k in range(SHORTEST, len(e))):
            lexicon[e] = counts[e]
    return lexicon


class Scorer:
    """Matches a lexicon and turns what it finds into a probability by a logistic curve over five measures."""

    def __init__(self, lexicon: dict[str, tuple[int, int]], n_bad: int, n_good: int, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.n_bad, self.n_good, self.lexicon = n_bad, n_good, lexicon
        self.curve = np.array([log((n_bad + 0.5) / (n_good + 0.5)) - 2, 0.5, 1.0, 0.0, 0.0])
        self.exceptions = exceptions
        self._build()

    def _build(self) -> None:
        self.patterns = ahocorasick.Automaton()
        for entry in self.lexicon:
            self.patterns.add_word(" " + entry, entry)
        for phrase in self.exceptions:
            self.patterns.add_word(f" {phrase} ", (len(phrase) + 2,))
        self.patterns.make_automaton()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "patterns"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._build()

    def measures(self, text: str | None, label: int | None = None) -> np.ndarray:
        """1, the heaviest entry, how many different words match, how many matches there are, all against length.

        With a label the text's own count is taken out of the weights, as if it hadn't been learned from.
        """
        if not text:
            return np.array([1.0, 0, 0, 0, 0])
        words = WORD.findall(fold(text))
        joined = f" {' '.join(words)} "
        at: dict[int, tuple[float, str]] = {}
        safe: list[tuple[int, int]] = []
        for end, entry in self.patterns.iter(joined):
            if isinstance(entry, tuple):
                safe.append((end - entry[0] + 1, end))
                continue
            bad, good = self.lexicon[entry]
            own = weight(bad - (label == 1), good - (label == 0), self.n_bad, self.n_good)
            start = end - len(entry)
            at[start] = max(at.get(start, (0.0, "")), (own, joined[start + 1 : joined.index(" ", start + 1)]))
        hits = list(at.values())
        if safe:
            reach, begins = list(accumulate((b for _, b in sorted(safe)), max)), [a for a, _ in sorted(safe)]
            hits = [x for start, x in at.items() if (k := bisect_right(begins, start)) == 0 or reach[k - 1] <= start]
        if not hits:
            return np.array([1.0, 0, 0, 0, 0])
        best = dict((word, own) for own, word in hits)
        total = sum(best.values())
        return np.array([1.0, max(best.values()), log1p(total), log1p(len(hits)), log((total + 1) / (len(words) + 50))])

    def __call__(self, text: str | None) -> float:
        return 1 / (1 + exp(-float(np.clip(self.measures(text) @ self.curve, -30, 30))))

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> None:
        """Fits the curve by Newton steps."""
        if len(np.unique(y)) < 2:
            return
        curve = self.curve.copy()
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            slope = x.T @ (y - p) - ridge * curve
            curve = curve + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(curve)), slope)
            if np.abs(slope).max() < 1e-6:
                break
        if np.isfinite(curve).all():
            self.curve = curve


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED) -> Scorer:
    """Lexicon and curve from training folds; `labelled` documents are learned from, by a bound of their ids' hash. Of
    rows that repeat an id, one text counts; copies of a text with the same label count once, as they add no evidence."""
    order = F.xxhash64("doc_id")
    train = labels.filter((crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    train = train.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    below = min(1.0, labelled / max(1, train.count())) * 2.0**64 - 2.0**63  # as many as wanted lie below this hash, on average
    train = train.filter(order.cast("double") <= below)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(train), "doc_id")
    rows = written(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text").distinct(), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch], only: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            counts: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                held = beginnings(text or "")
                counts.update(held if only is None else held & only)
            yield pa.record_batch({"entry": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def counted(label: int, only: frozenset[str] | None = None) -> DataFrame:
        return rows.filter(F.col("label") == label).mapInArrow(lambda batches: count(batches, only), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    # Only what enough toxic documents hold can become an entry, so clean texts are counted against those alone. Both come
    # from the labelled sample, whose bound is theirs.
    bad = {r["entry"]: r["n"] for r in counted(1).filter(F.col("n") >= SUPPORT).collect()}
    good = {r["entry"]: r["n"] for r in counted(0, frozenset(bad)).collect()}
    likely = [(e, b, good.get(e, 0)) for e, b in bad.items() if weight(b, good.get(e, 0), n_bad, n_good) >= ODDS]
    scorer = Scorer(choose(likely, n_bad, n_good), n_bad, n_good)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([scorer.measures(t, y) for y, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist())]).reshape(-1, 5)
            yield pa.record_batch([batch.column("label"), *map(pa.array, x.T.copy())], names=["label", *"abcde"])

    pdf = rows.mapInArrow(measure, "label int, a double, b double, c double, d double, e double").toPandas()  # LABELLED rows at most
    pdf = pdf.sort_values(list(pdf.columns))
    scorer.calibrate(pdf[list("abcde")].to_numpy(), pdf["label"].to_numpy(float))
    return scorer


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts score as texts without a match. Several labels of a document count as the largest. A null
    doc_id isn't held out and never learned from. Repeated rows score alike; other columns are ignored. Texts of any
    length are matched whole, in time that grows with their length; bytes that aren't UTF-8 count as U+FFFD. An empty table gives no rows.
    """
    learned = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [learned.value(x) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
