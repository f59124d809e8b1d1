"""Language identification by compression: a text belongs to the language whose sample helps zstandard most.

Each language has a raw-content dictionary of at most `DICTIONARY_BYTES`, joined from pieces of at most `documents`
different training texts with letters, in hash order; a piece is cut at a hashed place anywhere in its text. A text is
compressed in chunks (all of it), so that the dictionary and not the text's own beginning is what helps; the smallest
total wins. The margin to the second smallest gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oculith.llm.shared import crc_fold, slices, whole_text

FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
#: Bounds of what is learned of each language: texts, characters of a text, bytes in all; chunk of compression; narrowest margin that isn't rejected.
DOCUMENTS, PIECE, DICTIONARY_BYTES = 160, 400, 60_000
CHUNK, NARROW, LEVEL = 2048, 0.02, 6
LETTER = regex.compile(r"\p{L}")


def samples(docs: DataFrame, documents: int = DOCUMENTS) -> list[tuple[str, bytes]]:
    """(language, dictionary), the commonest first: a piece of at most `documents` different training texts each."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.lower(whole_text()).alias("text"))
    rows = rows.filter((crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("order", 0.02).alias("different")).collect()  # a row a language
    if not known:
        return []
    # The first of a language by hash lie below this hash: about twice as many as are wanted, however many there are.
    below = {r["lang"]: min(1.0, (2 * documents + 50) / r["different"]) * 2.0**64 - 2.0**63 for r in known}
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col("lang"))
    place = F.pmod(F.xxhash64("order"), F.greatest(F.char_length("text") - PIECE, F.lit(0)) + 1) + 1
    pieces = rows.filter(F.col("order").cast("double") <= bound).groupBy("lang", "order").agg(F.first(F.substring(F.col("text"), place.cast("int"), F.lit(PIECE))).alias("piece"))
    parts: dict[str, list[bytes]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["order"])):  # about 2 * documents * PIECE characters a language
        parts.setdefault(r["lang"], []).append(r["piece"].encode())
    common = {r["lang"]: r["n"] for r in known}
    return [(lang, b"\n".join(x[:documents])[-DICTIONARY_BYTES:]) for lang, x in sorted(parts.items(), key=lambda p: (-common[p[0]], p[0]))]


class Classifier:
    def __init__(self, learned: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in learned]
        self.compress = []
        for _, data in learned:
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the margin is too narrow to rely on. Ties go to the commonest."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = text.lower().encode("utf-8", "replace")
        chunks = [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
        sizes = [sum([len(c(x)) for x in chunks]) for c in self.compress]
        best = min(sizes)
        rest = sorted(sizes)[1] if len(sizes) > 1 else 2 * best
        margin = (rest - best) / rest
        return self.langs[sizes.index(best)], 1 - 0.5 * exp(-30 * margin), margin < NARROW


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    `und` with score 0 if the text is null, empty or has no letter, or if nothing could be learned; `rejected` marks
    these and narrow margins, where lang_pred is still the best guess. A null doc_id isn't held out and never learned
    from. Repeated rows are predicted alike; texts of any length are compressed whole, chunk by chunk; other columns are
    ignored; bytes that aren't UTF-8 count as U+FFFD; an empty table gives no rows.
    """
    learned = docs.sparkSession.sparkContext.broadcast(samples(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(learned.value)
        for batch in slices(batches):
            found = [classify(x) for x in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
