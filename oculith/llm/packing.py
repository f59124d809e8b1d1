"""Hierarchical multi-length packing of token ids into fixed contexts.

Each task packs its own documents, shard by shard (`shard_tokens` ids at most in memory, plus one document), so nothing
is shuffled and sequences never span tasks. In a shard, whole top-tier windows are cut from long documents; what is left
of a document is routed to the smallest tier that holds it. Tiers are packed from the longest down; a gap in a window is
filled with pieces of the shorter tiers, the last one cut to fit. The rest of a shard is cut at powers of two, so at
most one sequence a shard has padding. Sequences are then dealt to step groups of even token counts.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oculith.llm.shared import slices, whole_text

TIERS = (512, 1024, 2048, 4096)
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


#: The normalizer and the pre-tokenizer whose rules let texts be cut at blanks, and ASCII letters from marks.
CUTTABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by the tokenizer of a file, with what it gave kept.

    Where the file's rules are those of CUTTABLE, chunks between ASCII blanks are encoded one by one: nothing joins across
    them. A run of letters below U+0100, which stay single letters when composed and folded, is a word and is encoded apart
    from plain marks behind it; ASCII words are kept in lower case. Many words are encoded as one text, whose
    ids are cut where a word ends by its token's suffix. Texts of other files are encoded whole. What is kept is bounded by
    number, and by length: chunks of over `longest` characters are encoded with their texts and forgotten.
    """

    MARKS = ".,!?|$#%&*"

    def __init__(self, path: str, end_id: int, chunks: int = 600_000, words: int = 600_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id.to_bytes(4, "little")
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] for t in rules["added_tokens"])
        self.cuttable = plain and rules["post_processor"] is None and all(rules[k] == v for k, v in CUTTABLE.items())
        suffix = rules["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True
        self.most, self.longest = (chunks, words), longest
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_words(self, words: list[str], together: int = 4096) -> list[bytes]:
        """Ids of words, many at a time; one by one where a word's end can't be told."""
        out = []
        for at in range(0, len(words), together):
            own = words[at : at + together]
            raw = self.encoded([" ".join(own)])[0]
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, np.uint32)]) + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(own) else self.encoded(own)
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.cuttable:
            return [x + self.end for x in self.encoded(texts)]
        split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        every = set()
        for chunks in split:
            every.update(chunks)
        long = [x for x in every if len(x) > self.longest]
        every.difference_update(long)
        new = every.difference(self.chunks)
        if len(self.chunks) + len(new) > self.most[0]:
            self.chunks = {"": b""}
            new = every - {""}
        known = self.chunks
        if new:
            if len(self.words) > self.most[1]:
                self.words = {"": b""}
            words, parts, plain, odd = self.words, [], set(), set()
            for chunk in new:
                core = chunk.rstrip(self.MARKS)
                if core.isalpha() and len(core.encode("latin-1", "ignore")) == len(core):
                    marks = chunk[len(core) :]
                    if core.isascii():
                        core = core.lower()
                    if core not in words:
                        plain.add(core)
                    if marks not in words:
                        odd.add(marks)
                    parts.append((core, marks))
                else:
                    if chunk not in words:
                        odd.add(chunk)
                    parts.append((chunk, ""))
            plain, odd = list(plain), list(odd)
            words.update(zip(plain, self.encoded_words(plain)))
            words.update(zip(odd, self.encoded(odd)))
            known.update(zip(new, [words[core] + words[marks] for core, marks in parts]))
        if long:
            once = dict(zip(long, self.encoded(long)))
            return [b"".join([once[c] if len(c) > self.longest else known[c] for c in chunks]) + self.end for chunks in split]
        return [b"".join(map(known.__getitem__, chunks)) + self.end for chunks in split]


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path, end_id)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); every token of every document in exactly one piece.

    All sequences but the last have a length of one of the tiers or of a smaller power of two.
    """
    top, out = tiers[-1], []
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # by tier: (length, document, start)
    for doc, n in enumerate(lengths):
        whole = n - n % top
        out += [[(doc, at, top)] for at in range(0, whole, top)]
        if n > whole:
            tier = next(i for i, t in enumerate(tiers) if n - whole <= t)
            waiting[tier].append((n - whole, doc, whole))
    for queue in waiting:
        queue.sort()

    def fill(window: list[tuple[int, int, int]], gap: int, highest: int) -> int:
        """Fills the gap with pieces of tiers up to `highest`: the longest that fits, else the front of one is cut off."""
        while gap:
            for i in range(highest, -1, -1):
                if (at := bisect_right(waiting[i], (gap, 1 << 62, 0))) > 0:
                    n, doc, start = waiting[i].pop(at - 1)
                    break
            else:
                i = next((i for i in range(highest, -1, -1) if waiting[i]), -1)
                if i < 0:
                    return gap
                n, doc, start = waiting[i].pop()
                rest = (n - gap, doc, start + gap)
                queue = waiting[next(k for k, t in enumerate(tiers) if rest[0] <= t)]
                queue.insert(bisect_right(queue, rest), rest)
                n = gap
            window.append((doc, start, n))
            gap -= n
        return 0

    last: list[tuple[int, int, int]] = []
    for tier in range(len(tiers) - 1, -1, -1):
        while waiting[tier]:
            n, doc, start = waiting[tier].pop()
            window = [(doc, start, n)]
            if fill(window, tiers[tier] - n, tier):
                last = window
            else:
                out.append(window)
    size = sum(x[2] for x in last)
    while size:  # the shard's rest, cut at powers of two down to 64
        part = 1 << (size.bit_length() - 1) if size >= 64 else size
        window, need = [], part
        while need:
            doc, start, n = last.pop(0)
            if n > need:
                last.insert(0, (doc, start + need, n - need))
                n = need
            window.append((doc, start, n))
            need -= n
        out.append(window)
        size -= part
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """Group of each sequence: the longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    dealt = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, g = heapq.heappop(groups)
        dealt[i] = g
        heapq.heappush(groups, (tokens + sizes[i], g))
    return dealt


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, shard_tokens: int = 2_000_000, step_tokens: int = 262_144) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its ids and then `end_id`; null and empty texts are `end_id` alone. Ids of sequences are unique:
    the number of the task's partition, then of the shard and of the sequence. Repeated rows are packed each for itself;
    a text of any length is encoded whole, and is the only one in memory beyond a shard's tokens; other columns are
    ignored; bytes that aren't UTF-8 count as U+FFFD; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, serial, group = encoder(tokenizer_path, end_id), TaskContext.get().partitionId() << 40, 0, 0
        docs_, ids, tokens = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, group
            windows = pack([len(x) // 4 for x in ids], tiers)
            sizes = [sum(x[2] for x in w) for w in windows]
            steps = step_groups(sizes, step_tokens)
            rows = []
            for w, size, step in zip(windows, sizes, steps):
                offset, tier = 0, next(t for t in tiers if size <= t)
                for doc, start, n in w:
                    crc = zlib.crc32(memoryview(ids[doc])[4 * start : 4 * (start + n)])
                    rows.append((docs_[doc], start, n, crc, len(ids[doc]) // 4, part + serial, offset, tier, part + group + step))
                    offset += n
                serial += 1
            group += max(steps) + 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            kinds = [own, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in slices(batches):
            own = batch.column("doc_id").type
            for doc, encoded in zip(batch.column("doc_id").to_pylist(), encode([x or "" for x in batch.column("text").to_pylist()])):
                docs_.append(doc)
                ids.append(encoded)
                tokens += len(encoded) // 4
                if tokens >= shard_tokens:
                    yield flush()
                    docs_, ids, tokens = [], [], 0
        if ids:
            yield flush()

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")
