"""Licence scans: Aho-Corasick over whole texts for notice phrases and identifier tags; licence expressions by a
shunting-yard parser.

Words are runs of digits, ASCII letters (lower-cased) and code points beyond ASCII; a phrase matches where its words
stand one after the other. After an identifier tag, the expression on the rest of its line is parsed (and, or, with,
parentheses); its identifiers become labels too, if they are known ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oculith.llm.shared import slices, texts

#: Phrases of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases that this method adds.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "released into the public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "all-rights-reserved",
}
#: Families that expressions are evaluated against.
PERMISSIVE = frozenset({"apache", "bsd", "boost", "cc0", "cc-by", "isc", "mit", "unlicense", "zlib"})
TAG = "spdx license identifier"
WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(r"[(),/]|[A-Za-z0-9][A-Za-z0-9.+:_-]*")
LINE_END = re.compile(rb"[\r\n]|$")
#: Names that identifiers begin with; a version and `-only`, `-or-later` or `+` may follow.
NAMES = (
    "0bsd", "afl", "agpl", "apache", "apsl", "artistic", "boost", "bsd", "bsl", "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0", "cddl",
    "cecill", "cpl", "ecl", "epl", "eupl", "gfdl", "gpl", "hpnd", "ipl", "isc", "lgpl", "libpng", "lppl", "mit", "mpl", "ms-pl", "ms-rl", "ncsa", "odbl", "ofl", "openssl",
    "osl", "pddl", "php", "postgresql", "psf", "python", "qpl", "ruby", "sspl", "unicode-dfs", "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl",
)
IDENTIFIER = re.compile("(?:" + "|".join(sorted(map(re.escape, NAMES), key=len, reverse=True)) + r")(?:-?v?\d[\d.]*)?(?:-(?:clause|universal|patent|modern|0))*(?:-only|-or-later|\+)?|(?:documentref-[\w.-]+:)?licenseref-[\w.-]+")
EXCEPTION = re.compile(r"[\w.-]*exception[\w.-]*|additionref-[\w.-]+")
BINDS = {"or": 1, "and": 2, "with": 3}
#: What stands for an operator between two licences of a list.
LISTS = {",": "and", "/": "or"}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**MORE, **BASE, TAG: ""}.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def parse(expression: str) -> list[str] | None:
    """The expression in postfix order, or None if it isn't one. Operands are known identifiers (after `with`, names of
    exceptions); a comma between them is an `and`, a slash an `or`. Reads as far as the expression goes on: prose after it is
    left, with operators and parentheses that it follows, and closes what is open. One pass; each token is moved once."""
    out, ops, operand, depth, since, listed, prose = [], [], False, 0, 0, None, False

    def bind(word: str) -> None:
        while ops and BINDS.get(ops[-1], 0) >= BINDS[word]:
            out.append(ops.pop())
        ops.append(word)

    for match in TOKEN.finditer(expression):
        token = match[0]
        word = token.lower().rstrip(".:")
        known = bool((EXCEPTION if ops and ops[-1] == "with" and not operand else IDENTIFIER).fullmatch(word)) and word not in BINDS
        if token in LISTS:
            if not operand:
                prose = True
                break
            listed = LISTS[token]
            continue
        if listed and (known or token == "("):  # a separator counts once it has a licence on either side
            bind(listed)
            operand, since = False, 1
        listed = None
        if token == "(":
            if operand:
                prose = True
                break
            ops.append(token)
            depth, since = depth + 1, since + 1
        elif token == ")":
            if not operand:
                return None
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif word in BINDS:
            if not operand:
                return None
            bind(word)
            operand, since = False, 1
        elif operand or not known:
            prose = True
            break
        else:
            out.append(token.rstrip(".:"))
            operand, since = True, 0
    if not out or (not operand and not prose) or (depth and not prose):
        return None
    if not operand:
        del ops[len(ops) - since :]
    return out + [op for op in reversed(ops) if op != "("]


def evaluate(postfix: list[str], permitted: frozenset[str]) -> bool:
    """Whether the licences can be met from the permitted families: `or` by either side, `and` by both; an exception
    (`with`) only adds rights, so its licence decides."""
    stack: list[bool] = []
    for token in postfix:
        if token not in BINDS:
            stack.append(family(token.lower()) in permitted)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left or right if token == "or" else left and right if token == "and" else left)
    return stack.pop()


def identifiers(postfix: list[str]) -> list[str]:
    """The licences of an expression, without exceptions (each of which its `with` follows)."""
    return [token.lower() for token, after in zip(postfix, [*postfix[1:], ""]) if token not in BINDS and after != "with"]


def family(identifier: str) -> str:
    """Label of a licence identifier: the contract's names for its own, else the identifier without a version."""
    for label in ("gpl", "apache", "mit", "bsd"):
        if identifier == label or identifier.startswith(label + "-"):
            return label
    return re.sub(r"-?v?\d[\d.]*(-only|-or-later|\+)?$|\+$", "", identifier) or identifier


def tag_lines(raw: bytes, text: str, ends: list[int]) -> list[str]:
    """What follows each tag on its line, up to the next tag. `ends` are the places in `text`, the joined words, where tags
    end; the word there is found again in the raw text by its number."""
    if not ends:
        return []
    number, at, wanted = -1, 0, []
    for end in ends:
        number += text.count(" ", at, end)
        at = end
        wanted.append(number)
    last, first = set(wanted), {n - TAG.count(" ") for n in wanted}
    spans, begins = [], []
    for k, word in enumerate(re.finditer(rb"[^ ]+", raw.translate(WORD))):
        if k in first:
            begins.append(word.start())
        if k in last:
            spans.append(word.end())
    out = []
    for low, high in zip(spans, [*begins[1:], len(raw)]):
        stop = LINE_END.search(raw, low, high).start()
        out.append(raw[low:stop].decode("utf-8", "replace").lstrip(" \t").removeprefix(":"))
    return out


def scan(raw: bytes, patterns: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, expressions (postfix), permitted, score."""
    words = b" ".join(raw.translate(WORD).split())
    text = f" {words.decode('utf-8', 'replace')} "
    places, base, labels, tags, permitted = [], set(), set(), [], True
    for end, (phrase, label) in patterns.iter(text):
        if phrase in BASE:
            places.append(end - len(phrase) - 1)
            base.add(label)
        elif phrase == TAG:
            tags.append(end)
        labels |= {label} - {""}
    expressions = []
    for line in tag_lines(raw, text, tags):
        if postfix := parse(line):
            expressions.append(" ".join(postfix))
            permitted &= evaluate(postfix, PERMISSIVE)
            labels |= set(map(family, identifiers(postfix)))
    n = words.count(b" ") + 1 if words else 0
    starts = [text.count(" ", 0, at + 1) - 1 for at in ((min(places), max(places)) if places else ())]
    score = 1 - exp(-(len(base) + 0.5 * len(labels - base) + len(expressions))) if labels else 0.0
    return n, len(places), *(starts or (None, None)), ",".join(sorted(base)), ",".join(sorted(labels)), expressions, permitted if expressions else None, score


FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "expressions": pa.list_(pa.string()), "permitted": pa.bool_(), "score": pa.float64()}


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, expressions (postfix), permitted, score.

    `permitted` says whether all expressions found can be met by permissive licences; null without any. Places that
    overlap all count. Null and empty texts have no words and empty labels. Malformed expressions, and those whose first
    operand isn't a known identifier, are left out. Texts of any length, lines of any length included, are read whole, in time
    that grows with their length; bytes that aren't UTF-8 are read as letters. Repeated rows give the same result; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = automaton()
        for batch in slices(batches):
            found = list(zip(*[scan(x, patterns) for x in texts(batch)])) or [()] * len(FIELDS)
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(found, FIELDS.values())]], names=["doc_id", *FIELDS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, permitted boolean, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)
