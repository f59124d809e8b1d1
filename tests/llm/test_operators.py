"""The ten operators against brute force, round trips and held-out accuracy, and on awkward tables."""

import hashlib
import json
import random
import time
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
import zstandard
from pyspark.sql import functions as F

from oculith.llm import chat, exact_dedup, fingerprint, language, licence, mixing, packing, quality, simhash, toxicity
from oculith.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, score string, kept string, part string, key int"
LONG = " ".join(f"word{i % 977} Other" for i in range(20_000))
AWKWARD = [
    (1, "Alpha beta gamma delta epsilon", "en", "a", 30),
    (2, "ALPHA beta gamma delta epsilon", "en", "a", 30),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n", "en", None, 3),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + " x", None, "b", len(LONG) + 2),
    (8, "Éa été <|im_start|> MIT License, <|endoftext|>", "fr", "b", 46),
    (9, "éa ÉTÉ", "fr", "b", 6),
    (10, "same", "de", "c", 4),
    (10, "same", "de", "c", 4),
    (None, "no id", "de", "c", 5),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "p", 7) for r in AWKWARD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (6, 1, 0), (7, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["exact", "prints", "edits", "language", "simhash", "quality", "licence", "toxicity", "packing", "mixing"])
def test_awkward_and_empty_tables(spark, awkward, empty, labels, name):
    run = {
        "exact": exact_dedup.exact_dedup,
        "prints": fingerprint.fingerprint_documents,
        "edits": fingerprint.fingerprint_edits,
        "language": language.identify,
        "simhash": simhash.simhash_dedup,
        "quality": lambda d: quality.score_quality(d, labels),
        "licence": licence.scan_licences,
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "packing": lambda d: packing.pack_documents(d, TOKENIZER),
        "mixing": mixing.mix,
    }[name]
    got = run(awkward).collect()
    ids = [r["doc_id"] for r in got]
    assert set(ids) == {r[0] for r in AWKWARD}
    if name != "packing":
        assert len(ids) == len(AWKWARD)
    for r in got:
        if "score" in r:
            assert 0 <= r["score"] <= 1
    assert run(empty).collect() == []


def test_filters_on_awkward_and_empty_tables(awkward, empty, labels):
    for f in (exact_dedup.keep_distinct, simhash.keep_one, mixing.keep_sampled, lambda d: quality.keep_good(d, labels)):
        assert f(empty).collect() == []
        assert f(awkward).columns == awkward.columns
        assert f(awkward).count() <= len(AWKWARD)


def test_exact_dedup(awkward):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(awkward, capacity=1, max_depth=4).collect()}
    assert (got[1]["keep_id"], got[1]["group_size"], got[1]["kept"]) == (2, 2, False)
    assert got[2]["kept"] and got[4]["group_size"] == 3 and got[4]["keep_id"] == 4 and not got[3]["kept"]
    assert got[9]["text_sha256"] == hashlib.sha256("éa ÉtÉ".encode()).hexdigest()
    assert got[10]["group_size"] == 2 and got[10]["kept"]


def test_directory_doubles_only_where_full():
    slots = exact_dedup.double_directory({0: 5, 1: 5, 8: 1}, 4, 5)
    assert len(slots) == 16 and slots[0][1] != slots[1][1] and len({b for _, b, _ in slots[8:]}) == 1
    assert [n for _, _, n in slots[:3]] == [5, 5, 0] and slots[15][2] == 1
    assert exact_dedup.double_directory({}, 4, 5) == [(0, 0, 0)]
    hot = exact_dedup.double_directory({3: 100}, 4, 5)  # one hot hash: splitting ends with the bits
    assert len(hot) == 16 and hot[3][2] == 100


def test_exact_dedup_by_chains_and_its_directory(spark, monkeypatch):
    rows = [(i, f"Copy {i % 3}" if i % 2 else f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    best = {}
    for i, text in rows:
        best.setdefault(text.lower(), []).append(i)
    want = sorted((i, max(g), len(g), i == max(g)) for g in best.values() for i in g)
    for capacity, depth in ((7, 3), (1, 8), (10_000, 14)):  # chains of several parts; many buckets; one bucket
        got = exact_dedup.exact_dedup(docs, capacity, depth).collect()
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
        assert sorted(r["doc_id"] for r in exact_dedup.keep_distinct(docs, capacity, depth).collect()) == sorted(map(max, best.values()))
    # the fullest task has at most twice the median, however many buckets there are and however hot one is; no more tasks
    # than the bound, and fewer at work where single buckets are over a share
    even = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), F.lpad(F.col("id").cast("string"), 8, "0"))).alias("text"))
    for capacity, bound in ((4096, 30), (4096, 8), (40, 30), (40, 8)):
        directory = exact_dedup.Directory(even, capacity, 16, share=100_000, tasks=bound)
        dealt = directory.deal(directory.find(even.withColumn("h", F.xxhash64(exact_dedup.normal(F.col("text"))))))
        n = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
        assert directory.tasks <= bound and len(n) >= min(bound, 16) and n[-1] <= 2 * n[len(n) // 2]
    # a directory that sends rows elsewhere than to the bucket of their hash finds nothing
    index = exact_dedup.Directory(docs, 7, 3)
    table = exact_dedup.build_index(docs.select("doc_id", "text"), index)
    wrong = index.table.withColumn("bucket", F.col("bucket") + 1000)
    monkeypatch.setattr(index, "table", wrong)
    probe = index.find(docs.select("doc_id", F.xxhash64(exact_dedup.normal(F.col("text"))).alias("h")))
    assert probe.join(table, ["bucket", "h"]).count() == 0


def test_fingerprints(spark, real):
    rows = [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()] + [(5000, None), (5001, "short"), (-3, "")]
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ranges=7).collect()}
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    for i, (d, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[1][:n]
        r = got[d]
        own, other, after = (fingerprint.digests([x.encode()])[0] for x in (text, edited, following[1]))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.encode(own) and r["edited_fingerprint"] == fingerprint.encode(other)
        assert r["near_edited"] == fingerprint.likeness(own, other) and r["near_next"] == fingerprint.likeness(own, after)
    near = [r["near_edited"] for r in got.values() if r["n_chars"] > 2000]
    far = [r["near_next"] for r in got.values() if r["n_chars"] > 2000]
    assert np.mean(near) > 0.4 and np.median(far) < 0.15


def test_window_entropy_is_exact():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 110, 500, dtype=np.uint8)
    got = fingerprint.ranks(data)
    for end in (63, 64, 200, 499):
        _, n = np.unique(data[end - 63 : end + 1], return_counts=True)
        entropy = -(n / 64 * np.log2(n / 64)).sum()
        assert got[end - 63] == sum(x < fingerprint.LEVELS[round(entropy * 63 / 6)] for x in fingerprint.LEVELS)


def plain_filters(raw):
    """Filters of a text as sets of bits, written out window by window: those of 12-byte windows, then the others."""
    short, long = [], []
    if raw and len(raw) < 512:
        short = [raw[a : a + 12] for a in range(max(1, len(raw) - 11))]
    if len(raw) >= 64:
        data = np.frombuffer(raw, np.uint8)
        rank = fingerprint.ranks(data).tolist()
        points = defaultdict(int)
        for a in range(len(rank) - 63):
            points[min(range(a, a + 64), key=lambda i: (rank[i], i))] += 1
        few = min(range(len(rank)), key=lambda i: (rank[i], i))
        most = [a for a in sorted(points) if points[a] >= 16] or [max(sorted(points), key=points.get, default=few)]
        long = [raw[a : a + 64] for a in most]
    bits = lambda x: {int.from_bytes(xxhash.xxh3_128_digest(x)[2 * k : 2 * k + 2], "little") % 2048 for k in range(5)}
    chain = lambda own: [set().union(*map(bits, own[at : at + 128])) for at in range(0, len(own), 128)]
    return chain(list(dict.fromkeys(short))), chain(list(dict.fromkeys(long)))


def plain_likeness(a, b):
    kind = next((k for k in (0, 1) if a[k] and b[k]), None)
    if kind is None:
        return float(a == b)
    a, b = a[kind], b[kind]
    if a == b:
        return 1.0
    a, b = sorted((a, b), key=len)
    over = lambda x, y: (len(x & y) - len(x) * len(y) / 2048) / max(min(len(x), len(y)) - len(x) * len(y) / 2048, 1e-9)
    return min(1.0, sum(max(0.0, *(over(x, y) for y in b)) * len(x) for x in a) / sum(map(len, a)))


def test_fingerprints_against_plain_windows(real):
    texts_ = sorted((r["text"] for r in real.select("text").collect()), key=len)
    raws = [t.encode() for t in [*texts_[:40:5], *texts_[60:140:20], texts_[-3]]] + [b"", b"x", b"ab" * 30, b"ab" * 50, b"ab" * 127, b"abc" * 100, b"z" * 400, b"z" * 700]
    got = fingerprint.digests(raws)
    want = [plain_filters(x) for x in raws]
    for own, sets in zip(got, want):
        assert tuple([set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in kind] for kind in own) == sets
        assert all((x == y).all() for x, y in zip(fingerprint.decode(fingerprint.encode(own)), own, strict=True))
    for i in range(0, len(raws), 2):
        for j in range(len(raws)):
            assert fingerprint.likeness(got[i], got[j]) == pytest.approx(plain_likeness(want[i], want[j]), abs=1e-9)


def test_fingerprints_have_no_cliff_of_length():
    """The same edit with ASCII and with accented text, at lengths around every bound: neither may fall far below the other."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))[:n]
    for n in (60, 66, 190, 250, 255, 300, 400, 500, 511, 600):
        text, other = prose(n), prose(n)
        kept = text[: n - n // 3]
        plain, accented = kept + other[: n // 3], kept + other[: n // 3].replace("a", "á").replace("e", "é").replace("o", "ó")
        far, own, a, b = fingerprint.digests([x.encode() for x in (prose(n), text, plain, accented)])
        near = [fingerprint.likeness(own, x) for x in (a, b)]
        assert min(near) > 0.35 and abs(near[0] - near[1]) < 0.3 and fingerprint.likeness(own, far) < 0.25, (n, near)


def test_fingerprints_need_numbers(spark):
    with pytest.raises(ValueError, match="number"):
        fingerprint.fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def held_out(spark, frame, labels, column):
    rows = frame.join(labels.select("doc_id", F.col(column).alias("truth")), "doc_id").filter("held_out and truth is not null")
    return rows.select("truth", "score", "predicted").toPandas()


def test_classifiers_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    q = held_out(spark, quality.score_quality(docs, labels), labels, "quality")
    t = held_out(spark, toxicity.score_toxicity(docs, labels), labels, "toxic")
    assert (q.truth == q.predicted).mean() > 0.97 and (t.truth == t.predicted).mean() > 0.97
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_against_plain_compression(spark, real):
    rows = [r for r in real.collect()]
    learned = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] and any(c.isalpha() for c in r["text"])]
    dictionaries = language.samples(real, 20)
    assert {lang for lang, _ in dictionaries} == {r["lang"] for r in learned}
    for lang, data in dictionaries:
        own = [r["text"].lower() for r in learned if r["lang"] == lang]
        pieces = data.decode("utf-8", "ignore").split("\n")
        assert len(data) <= language.DICTIONARY_BYTES and sum(any(p in t for t in own) for p in pieces) > 0.9 * len(pieces)
    classify = language.Classifier(dictionaries)
    for r in rows[::7]:
        raw, sizes = r["text"].lower().encode(), []
        for _, data in dictionaries:
            own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(pack.compress(raw[at : at + language.CHUNK])) for at in range(0, len(raw), language.CHUNK)))
        assert classify(r["text"])[0] == dictionaries[sizes.index(min(sizes))][0]


def test_language_learns_different_texts_with_letters(spark):
    rows = [(i, "es", "") for i in range(400)] + [(1000 + i, "es", "hola mundo que tal") for i in range(400)] + [(2000 + i, "es", f"palabra{i} en texto") for i in range(40)]
    [(lang, data)] = language.samples(spark.createDataFrame(rows, "doc_id long, lang string, text string"), 100)
    assert lang == "es" and len(data.split(b"\n")) >= 25 and data.count(b"hola") <= 1


def test_quality_against_plain_neighbours(spark, real):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(real, labels)
    train = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert model.prior == pytest.approx(np.mean(list(train.values())))
    raws = {r["doc_id"]: r["text"].encode() for r in real.collect()}
    x = np.stack([quality.terms(raws[d]) for d in sorted(train, key=str) if d in raws]).astype(float)
    y = np.array([train[d] for d in sorted(train, key=str) if d in raws])
    assert sorted(y) == sorted(model.y) and model.vectors.shape == (min(quality.RANK, len(y)), len(y))
    weigh = lambda z: z * model.idf / np.maximum(np.linalg.norm(z * model.idf, axis=-1, keepdims=True), 1e-9)
    unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), 1e-9)
    vectors, vote = unit(weigh(x) @ model.v), {k: (model.prior if k else 1 - model.prior) / (y == k).sum() * len(y) for k in (0, 1)}
    some = list(raws.values())[::9]
    for raw, got in zip(some, model.score(some)):
        near = vectors @ unit(weigh(quality.terms(raw).astype(float)) @ model.v)
        best = sorted(range(len(y)), key=lambda i: -near[i])[: quality.NEIGHBOURS]
        s = [max(near[i], 0) ** 8 * vote[int(y[i])] for i in best]
        assert got == pytest.approx(sum(w for w, i in zip(s, best) if y[i]) / sum(s), abs=2e-3)


def test_quality_share_counts_documents_with_labels_0_and_1(spark):
    docs = spark.createDataFrame([(i, f"word {i} some text") for i in range(1, 40)], "doc_id long, text string")
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], 5), (ids[1], 1), (ids[1], 1), (ids[2], 0), (ids[3], 9), (ids[4], 1), (ids[4], 0), (None, 0)]
    model = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert model.prior == pytest.approx(1 / 3) and (model.vote > 0).all() and len(model.y) == 3


def test_toxicity_against_plain_counts(spark):
    bad = [f"you are an idi{'o' * (i % 2)}ot and a foo number {i}" for i in range(1, 60)]
    good = [f"a fine day with tea and cake number {i} an" for i in range(1, 90)]
    docs = spark.createDataFrame(list(enumerate([*bad, *good])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(bad))) for i in range(len(bad) + len(good))], "doc_id long, toxic int")
    scorer = toxicity.learn(docs, labels)
    train = [(i, t) for i, t in enumerate([*bad, *good]) if zlib.crc32(str(i).encode()) % 4 != 2]
    n_bad, n_good = sum(i < len(bad) for i, _ in train), sum(i >= len(bad) for i, _ in train)
    assert (scorer.n_bad, scorer.n_good) == (n_bad, n_good)
    assert any(e.startswith("idi") for e in scorer.lexicon) and "foo " in scorer.lexicon and "an " not in scorer.lexicon
    for entry, counts in scorer.lexicon.items():  # every entry's documents, counted word by word
        has = lambda t: any((w + " ").startswith(entry) for w in toxicity.WORD.findall(toxicity.fold(t)))
        assert counts == (sum(has(t) for i, t in train if i < len(bad)), sum(has(t) for i, t in train if i >= len(bad)))
        assert counts[0] >= toxicity.SUPPORT and toxicity.weight(*counts, n_bad, n_good) >= toxicity.ODDS
    for _, text in train[::5]:
        words = toxicity.WORD.findall(toxicity.fold(text))
        hit = [max((toxicity.weight(*c, n_bad, n_good) for e, c in scorer.lexicon.items() if (w + " ").startswith(e)), default=0) for w in words]
        best = {w: h for w, h in zip(words, hit) if h}
        got = scorer.measures(text)
        assert got[1] == pytest.approx(max(best.values(), default=0)) and got[3] == pytest.approx(np.log1p(sum(h > 0 for h in hit)))


def test_matches_inside_exceptions_only_are_safe():
    scorer = toxicity.Scorer({"clown": (50, 0), "fish ": (50, 0)}, 100, 1000)
    assert scorer.measures("a clown fish")[1] == 0 < scorer.measures("a clown fish clown")[1]
    long = "clown fish " * 20_000
    assert scorer.measures(long)[1] == 0


def test_disguises_fold_to_plain_words():
    assert toxicity.fold("1d10t tr@sh ｓｃｕｍ ѕtuріd cl​own m0ron") == "idiot trash scum stupid clown moron"
    assert toxicity.fold("from 10 to 5 on, 2024!") == "from 10 to 5 on, 2024!"
    scorer = toxicity.Scorer({"trash ": (50, 0), "idiot": (50, 0)}, 100, 1000)
    assert scorer("you are tr4sh you idiots") > 0.5 > scorer("put it in the trash can please") > 0


def test_licences():
    patterns = licence.automaton()
    n, base, first, last, labels, every, expressions, permitted, score = licence.scan("Été: the MIT License; see the mit\nlicense. GNU General Public License\nSPDX-License-Identifier: (Apache-2.0 OR LGPL-2.1+) AND BSD-3-Clause WITH x-exception".encode(), patterns)
    assert (base, first, labels) == (3, 2, "gpl,mit") and last == 8 and permitted
    assert expressions == ["Apache-2.0 LGPL-2.1+ OR BSD-3-Clause x-exception WITH AND".replace("OR", "or").replace("WITH", "with").replace("AND", "and")]
    assert every.split(",") == ["apache", "bsd", "gpl", "lgpl", "mit"]
    assert licence.parse("MIT OR") is None and licence.parse("(MIT") is None and licence.parse("") is None
    assert not licence.evaluate(licence.parse("GPL-3.0 AND MIT"), licence.PERMISSIVE)
    assert licence.scan(b"mit license mit license", patterns)[1] == 2 and licence.scan(b"", patterns)[:4] == (0, 0, None, None)


def test_licence_expressions_take_known_identifiers_only():
    patterns = licence.automaton()
    found = lambda text: licence.scan(text.encode(), patterns)[5:8]
    assert found("SPDX-License-Identifier: MIT and see the LICENSE file") == ("mit", ["MIT"], True)
    assert found("SPDX-License-Identifier: see LICENSE") == found("SPDX-License-Identifier: unknown text") == ("", [], None)
    assert found("SPDX-License-Identifier: MIT OR the other one") == ("mit", ["MIT"], True)
    assert found("Été\nSPDX License Identifier: GPL-3.0-only\nMIT") == ("gpl", ["GPL-3.0-only"], False)
    assert found("SPDX-License-Identifier:\nMIT") == ("", [], None)
    assert found("x SPDX-License-Identifier: Apache-2.0 SPDX-License-Identifier: MIT") == ("apache,mit", ["Apache-2.0", "MIT"], True)


def test_licence_lists_prose_and_open_parentheses():
    cases = {
        "MIT AND (see the file)": "MIT", "MIT OR (Apache-2.0 AND see it": "MIT Apache-2.0 or", "(MIT OR see the file)": "MIT", "MIT/Apache-2.0": "MIT Apache-2.0 or", "MIT, Apache-2.0": "MIT Apache-2.0 and", "MIT, Apache-2.0 or BSD-3-Clause, see it": "MIT Apache-2.0 and BSD-3-Clause or",
        "MIT, see LICENSE": "MIT", "MIT,": "MIT", "MIT (https://x.org/MIT)": "MIT", "MIT, OR Apache-2.0": "MIT Apache-2.0 or", "GPL-2.0 WITH classpath-exception-2.0 / MIT": "GPL-2.0 classpath-exception-2.0 with MIT or", "MIT/(ISC)": "MIT ISC or",
        "(MIT)": "MIT", "(see MIT)": None, ", MIT": None, "MIT OR": None, "((MIT)": None, "()": None, "MIT AND AND ISC": None,
    }
    assert {text: (" ".join(found) if (found := licence.parse(text)) else None) for text in cases} == cases
    assert licence.identifiers(licence.parse("GPL-2.0 WITH classpath-exception-2.0 OR MIT")) == ["gpl-2.0", "mit"]


def test_licence_time_grows_with_the_line():
    patterns = licence.automaton()
    for text in ("SPDX-License-Identifier: MIT OR ISC " * 20_000, "SPDX-License-Identifier: " + "(" * 100_000 + "MIT" + ")" * 100_000, "SPDX-License-Identifier: MIT" + " OR ISC" * 100_000):
        began = time.perf_counter()
        assert licence.scan(text.encode(), patterns)[5].split(",")[-1] == "mit"
        assert time.perf_counter() - began < 5


def test_licences_in_bytes_that_are_no_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('4D4954204C6963656E736520FFFE0A535044582D4C6963656E73652D4964656E7469666965723A204953430AC3') as string) as text")
    row = licence.scan_licences(docs).first()
    assert row["base_labels"] == "mit" and row["labels"] == "isc,mit" and row["n_words"] == 8


def test_texts_that_are_no_utf8(spark, labels):
    """Broken bytes are read as U+FFFD: each operator gives what it gives for the mended text."""
    broken = spark.sql("select doc_id, cast(concat(unhex(repeat('C3', doc_id)), cast(repeat('some text here ', 30) as binary), unhex('FFFEC3')) as string) as text, 'en' as lang, 'a' as source, 1L as n_chars from (select explode(array(1L, 2L, 3L, 6L)) as doc_id)")
    mended = broken.withColumn("text", F.make_valid_utf8("text"))
    assert all(b"\xef\xbf\xbd" in bytes(r[0]) for r in mended.select(F.col("text").cast("binary")).collect())
    for run in (fingerprint.fingerprint_documents, fingerprint.fingerprint_edits, language.identify, lambda d: toxicity.score_toxicity(d, labels), lambda d: packing.pack_documents(d, TOKENIZER)):
        got, want = (sorted(map(str, run(d).collect())) for d in (broken, mended))
        assert got == want and len(got) >= 4


def test_licence_labels_against_plain_phrases(spark, real):
    docs = real.limit(50).unionByName(spark.createDataFrame([(9001, "Mozilla Public-License; ISC license, all rights\nreserved. CC BY-NC", "en", "a", 1)], real.schema))
    got = {r["doc_id"]: r["labels"] for r in licence.scan_licences(docs).collect()}
    for r in docs.collect():
        joined = " " + " ".join(regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))) + " "
        want = {label for phrase, label in {**licence.BASE, **licence.MORE}.items() if f" {phrase} " in joined}
        assert want <= set(got[r["doc_id"]].split(","))
        if "spdx" not in joined:
            assert got[r["doc_id"]] == ",".join(sorted(want))


def test_licence_words_against_brute_force(spark, real):
    got = {r["doc_id"]: r for r in licence.scan_licences(real).collect()}
    for r in real.collect():
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(i, lab) for i in range(len(words)) for p, lab in licence.BASE.items() if words[i : i + len(p.split())] == p.split()]
        own = got[r["doc_id"]]
        assert (own["n_words"], own["n_base"], own["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (own["first_word"], own["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))


def test_packing_round_trip(spark, real):
    docs = real.select("doc_id", "text").unionByName(spark.createDataFrame([(9000, None), (9001, ""), (9002, LONG)], "doc_id long, text string"))
    pieces = packing.pack_documents(docs, TOKENIZER, shard_tokens=60_000, step_tokens=16_384).collect()
    by_doc, by_sequence, steps = defaultdict(list), defaultdict(list), defaultdict(int)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        steps[p["step_group"]] += p["length"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc.pop(r["doc_id"]), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(array("I", ids[at : at + p["length"]]).tobytes())
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    padding = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == list(np.cumsum([0, *[p["length"] for p in own[:-1]]]))
        size = sum(p["length"] for p in own)
        assert size <= 4096
        padding += 0 if size & (size - 1) == 0 else 4096 - size
        total += size
    assert padding < 0.1 * total


def test_packing_ids_of_random_strings(tmp_path):
    from tokenizers import Tokenizer

    rng, tokenizer, encode = random.Random(5), Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER, 2)
    odd = [*"abzABZ", *"éÉßÄİıŉſǰΣσᾴ\u0301\u0308\u0307", *" \t\n\r\x0b\x0c\xa0\u2028\u200b", *".,!?|$#%&*'-_<>/09²½ªº×÷", "'s", "'ll", "<|endoftext|>", "中", "😀", "ﬁ", "\u212b", "\u212a", "\u2126", "हि"]
    strings = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(60_000)]
    strings += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(32, 127)])) for _ in range(rng.randint(0, 12))) for _ in range(40_000)]
    assert encode.cuttable
    want = [array("I", [*e.ids, 2]).tobytes() for e in tokenizer.encode_batch(["İ,", *strings], add_special_tokens=False)]
    assert encode(["İ,", *strings]) == want
    # long chunks give the same ids and aren't kept
    short = packing.Encoder(TOKENIZER, 2, longest=6)
    assert short(["İ,", *strings]) == want and max(map(len, short.chunks)) <= 6 and max(map(len, short.words)) <= 6
    blob = "".join(rng.choice("abcdefghijklmnop0123456789+/") for _ in range(9000))
    assert encode([blob + " x"]) == [array("I", [*tokenizer.encode(blob + " x", add_special_tokens=False).ids, 2]).tobytes()] and blob not in encode.chunks
    # a file with other rules is not cut
    rules = json.loads(open(TOKENIZER, encoding="utf-8").read())
    rules["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(rules))
    other = packing.Encoder(str(tmp_path / "other.json"), 2)
    tokenizer = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not other.cuttable and other(["A b, C"]) == [array("I", [*tokenizer.encode("A b, C", add_special_tokens=False).ids, 2]).tobytes()]


def test_step_groups_are_even():
    sizes = [4096] * 30 + [2048] * 11 + [512] * 40
    groups = packing.step_groups(sizes, 16_384)
    tokens = np.bincount(groups, sizes)
    assert tokens.max() - tokens.min() <= 4096


def test_chat_folds_events_and_round_trips(spark):
    events = [
        (1, 0, "a", "message", "user", "Hi <|im_end|> &lt;| &amp;"), (1, 1, "b", "message", "assistant", "Draft"), (1, 2, "b", "delta", None, " one"),
        (1, 3, "b", "regenerate", None, ""), (1, 4, "b", "delta", None, "Fin"), (1, 5, "b", "delta", None, "al"), (1, 6, "a", "edit", None, "Hello"),
        (1, 7, "c", None, None, None), (2, 0, "x", "message", "as\nk<|", "one"), (2, 0, "x", "message", "as\nk<|", "one"), (None, 1, None, "odd", "assistant", "<|im_start|>"),
    ]
    frame = spark.createDataFrame(events, "conv_id long, seq long, message string, kind string, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "Hello"), ("assistant", "Final"), ("", "")] and got[1]["loss_text"] == "Final"
    assert [tuple(t) for t in got[2]["turns"]] == [("as\nk<|", "one")] * 2 and got[2]["loss_text"] == ""
    assert got[None]["loss_text"] == "<|im_start|>" and got[None]["formatted"].count("<|im_start|>") == 1
    assert chat.format_chats(frame.limit(0)).collect() == []


def test_chat_spans_of_a_long_conversation(spark):
    """12,000 turns of non-ASCII text: spans lie where the loss is, and reading back doesn't walk the text for each."""
    texts = [f"é<|{i}|> 中{'x' * (i % 50)}" for i in range(12_000)]
    rows = [(1, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").selectExpr("conv_id", "seq", "seq as message", "'message' as kind", "role", "text")
    made = chat.format_chats(frame).cache()
    began = time.time()
    back = chat.read_back(made).first()
    assert time.time() - began < 60  # one walk a span took minutes
    assert [tuple(t) for t in back["turns"]] == [(r, x) for _, _, r, x in rows] and back["loss_text"] == "".join(texts[1::2])
    row = made.first()
    whole = [row["formatted"][x["start"] : x["start"] + x["length"]] for x in row["spans"]]
    assert [x.replace("&lt;|", "<|").replace("&amp;", "&") for x in whole] == texts[1::2]
    made.unpersist()


def test_chat_without_python(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message"), F.lit("message").alias("kind"), "role", "text")
    plan = chat.format_chats(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_mixing_meets_every_margin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.cells_of(mixing.measured(docs))
    targets = {"lang": {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1, "none such": 0.0}}
    for own, fraction in ((None, 0.5), (targets, 0.2)):
        got = mixing.margins(cells, mixing.rake(cells, fraction, targets=own), fraction, targets=own).toPandas()
        assert (got.reached <= got.tokens + 1e-6).all() and ((got.reached - got.goal).abs() <= 0.01 * got.goal).all()
        whole = got[got.margin == "lang"].tokens.sum()
        for _, m in got.groupby("margin"):
            assert m.goal.sum() == pytest.approx(fraction * whole) and m.wanted.sum() == pytest.approx(fraction * whole)
            short = m.wanted > m.tokens
            assert (m.goal[short] == m.tokens[short]).all()  # what a value lacks goes to the others in proportion
            free = m[m.goal < m.tokens]
            assert (free.goal / free.wanted).max() == pytest.approx((free.goal / free.wanted).min())
        if own:
            assert got[got.margin == "lang"].set_index("value").wanted["de"] == pytest.approx(0.3 * fraction * whole)


def test_mixing_samples_what_its_cells_say(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mix(docs).toPandas()
    assert got.probability.between(0, 1).all() and len(got) == docs.count()
    assert abs(got[got.sampled].tokens.sum() / (got.tokens * got.probability).sum() - 1) < 0.05
    assert abs((got.tokens * got.probability).sum() / got.tokens.sum() - 0.5) < 0.005


def test_mixing_by_given_topics_and_contradicting_targets(spark):
    docs = spark.createDataFrame([(i, "one two three", "en", "a" if i % 2 else "b", "x" if i % 2 else "y") for i in range(200)], "doc_id long, text string, lang string, source string, kind string")
    targets = {"source": {"a": 0.9, "b": 0.1}, "topic": {"x": 0.1, "y": 0.9}}  # a is x and b is y: both can't be met
    got = mixing.mix(docs, 0.3, targets=targets, topic=F.col("kind")).toPandas()
    assert set(got.topic) == {"x", "y"} and got.probability.between(0, 1).all()
