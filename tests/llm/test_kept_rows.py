"""Which rows the filtering stages keep of a table with null and repeated ids, exactly."""

import pytest

from oculith.llm import exact_dedup, mixing, near, simhash
from tests.llm.test_operators import AWKWARD, DOCS

MORE = [
    (None, None, None, None, None),
    (None, "no id", "de", "c", 5),
    (None, "SAME", "de", "c", 4),
    (20, "only here, in no other row at all", "en", "a", 33),
    (20, "twice", "en", "a", 5),
    (21, "twice", "en", "a", 5),
]
ROWS = AWKWARD + MORE


def kept(frame):
    return sorted(((r["doc_id"], r["text"], r["source"], r["h"]) for r in frame.collect()), key=repr)


def want(rows):
    return sorted(((r[0], r[1], r[3], "x") for r in rows), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", "p", 7) for r in ROWS], DOCS).repartition(3)


def test_exact_copies(table):
    gone = [(1, "Alpha beta gamma delta epsilon"), (3, None), (20, "twice"), (None, None), (None, "SAME")]
    left = [r for r in ROWS if (r[0], r[1]) not in gone]
    assert kept(exact_dedup.keep_distinct(table)) == want(dict.fromkeys(left))


@pytest.mark.parametrize("keep", [simhash.keep_one, near.keep_one])
def test_near_copies(table, keep):
    got = kept(keep(table))
    ids = [r[0] for r in got]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 8, 9, 10, 20, 20]
    assert [r[1] for r in got if r[0] is None] == ["no id"]


def test_sampled_rows(table):
    for fraction in (0.2, 0.5, 1.0):
        decided = sorted(((r["doc_id"], r["source"]) for r in mixing.mix(table, fraction=fraction).filter("sampled").collect()), key=repr)
        got = sorted(((r[0], r[2] or mixing.NONE) for r in kept(mixing.keep_sampled(table, fraction=fraction))), key=repr)
        assert got == decided
    assert any(r[0] is None for r in decided)
