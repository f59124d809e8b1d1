"""Overlapping intervals against plain pairs, and files with faults, by hand."""

import random

from pyspark.sql import functions as F

from oculith.operators import align
from oculith.sources import files


def tables(spark, seed=2):
    own = random.Random(seed)
    samples = [(s, i, own.uniform(-50, 400)) for s in (1, 2, 3) for i in range(200)] + [(1, 900, None), (None, 901, 5.0)]
    intervals = [(s, i, (at := own.uniform(-60, 380)), at + own.choice([0.0, 0.1, 7.0, 90.0, 500.0])) for s in (1, 2, 4) for i in range(60)] + [(1, 70, None, 5.0), (1, 71, 5.0, None), (1, 72, 30.0, 60.0), (1, 73, 9.0, 8.0)]
    samples += [(1, 902, 30.0), (1, 903, 60.0)]
    return samples, intervals, spark.createDataFrame(samples, "session_id long, gaze_id long, t double"), spark.createDataFrame(intervals, "session_id long, id long, low double, high double")


def test_every_overlapping_interval_is_found(spark):
    samples, intervals, s, z = tables(spark)
    want = sorted((g, i) for a, g, t in samples for b, i, low, high in intervals if a is not None and a == b and None not in (t, low, high) and low <= t < high)
    for bucket in (3.0, 30.0, 10_000.0):
        assert sorted((r["gaze_id"], r["id"]) for r in align.overlapping(s, z, "t", "low", "high", bucket=bucket).collect()) == want
    clipped = align.overlapping(s, z, "t", "low", "high", (F.greatest("low", F.lit(-50.0)), F.least("high", F.lit(400.0))))
    assert sorted((r["gaze_id"], r["id"]) for r in clipped.collect()) == want and (902, 72) in want and (903, 72) not in want


def test_no_exchange_on_session_alone(spark):
    *_, s, z = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = align.overlapping(s, z, "t", "low", "high")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("__cell" in line for line in exchanges)


def test_files_with_faults(spark, tmp_path):
    texts = {
        "a/x.csv": "id,x,y\n1,2.5,3\n2,oops,4\n3,1\n4,1,2,3\n\n5,NA,\nid,x,y\n",
        "b/x.csv": '﻿"y", x ,note,id\r\n7,"8",hi,6\r\n',
        "c/x.csv": "1,2,3\n4,5,6\n",
        "d/x.csv": "id,y\n9,1\n",
        "e_results/x.csv": "id,x,y\n1,2,3\n",
        "f/x.csv": "",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    rows, faults = files.audited(spark, f"file://{tmp_path}", "*.csv", "id long, x double, y double")
    got = sorted((r["session_id"], r["id"], r["x"], r["y"]) for r in rows.collect())
    assert got == [("a", 1, 2.5, 3.0), ("a", 2, None, 4.0), ("a", 5, None, None), ("b", 6, 8.0, 7.0), ("d", 9, None, 1.0)]
    found = sorted((r["session_id"], r["reason"], r["column"], r["line"]) for r in faults.collect())
    assert found == [("a", "long line", None, "4,1,2,3"), ("a", "short line", None, "3,1"), ("a", "unreadable value", "x", "2,oops,4"), ("c", "no header", None, None), ("d", "missing column", "x", None)]
    rows, faults = files.audited(spark, f"file://{tmp_path}", "*.none", "id long, x double, y double")
    assert rows.count() == faults.count() == 0
