"""Cells of time that hold many rows: work there grows with the rows, not with their square."""

import random

from pyspark.sql import functions as F

from oculith.operators import align
from oculith.operators.ordered import quantiles
from oculith.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_reads_no_cell_again_from_every_row(spark):
    own = random.Random(7)
    samples = [(s, i, own.choice([own.uniform(-40, 100), float(own.randrange(90))])) for s in (1, 2, 3) for i in range(300)]
    marks = [(s, float(own.randrange(90))) for s in (1, 2) for _ in range(25)]
    left, right = spark.createDataFrame(samples, "session_id long, gaze_id long, t double"), spark.createDataFrame(marks, "session_id long, m double")
    got = align.nearest(left, right, "t", "m", "d")
    want = {(s, i): min((abs(t - m) for k, m in marks if k == s), default=None) for s, i, t in samples}
    assert {(r["session_id"], r["gaze_id"]): r["d"] for r in got.collect()} == want
    assert "unboundedfollowing" not in plan_of(got).lower()


def test_quantiles_find_a_value_s_cell_by_halves(spark):
    own = random.Random(8)
    values = [(k, float(own.randrange(40)) if k else own.uniform(0, 1)) for k in (0, 1) for _ in range(3000)]
    df = spark.createDataFrame(values, "session_id long, v double")
    got = {r["session_id"]: r["q"] for r in quantiles(df, "v", (0.0, 0.1, 0.5, 0.99, 1.0)).collect()}
    for k in (0, 1):
        v = sorted(x for s, x in values if s == k)
        for p, q in zip((0.0, 0.1, 0.5, 0.99, 1.0), got[k]):
            at = p * (len(v) - 1)
            low = int(at)
            assert abs(v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low]) - q) < 1e-12
    assert "filter(__cuts" not in plan_of(quantiles(df, "v", (0.5,)))


def test_sides_dealt_by_session_are_dealt_anew_by_cell(spark):
    """A union of sides that joins left dealt by session kept that dealing, and its partitions stopped matching at size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = spark.createDataFrame([(s, i, float(i)) for s in (1, 2) for i in range(90)], "session_id long, gaze_id long, t double")
        marks = spark.createDataFrame([(s, i, i * 7.0) for s in (1, 2) for i in range(9)], "session_id long, mark_id long, m double")
        own = spark.createDataFrame([(1,), (2,)], "session_id long")
        left, right = samples.join(own, "session_id"), marks.join(own, "session_id")
        found = align.as_of(left, right, "t", "m", (), "mark_id", reach=(F.col("m"), F.col("m") + 90))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert any("Exchange hashpartitioning" in line and "cell" in line for line in plan.splitlines())
        assert {(r["gaze_id"], r["hit"]["tie"]) for r in found.collect()} == {(i, min(i // 7, 8)) for i in range(90)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_held_counts_equal_pairs(spark):
    own = random.Random(9)
    samples = [(s, i, own.choice([own.uniform(-40, 130), float(own.randrange(100))])) for s in (1, 2, 3) for i in range(300)] + [(1, 900, None)]
    intervals = []
    for s in (1, 2):
        starts = sorted(float(own.randrange(90)) for _ in range(40))
        intervals += [(s, k, a - 2, b + 3) for k, (a, b) in enumerate(zip(starts, [*starts[1:], 95.0])) if a < b]
    left, right = spark.createDataFrame(samples, "session_id long, gaze_id long, t double"), spark.createDataFrame(intervals, "session_id long, k long, low double, high double")
    want = {}
    for s, i, t in samples:
        on = [k for z, k, low, high in intervals if t is not None and z == s and low <= t < high]
        if on:
            want[s, i] = (len(on), min(on), max(on))
    for bucket in (4.0, 30.0, 1e4):
        got = align.held(left, right, "t", "low", "high", "k", bucket)
        assert {(r["session_id"], r["gaze_id"]): (r["n"], r["first"], r["last"]) for r in got.collect()} == want


def test_short_intervals_meet_few_samples(spark):
    """Sixteen times as many intervals, a sixteenth as long, in the same time: no more of them meet a sample."""
    met = []
    for n in (256, 4096):
        step = 32.0 / n
        intervals = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("k"), (F.col("id") * step).alias("low"), ((F.col("id") + 1) * step).alias("high"), F.lit(1e9).alias("far"))
        samples = spark.range(1024).selectExpr("1L as session_id", "id as gaze_id", "id / 32e0 as t")
        assert {(r["gaze_id"], r["k"]) for r in align.overlapping(samples, intervals, "t", "low", "high").collect()} == {(i, int(i / 32 / step)) for i in range(1024)}
        met.append(align.overlapping(samples, intervals, "t", "low", "far", (F.col("low"), F.col("high"))).count())  # of those that share a cell
    assert max(met) <= 4 * 1024


def test_error_summary_reads_round_trips_worked_out_once(spark):
    files = catalog.queries()["a49_error_summary"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/trips-" in f for f in files)
