"""Work by blocks against plain windows over whole sessions, with blocks and cells of a few rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from oculith.functions.columns import student_quantile, two_sided_p
from oculith.operators import align, kinematics, latency, ordered, studies, uncertainty
from oculith.plans import catalog
from oculith.sources import stored
from tests.test_queries import SF, rows


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    data = []
    for session, n in ((1, 400), (2, 7), (3, 1), (4, 150)):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.0, 0.01, 0.01, 0.3, 45.0 if i % 50 == 0 else 0.02])
            data.append((session, i, t, rng.random() if rng.random() > 0.1 else None, rng.random() < (0.95 if session == 1 else 0.5)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "session_id long, src long, time_sec double, x double, flag boolean").repartition(5).cache()


def same(got, want):
    return rows(got.toPandas()) == rows(want.toPandas())


def test_numbers_and_totals(frame):
    w = Window.partitionBy("session_id").orderBy("time_sec", "src")
    got = ordered.numbered(frame, ("session_id",), ("time_sec", "src"), ordered.cell_of("time_sec", 0.5), "n", "all", ("low", F.col("x")))
    own = Window.partitionBy("session_id")
    assert same(got, frame.withColumns({"n": F.row_number().over(w), "all": F.count(F.lit(1)).over(own), "low": F.min("x").over(own)}))


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_neighbours_and_running_values(frame, size):
    df = ordered.dense(frame, tie="src", name="n")
    w = Window.partitionBy("session_id").orderBy("n")
    make = lambda w: {"back": F.lag("x", 3).over(w), "ahead": F.lead("x", 2).over(w), "mean": kinematics.rolling_mean("x", 3, 2, w)}
    assert same(ordered.over(df, make, before=3, after=2, row="n", size=size), df.withColumns(make(w)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    for fold in (F.sum, F.max, F.min):
        got = ordered.running(df, "r", F.coalesce("x", F.lit(0.5)), fold, row="n", size=size)
        assert same(got, df.withColumn("r", fold(F.coalesce("x", F.lit(0.5))).over(so_far)))


@pytest.mark.parametrize("size", [4, 50, 1000])
def test_islands_over_many_blocks(frame, size):
    df = ordered.dense(frame, tie="src", name="n")
    w = Window.partitionBy("session_id").orderBy("n")
    for starts in (lambda w: F.col("flag") != F.lag("flag", 1, False).over(w), lambda w: F.col("flag") & ~F.lag("flag", 1, False).over(w)):
        got = ordered.islands(df, starts, "flag", row="n", size=size)
        want = df.withColumn("s", starts(w).cast("long"))
        want = want.withColumn("island", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("s")
        own, on = Window.partitionBy("session_id", "island"), F.when(F.col("flag"), F.col("time_sec"))
        assert same(got, want.withColumns({"island_rows": F.count(on).over(own), "island_low": F.min(on).over(own), "island_high": F.max(on).over(own)}))


def test_tiles(frame):
    df = ordered.dense(frame, tie="src", name="n", total="all")
    w = Window.partitionBy("session_id").orderBy("n")
    for k in (1, 4, 9):
        assert same(df.select("session_id", "n", ordered.tile(k, F.col("n"), F.col("all")).alias("t")), df.select("session_id", "n", F.ntile(k).over(w).alias("t")))


@pytest.mark.parametrize("cells", [2, 16, 256])
def test_exact_quantiles(frame, cells):
    asked = (0.0, 0.02, 0.25, 0.5, 0.731, 1.0)
    df = frame.withColumn("x", F.round("x", 2))
    exact = F.percentile("x", F.array(*map(F.lit, asked)))
    for keys in (("session_id",), ()):
        got = {tuple(r[k] for k in keys): list(r["q"]) for r in ordered.quantiles(df, "x", asked, keys, cells=cells).collect()}
        want = {tuple(r[k] for k in keys): r["q"] for r in df.groupBy(*keys).agg(exact.alias("q")).collect() if r["q"]}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_operators_on_small_blocks_as_on_large(spark, monkeypatch):
    names = ("w1_velocity", "w2_fixations_deg", "w3_fixations_norm", "w8_rolling_mean", "w9_central_velocity", "w16_fixation_increments", "a18_p3_accumulation", "w5_time_gaps", "j11_event_membership", "a32_slice_heatmaps")
    want = {n: rows(catalog.queries()[n](spark, SF).toPandas()) for n in names}
    monkeypatch.setattr(ordered, "BLOCK", 130)
    for n in names:
        assert rows(catalog.queries()[n](spark, SF).toPandas()) == want[n], n


def test_plans_hold_no_whole_session(spark):
    """Windows over gaze are dealt by session and cell or block; by session alone only what has one row a cell or block."""
    small = ("__n#", "__low#", "__end#", "__most#", "end#", "n#")
    for name in ("j1_interval_join_asof", "w2_fixations_deg", "w3_fixations_norm", "a12_velocity_distribution", "a16_p2_independence", "a22_p5_calibration_drift"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if re.search(r"Window \[.*, \[session_id#\d+L?\](, |$)", line):
                assert any(f"({c}" in line for c in small), line[:400]


def test_cross_correlation_by_blocks(spark):
    rng = np.random.default_rng(1)
    data = [(s, int(i), float(rng.random()), float(rng.random() < 0.3)) for s in (1, 2) for i in range(0, 300) if rng.random() < 0.9]
    df = spark.createDataFrame(data, "session_id long, idx long, gaze double, event double")
    whole, parts = (latency.cross_correlation(df, 20, size=n).toPandas() for n in (1000, 37))
    assert rows(whole) == rows(parts)
    for r in whole.itertuples():
        a, b = ({i: v[k] for s, i, *v in data if s == r.session_id} for k in (0, 1))
        both = [(a[i], b[i + r.lag]) for i in a if i + r.lag in b]
        assert r.n == len(both) and r.r == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)


def test_bootstrap_draws_gaze_and_keeps_events(spark):
    """Gaze that repeats the event 3 positions later: the estimate is sharp, and lost when gaze is drawn at random."""
    event = [float(i % 40 < 5) for i in range(400)]
    data = [(1, i, event[i - 3] if i >= 3 else 0.0, event[i]) for i in range(400)]
    df = spark.createDataFrame(data, "session_id long, idx long, gaze double, event double")
    assert latency.latency(df, 10, 10.0).first()["latency_ms"] == 300.0
    out = studies.bootstrap_latency(df, 30, 10, 10.0).first()
    assert out["n"] == 30 and out["sd_ms"] > 100


def test_bootstrap_in_blocks_equals_draws_by_hand(spark):
    """Draws that cross blocks of positions and of samples, gaps of positions, and a session of one sample."""
    rng = np.random.default_rng(6)
    data = [(s, i, float(rng.random()), float(rng.random() < 0.3)) for s, n in ((1, 150), (2, 90)) for i in range(n) if rng.random() < 0.85] + [(3, 0, 0.5, 1.0)]
    df = spark.createDataFrame(data, "session_id long, idx long, gaze double, event double")
    got = {r["session_id"]: r for r in studies.bootstrap_latency(df, 12, 5, 10.0, size=16).collect()}
    assert {k: r["sd_ms"] for k, r in got.items()} == {r["session_id"]: pytest.approx(r["sd_ms"]) for r in studies.bootstrap_latency(df, 12, 5, 10.0).collect()}
    assert sorted(got) == [1, 2]
    for session in (1, 2):
        own = sorted((i, g, e) for s, i, g, e in data if s == session)
        event, found = {i: e for i, _, e in own}, []
        for replicate in range(1, 13):
            drawn = {i: own[int(hashlib.md5(f"{session}-{replicate}-{i}".encode()).hexdigest()[:8], 16) % len(own)][1] for i in event}
            score = {}
            for lag in range(-5, 6):
                pairs = np.array([(drawn[i], event[i + lag]) for i in drawn if i + lag in event])
                score[lag] = abs(np.corrcoef(pairs.T)[0, 1])
            found.append(-100.0 * max(score, key=lambda k: (round(score[k], 12), -k)))
        assert got[session]["n"] == 12 and got[session]["sd_ms"] == pytest.approx(np.std(found, ddof=1))


def test_bootstrap_moves_packed_draws(spark):
    df = spark.createDataFrame([(1, i, float(i % 7), float(i % 3)) for i in range(100)], "session_id long, idx long, gaze double, event double")
    plan = studies.bootstrap_latency(df, 5, 3, 10.0, size=32)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence" not in plan and "FlatMapCoGroupsInPandas" in plan


def test_roc_against_all_thresholds(spark):
    rng = np.random.default_rng(2)
    data = [(int(k), float(np.round(rng.normal(y, 1), 1)), int(y)) for k in (1, 2) for y in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(data, "k int, s double, y int")
    for cells in (3, 256):
        points = latency.roc_points(df, "s", "y", ("k",), cells).collect()
        for r in points:
            own = [(s, y) for k, s, y in data if k == r["k"]]
            assert r["tp"] == sum(y for s, y in own if s >= r["threshold"]) and r["fp"] == sum(1 - y for s, y in own if s >= r["threshold"])
    for r in latency.roc(df, "s", "y", ("k",)).collect():
        pos, neg = ([s for k, s, y in data if k == r["k"] and y == v] for v in (1, 0))
        assert r["auc"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
    r = latency.confusion(df, F.col("y") == 1, F.col("s") > 0.5).first()
    assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 600 and r["sensitivity"] == r["tp"] / (r["tp"] + r["fn"])


def test_p_values(spark):
    known = [(2.0, 10.0, 0.07338803), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (12.706204736, 1.0, 0.05), (1.959963985, 1e6, 0.05), (4.0, 998.0, 6.794e-05)]
    got = spark.createDataFrame(known, "t double, f double, p double").select(two_sided_p(F.col("t"), F.col("f")).alias("got"), "p").collect()
    assert all(r["got"] == pytest.approx(r["p"], rel=2e-3, abs=1e-7) for r in got)
    assert student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and student_quantile(0.975, 5000) == pytest.approx(1.960439, abs=1e-4)


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(3, 1, (500, 2))
    y = 1 + x @ [2.0, -0.5] + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    got = {r["term"]: r for r in studies.linear_model(df, ("a", "b"), "y").collect()}
    design = np.column_stack([x, np.ones(500)])
    beta, rss, _, _ = np.linalg.lstsq(design, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 497)
    for name, b, s in zip(("a", "b", "intercept"), beta, se):
        r = got[name]
        assert r["estimate"] == pytest.approx(b) and r["std_error"] == pytest.approx(s) and r["high"] - r["low"] == pytest.approx(2 * 1.964749 * s, rel=1e-4)
    assert studies.linear_model(df.limit(2), ("a", "b"), "y").count() == 0


def test_success_model_predicts_on_a_grid(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 4, 2000)
    df = spark.createDataFrame([(float(v), bool(rng.random() < 1 / (1 + math.exp(3 - 2 * v)))) for v in x], "v double, success boolean")
    model = studies.logistic_model(df, ("v",), "success")
    rows = {r["v"]: r for r in model.predicted(spark.createDataFrame([(0.0,), (1.5,), (3.0,), (None,)], "v double")).collect()}
    got = {v: r["probability"] for v, r in rows.items()}
    assert got[None] is None and all(rows[v]["probability_low"] < got[v] < rows[v]["probability_high"] for v in (0.0, 1.5, 3.0))
    assert got[1.5] == pytest.approx(0.5, abs=0.06) and got[0.0] < 0.1 and got[3.0] > 0.9


def test_success_model_with_products_equals_newton_on_plain_features(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(1, 6, (3000, 2)).astype(float) * [1.0, 40.0]
    y = rng.random(3000) < 1 / (1 + np.exp(2 - 0.3 * x[:, 0] - 0.01 * x[:, 1] + 0.002 * x[:, 0] * x[:, 1]))
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, True)], "a double, b double, y boolean")
    model = studies.logistic_model(df, ("a", "b"), "y")
    design, beta = np.c_[np.ones(3000), x, x[:, 0] * x[:, 1]], np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        h = (design * (p * (1 - p))[:, None]).T @ design
        beta = beta + np.linalg.solve(h, design.T @ (y - p))
    got = {r["term"]: r for r in model.table(spark).collect()}
    assert model.terms == ((), ("a",), ("b",), ("a", "b")) and model.rows == 3000 and model.rounds < 12
    for name, b, s in zip(("intercept", "a", "b", "a:b"), beta, np.sqrt(np.diag(np.linalg.inv(h)))):
        assert got[name]["estimate"] == pytest.approx(b, rel=1e-6) and got[name]["std_error"] == pytest.approx(s, rel=1e-6)


def test_success_models_without_a_fit(spark):
    fit = lambda rows: studies.logistic_model(spark.createDataFrame(rows, "a double, y boolean"), ("a",), "y")
    assert [fit(rows).fault for rows in ([(None, True)], [(1.0, True), (2.0, True)], [(1.0, True), (1.0, False)], [(float(i), i > 5) for i in range(10)])] == ["one label only", "one label only", "constant feature", "labels are separated"]
    model = fit([(1.0, True)])
    assert model.table(spark).count() == 0 and model.predicted(spark.range(1).selectExpr("1d as a")).first()["probability"] is None


def test_stored_frames_are_removed(spark):
    df = stored.stored(spark.range(5), "test")
    assert df.count() == 5
    path = next(iter(p for p in stored._TABLES if "/test-" in p))
    stored.clear()
    assert path not in stored._TABLES
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_nearest_and_fallback_without_pairs(spark):
    g = spark.createDataFrame([(1, i, 1000 * i, 0.5, 0.5) for i in range(0, 3000, 7)], "session_id long, src_id long, device_time_stamp long, gaze_point_on_display_area_x double, gaze_point_on_display_area_y double")
    z = spark.createDataFrame([(1, i, 100.0 * i, "AXIAL", (i % 5) / 4, "img") for i in range(20)], "session_id long, src_id long, client_timestamp double, plane string, index double, image_id string")
    late = align.align(align.gaze_clock(g), align.event_clock(z), coverage_threshold=0.0, latency=50.0, fallback=True)
    assert {(r["z_event_id"], r["integration_mode"]) for r in late.collect()} == {(20, "normal_alt")}
    near = uncertainty.nearest_transition(align.gaze_clock(g), align.event_clock(z).withColumnRenamed("z_time_sec", "transition_time"), "time_sec")
    assert near.filter("dist_to_transition > 0.0501 and time_sec < 1.9").count() == 0
