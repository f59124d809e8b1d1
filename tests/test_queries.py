"""Registered queries against DuckDB on the same tables, and hand-made recordings."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from oculith.functions.columns import normal_cdf, require_columns
from oculith.operators import align, kinematics
from oculith.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("events", "nation", "documents", "conversations", "labels")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    show = lambda v: "None" if v is None or v != v else repr(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def recording(spark, gaze, events):
    g = spark.createDataFrame([(1, i, t, 0.5, 0.5) for i, t in enumerate(gaze)], "session_id long, src_id long, device_time_stamp long, gaze_point_on_display_area_x double, gaze_point_on_display_area_y double")
    z = spark.createDataFrame([(1, i, float(t), "AXIAL", x, "img") for i, (t, x) in enumerate(events)], "session_id long, src_id long, client_timestamp double, plane string, index double, image_id string")
    return align.gaze_clock(g), align.event_clock(z)


@pytest.mark.parametrize("method", ["asof", "range"])
def test_equal_event_times_and_rows_outside(spark, method):
    g, z = recording(spark, [0, 1_000_000, 1_000_000, 90_000_000], [(0, 0.1), (1000, 0.2), (1000, 0.3), (90_000, 0.4)])
    got = sorted((r["gaze_id"], r["z_event_id"]) for r in align.align(g, z, method=method).collect())
    assert got == [(1, 1), (2, 3), (3, 3), (4, 4)]


def test_single_event_matches_all_and_empty_events_none(spark):
    g, z = recording(spark, [0, 5, 10], [(7, 0.1)])
    assert {r["integration_mode"] for r in align.align(g, z).collect()} == {"single_event"} and align.align(g, z).count() == 3
    assert align.align(g, z.limit(0)).count() == 0


def test_fallback_numbers_one_past(spark):
    g, z = recording(spark, [0, 1_000_000], [(0, 0.1), (100, 0.2)])
    late = align.align(g, z, coverage_threshold=0.0, latency=50.0, fallback=True).collect()
    assert {(r["z_event_id"], r["integration_mode"]) for r in late} == {(2, "normal_alt")}


def test_missing_columns_and_zero_time(spark):
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "nope")
    g, _ = recording(spark, [0, 0, 10], [(0, 0.1)])
    assert [r["velocity_norm"] for r in kinematics.velocity(g).orderBy("gaze_id").collect()] == [None, None, 0.0]


def test_normal_cdf(spark):
    got = spark.createDataFrame([(x / 4,) for x in range(-16, 17)], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) < 1e-6 for r in got)
