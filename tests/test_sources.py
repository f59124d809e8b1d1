"""Volume files, recordings as files, streams, and study operators against plain versions."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from oculith.operators import heatmap, studies
from oculith.sources import files, volumes
from oculith.streaming import assignment


def nifti(data, affine, order="<", slope=0.0, inter=0.0):
    raw = bytearray(352)
    nx, ny, nz = data.shape
    struct.pack_into(order + "i", raw, 0, 348)
    struct.pack_into(order + "8h", raw, 40, 3, nx, ny, nz, 1, 1, 1, 1)
    struct.pack_into(order + "2h", raw, 70, 4, 16)
    struct.pack_into(order + "8f", raw, 76, 1, 2, 2, 3, 0, 0, 0, 0)
    struct.pack_into(order + "3f", raw, 108, 352, slope, inter)
    struct.pack_into(order + "2h", raw, 252, 0, 1)
    struct.pack_into(order + "12f", raw, 280, *np.asarray(affine)[:3].ravel())
    return bytes(raw) + data.astype(order + "i2").tobytes(order="F")


def test_volumes(spark, tmp_path):
    data = np.arange(60).reshape(3, 4, 5)
    affine = [[2, 0, 0, -3], [0, 2, 0, -4], [0, 0, 3, 5], [0, 0, 0, 1]]
    (tmp_path / "a.nii").write_bytes(nifti(data, affine))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti(data, affine, ">", 2.0, 1.0)))
    (tmp_path / "bad.nii").write_bytes(b"nothing")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in volumes.volumes(spark, str(tmp_path)).collect()}
    assert rows["a.nii"]["dims"] == [3, 4, 5] and rows["a.nii"]["pixdim"] == [2, 2, 3] and rows["b.nii.gz"]["affine"] == affine and rows["bad.nii"]["error"]
    v = volumes.voxels(spark, str(tmp_path))
    got = {(r["path"].rsplit("/", 1)[1], r["i"], r["j"], r["k"]): r["value"] for r in v.collect()}
    assert len(got) == 120 and all(got["a.nii", i, j, k] == data[i, j, k] and got["b.nii.gz", i, j, k] == 2 * data[i, j, k] + 1 for i, j, k in np.ndindex(3, 4, 5))
    assert volumes.slice_matrix(v, "CORONAL", 4).count() == 30 and volumes.slice_matrix(v, "AXIAL", 99).count() == 0
    assert volumes.spaced_slices(25) == [1, 4, 7, 10, 13, 16, 19, 22, 25] and volumes.spaced_slices(1) == [1]


def test_files(spark, tmp_path):
    for case in ("one", "two", "results_old"):
        (tmp_path / case).mkdir()
        (tmp_path / case / "gaze.csv").write_text("device_time_stamp,system_time_stamp,gaze_point_on_display_area_x,gaze_point_on_display_area_y\n1,2,0.5,0.5\n2,3,,0.25\n")
    for plane in ("AXIAL", "SAGITTAL"):
        (tmp_path / "one" / f"{plane}_slice_events.csv").write_text(f"client_timestamp,plane,index,image_id\n5,{plane},0.5,x\n")
    g, z = files.gaze(spark, str(tmp_path)), files.slice_events(spark, str(tmp_path))
    assert sorted(r["session_id"] for r in g.collect()) == ["one", "one", "two", "two"] and z.count() == 2
    assert [tuple(r) for r in files.missing_sessions(g, z).collect()] == [("two", "no slice events")]
    points = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (1.0, None, 3.0, 4.0)], "mm_x double, mm_y double, mm_z double, intensity double")
    files.write_points(points, str(tmp_path / "points"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "points")).collect()] == ["1.0 2.0 3.0 4.0"]
    files.write_csv(points, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert files.sampled(spark.range(100), "id", n=7).collect() == files.sampled(spark.range(100), "id", n=7).collect()


def test_stream_equals_table(spark, tmp_path):
    gaze = spark.range(40).selectExpr("id % 2 as session_id", "timestamp_seconds(1000 + id) as at", "id / 40e0 as gaze_x", "0.5e0 as gaze_y")
    shown = spark.range(8).selectExpr("id % 2 as session_id", "timestamp_seconds(1000 + id * 5) as start", "timestamp_seconds(1004 + id * 5) as end", "id as slice")
    for name, df in (("g", gaze), ("z", shown)):
        df.write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    q = assignment.assign(read("g", gaze), read("z", shown)).writeStream.format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["session_id"], r["at"], r["slice"]) for r in df.collect())
    want = key(assignment.assign(gaze, shown))
    assert want and key(spark.table("assigned")) == want
    assert sum(r["n"] for r in assignment.per_slice(gaze).collect()) == 40


def test_event_signal_with_overlaps(spark):
    rng = np.random.default_rng(1)
    spans = [(int(s), float(a), float(a + b), i) for i, (s, a, b) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 400, 60), rng.integers(1, 90, 60)))]
    points = [(s, g, float(t)) for g, (s, t) in enumerate(zip(np.tile([0, 1, 2], 120).tolist(), rng.integers(0, 500, 360).tolist()))]
    z = spark.createDataFrame(spans, "session_id long, start double, end double, event_id long")
    g = spark.createDataFrame(points, "session_id long, gaze_id long, time_sec double")
    got = {r["gaze_id"]: r["signal"] for r in studies.event_signal(g, z).collect()}
    assert got == {i: int(any(s == k and a < t < b for k, a, b, _ in spans)) for s, i, t in points}


def test_grid_density_of_hot_key(spark):
    rng = np.random.default_rng(2)
    pts = [(int(i % 7 == 0), float(x), float(y), float(w)) for i, (x, y, w) in enumerate(zip(rng.random(500), rng.random(500), rng.random(500) - 0.1))]
    df = spark.createDataFrame(pts, "k long, x double, y double, weight double").repartition(5).selectExpr("*", "0.1e0 hx", "0.2e0 hy", "6 nx", "4 ny", "0e0 x0", "1e0 x1", "0e0 y0", "1e0 y1")
    got = {(r["k"], r["gx"], r["gy"]): r["density"] for r in heatmap.grid_density(df, ("k",)).collect()}
    assert len(got) == 48
    for (k, gx, gy), value in got.items():
        own = [(x, y, w) for q, x, y, w in pts if q == k and w > 0]
        kernel = lambda d, h: np.exp(-0.5 * (d / h) ** 2) / (h * np.sqrt(2 * np.pi))
        assert value == pytest.approx(sum(w * kernel(x - gx / 5, 0.1) * kernel(y - gy / 3, 0.2) for x, y, w in own) / sum(w for *_, w in own))


def test_models(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 2))
    y = x @ [2.0, -1.0] + 0.5 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(float(a), float(b), float(c), bool(c > 1)) for (a, b), c in zip(x, y)], "a double, b double, y double, success boolean")
    got = {r["term"]: r["estimate"] for r in studies.linear_model(df, ("a", "b"), "y").collect()}
    want, *_ = np.linalg.lstsq(np.c_[x, np.ones(400)], y, rcond=None)
    assert [got["a"], got["b"], got["intercept"]] == pytest.approx(list(want), abs=1e-6)
    p = studies.logistic_model(df.withColumn("success", F.col("success") != (F.rand(1) < 0.05)), ("a", "b"), "success").predicted(df).select(F.avg(((F.col("probability") > 0.5) == F.col("success")).cast("double"))).first()[0]
    assert p > 0.9
