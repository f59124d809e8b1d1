"""Matrices as columns against numpy, faults, and volumes with published matrices next to each other."""

import numpy as np
from pyspark.sql import functions as F

from oculith.operators import geometry, matrices
from tests.test_geometry import OBLIQUE



def table(spark, *matrices_):
    return spark.createDataFrame([(i, None if m is None else [list(map(float, row)) if row is not None else None for row in m]) for i, m in enumerate(matrices_)], "id int, m array<array<double>>")


def test_algebra_equals_numpy(spark):
    random = np.random.default_rng(4)
    own = random.normal(size=(30, 4, 4))
    df = table(spark, *own)
    got = df.select("id", matrices.inverse(F.col("m")).alias("inv"), matrices.determinant(F.col("m")).alias("det"), matrices.product(F.col("m"), matrices.transpose(F.col("m"))).alias("square"), matrices.translated(F.col("m"), 1.0, -2.0, 0.5).alias("moved"), matrices.scaled(F.col("m"), 2.0, 3.0, -1.0).alias("scaled"), F.array(*matrices.applied(F.col("m"), F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("at"), matrices.fault(F.col("m")).alias("fault")).orderBy("id").collect()
    for r, m in zip(got, own):
        shift = np.eye(4)
        shift[:3, 3] = 1.0, -2.0, 0.5
        assert np.allclose(r["inv"], np.linalg.inv(m)) and np.isclose(r["det"], np.linalg.det(m)) and np.allclose(r["square"], m @ m.T)
        assert np.allclose(r["moved"], m @ shift) and np.allclose(r["scaled"], m @ np.diag([2, 3, -1, 1])) and np.allclose(r["at"], (m @ [1, 2, 3, 1])[:3])
        assert r["fault"] is None


def test_rotations(spark):
    turns = [(a, matrices.rotation(a, 0.8, 0.6)) for a in "xyz"]
    row = spark.range(1).select(*[t.alias(a) for a, t in turns], matrices.product(turns[0][1], matrices.inverse(turns[0][1])).alias("unit")).first()
    assert np.allclose(row["x"], [[1, 0, 0, 0], [0, 0.8, -0.6, 0], [0, 0.6, 0.8, 0], [0, 0, 0, 1]])
    assert np.allclose(row["y"], [[0.8, 0, 0.6, 0], [0, 1, 0, 0], [-0.6, 0, 0.8, 0], [0, 0, 0, 1]])
    assert np.allclose(row["z"], [[0.8, -0.6, 0, 0], [0.6, 0.8, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]) and np.allclose(row["unit"], np.eye(4))


def test_matrices_without_inverse(spark):
    nan = float("nan")
    df = table(spark, None, np.zeros((4, 4)), np.diag([1e-4, 1e-4, 1e-4, 1]), np.diag([1, 1, nan, 1]), np.eye(3), [*np.eye(4)[:3], None], np.diag([1, 1, 1e-9, 1]))
    got = df.select("id", matrices.fault(F.col("m")).alias("fault"), F.when(matrices.fault(F.col("m")).isNull(), matrices.inverse(F.col("m"))).alias("inv")).orderBy("id").collect()
    assert [r["fault"] for r in got] == ["no matrix", "singular", "singular", "not finite", "not 4 x 4", "not 4 x 4", None]
    assert [r["inv"] is None for r in got] == [True] * 6 + [False]


def test_volumes_side_by_side(spark):
    rows = [(1, [512, 512, 25], list(OBLIQUE.pixdim), [list(r) for r in OBLIQUE.affine]), (2, [100, 100, 50], [1.0, 1.0, 2.0], np.diag([1.0, 1, 2, 1]).tolist()), (3, [2, 2, 2], [1.0, 1.0, 0.0], np.diag([1.0, 1, 0, 1]).tolist())]
    got = {r["id"]: r for r in matrices.prepared(spark.createDataFrame(rows, "id int, dims array<int>, pixdim array<double>, affine array<array<double>>")).collect()}
    assert np.allclose(got[1]["frac2mm"], OBLIQUE.frac2mm()) and np.allclose(got[1]["ortho"], OBLIQUE.ortho()) and np.allclose(got[1]["inverse"], OBLIQUE.inverse())
    assert np.allclose(np.array(got[1]["mm2frac"]) @ OBLIQUE.frac2mm(), np.eye(4), atol=1e-9)
    assert np.allclose(np.subtract(got[2]["high"], got[2]["low"]), 100) and got[2]["fault"] is None
    assert got[3]["fault"] == "singular" and got[3]["inverse"] is got[3]["frac2mm"] is got[3]["low"] is None


def test_round_trips_differ_by_volume(spark):
    rows = [(v, g, "AXIAL", 0.3, 0.62, 0.5) for v in (1, 2) for g in (0,)] + [(1, 1, "CORONAL", None, 0.5, 0.5), (1, 2, "UPSIDE", 0.5, 0.5, 0.5), (2, 3, "SAGITTAL", 1.7, -3.0, 1.0)]
    volumes = spark.createDataFrame([(1, [11, 21, 5], np.diag([1.0, 2.0, 3.0, 1.0]).tolist(), np.diag([1.0, 0.5, 1 / 3, 1.0]).tolist()), (2, [101, 21, 5], np.diag([0.1, 2.0, 3.0, 1.0]).tolist(), np.diag([10.0, 0.5, 1 / 3, 1.0]).tolist())], "volume_id int, dims array<int>, affine array<array<double>>, inverse array<array<double>>")
    df = spark.createDataFrame(rows, "volume_id int, gaze_id int, plane string, gaze_x double, gaze_y double, slice_index double").join(volumes, "volume_id")
    got = {(r["volume_id"], r["gaze_id"]): r for r in geometry.round_trips(df).collect()}
    one, two, end = got[1, 0], got[2, 0], got[2, 3]
    assert (one["voxel_i"], one["voxel_j"], one["voxel_k"], one["slice_num"]) == (3, 12, 2, 3) and (two["voxel_i"], two["voxel_j"]) == (30, 12)
    assert np.isclose(one["voxel_error"], 0.4) and np.isclose(one["mm_error"], 0.8) and np.isclose(one["screen_error"], 0.02)
    assert (end["voxel_i"], end["voxel_j"], end["voxel_k"]) == (100, 20, 0) and end["voxel_error"] == 0
    assert got[1, 1]["voxel_error"] is None and got[1, 2]["voxel_i"] is None
