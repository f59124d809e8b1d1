"""Published numbers of affine algebra, slices and latency direction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oculith.operators import geometry, heatmap, latency
from oculith.operators.geometry import Volume

OBLIQUE = Volume(
    (512, 512, 25),
    (0.4296875, 0.4296875, 5.0),
    (
        (0.4295729696750641, 1.4573031670295222e-10, 0.11543580144643784, -113.94583892822266),
        (-0.0032469534780830145, 0.40601974725723267, 1.6360894441604614, -120.05899047851562),
        (-0.009373842738568783, -0.14063891768455505, 4.723334312438965, 77.72416687011719),
        (0.0, 0.0, 0.0, 1.0),
    ),
)


def test_fractions_to_millimetres():
    want = [
        [219.9413604736328, 7.461392215191154e-8, 2.885895013809204, -114.21834564208984],
        [-1.6624401807785034, 207.88211059570312, 40.90223693847656, -121.07842254638672],
        [-4.799407482147217, -72.00712585449219, 118.08335876464844, 75.43750762939453],
    ]
    assert np.allclose(OBLIQUE.frac2mm()[:3], want, atol=1e-4)
    v = Volume((182, 218, 182), affine=((1, 0, 0, -90), (0, 1, 0, -126), (0, 0, 1, -72), (0, 0, 0, 1)))
    for frac, mm in ((0.5, (0.5, -17.5, 18.5)), (0, (-90.5, -126.5, -72.5)), (1, (91.5, 91.5, 109.5))):
        assert np.allclose((v.frac2mm() @ [frac, frac, frac, 1])[:3], mm)
    with pytest.raises(ValueError):
        Volume((1, 1, 1), affine=((0,) * 4,) * 4).inverse()


def test_unrotated_volume(spark):
    want = [[220, 0, 0, -114.91867065429688], [0, 220, 0, -139.10035705566406], [0, 0, 125, 29.007308959960938]]
    assert np.allclose(OBLIQUE.ortho()[:3], want, atol=1e-4)
    low, high = Volume((100, 100, 50), (1.0, 1.0, 2.0)).extents()
    assert np.allclose(high - low, 100)
    got = spark.range(1).select(*[geometry.anisotropy(F.lit(t)) for t in ("1x2x4", "2x2x2", "1xax3")]).first()
    assert list(got) == [4.0, 1.0, None]
    assert geometry.letterbox(2.0, 1.0) == {"left": 0.25, "right": 0.75, "top": 0.0, "bottom": 1.0}


def test_slice_numbers(spark):
    cases = [(0.0, 100, 1), (1.0, 100, 100), (0.5, 99, 50), (0.3, 1, 1), (0.49, 2, 1), (0.51, 2, 2), (-0.5, 100, 1), (1.5, 100, 100), (0.5, 128, 65)]
    row = spark.range(1).select(*[geometry.slice_of(F.lit(x), n).alias(f"c{i}") for i, (x, n, _) in enumerate(cases)]).first()
    assert list(row) == [want for _, _, want in cases]
    row = spark.range(1).select(*[geometry.slice_of(F.lit(0.64), 25, m) for m in ("round", "floor", "ceiling")], *[geometry.index_of(F.lit(a), n) for a, n in ((1, 100), (100, 100), (50, 99), (1, 1))]).first()
    assert list(row) == [16, 16, 17, 0.0, 1.0, 0.5, 0.5]
    with pytest.raises(ValueError):
        geometry.slice_of(F.lit(0.5), 0)


def test_canvas(spark):
    mid, corner = (spark.range(1).select(*geometry.canvas(F.lit(x), F.lit(x))).first() for x in (0.5, 0.0))
    assert np.allclose(mid, (0.5, 0.4744), atol=1e-3) and np.allclose(corner, (-0.182, -0.051), atol=1e-3)


def test_latency_direction(spark):
    """Gaze that repeats the event 100 samples later is late by 100 samples."""
    rows = [(1, i, float(300 <= i < 350), float(200 <= i < 250)) for i in range(1000)]
    got = latency.latency(spark.createDataFrame(rows, "session_id long, idx long, gaze double, event double"), 250, 1000.0).first()
    assert (got["lag"], got["latency_ms"]) == (100, 100.0) and got["peak"] > 0.99 and got["prominence"] > 5


def test_density_leans_to_heavier_samples(spark):
    rows = [(1, x, 0.5, w) for x, w in ((0.25, 10.0), (0.75, 1.0)) for _ in range(10)]
    got = heatmap.density(spark.createDataFrame(rows, "session_id long, gaze_x double, gaze_y double, w double"), ("session_id",), 32, 0.1, "w").toPandas()
    assert len(got) == 1024 and got[got.gx < 16].density.sum() > 5 * got[got.gx >= 16].density.sum()


def test_batch_of_points_and_inverse_maps(spark):
    volume = Volume((100, 100, 25), (1.0, 1.0, 1.0), ((1, 0, 0, -90), (0, 1, 0, -126), (0, 0, 1, -72), (0, 0, 0, 1)))
    points = spark.createDataFrame([(0.25, 0.25, 5), (0.5, 0.5, 13), (0.75, 0.75, 20), (None, 0.5, 1), (1.5, -1.0, 25)], "gaze_x double, gaze_y double, slice_num int").withColumn("plane", F.lit("AXIAL"))
    got = [tuple(r) for r in geometry.located(points, volume).select("voxel_i", "voxel_j", "voxel_k", "valid").collect()]
    assert got == [(25, 25, 4, True), (50, 50, 12, True), (74, 74, 19, True), (None, 50, 0, False), (99, 0, 24, True)]
    mm = [F.lit(10.0), F.lit(20.0), F.lit(30.0)]
    for forth, back in ((volume.inverse(), volume.matrix()), (np.linalg.inv(volume.frac2mm()), volume.frac2mm())):
        row = spark.range(1).select(*geometry.transform(back, *geometry.transform(forth, *mm))).first()
        assert np.allclose(row, (10, 20, 30), atol=1e-10)
