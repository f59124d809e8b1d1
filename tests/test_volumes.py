"""Volume files through the data source, and voxels in bricks, against plain arrays."""

import gzip

import numpy as np
from pyspark.sql import functions as F

from oculith.operators import bricks
from oculith.sources import volumes

DIMS, PIX = [20, 18, 9], [0.5, 1.0, 2.0]
AFFINE = [[0.5, 0.0, 0.0, -3.0], [0.0, 0.8, -1.2, 4.0], [0.0, 0.6, 1.6, 5.0], [0.0, 0.0, 0.0, 1.0]]


def content(seed=1, dims=DIMS):
    return np.random.default_rng(seed).normal(size=dims[::-1])


def file(path, values, dims=DIMS):
    path.write_bytes(volumes.written_header(dims, PIX, AFFINE) + values.tobytes())


def test_ranges_of_a_file_are_several_tasks_and_miss_nothing(spark, tmp_path):
    own = content()
    file(tmp_path / "a.nii", own)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.nii.gz").write_bytes(gzip.compress((tmp_path / "a.nii").read_bytes()))
    (tmp_path / "c.nii").write_bytes((tmp_path / "deep" / "b.nii.gz").read_bytes())  # compressed, by its content
    (tmp_path / "bad.nii").write_bytes(b"nothing")
    (tmp_path / "cut.nii").write_bytes((tmp_path / "a.nii").read_bytes()[:-1])
    (tmp_path / "other.txt").write_bytes(b"x")
    got = volumes.slices(spark, f"file://{tmp_path}", 5_000)
    assert got.rdd.getNumPartitions() > 8
    found = {}
    for r in got.collect():
        found.setdefault(r["path"].split("/")[-1], {})[r["k"]] = np.array(r["content"]).reshape(r["height"], r["width"])
    assert sorted(found) == ["a.nii", "b.nii.gz", "c.nii", "cut.nii"]
    for name, held in found.items():
        assert sorted(held) == list(range(8 if name == "cut.nii" else 9)) and all(np.array_equal(held[k], own[k]) for k in held)
    one = volumes.voxels(spark, f"file://{tmp_path}/a.nii").collect()
    assert len(one) == own.size and all(own[r["k"], r["j"], r["i"]] == r["value"] for r in one[::37])
    heads = {r["path"].split("/")[-1]: r for r in volumes.volumes(spark, f"file://{tmp_path}").collect()}
    assert heads["bad.nii"]["error"] and np.allclose(heads["a.nii"]["affine"], AFFINE) and heads["a.nii"]["dims"] == DIMS
    assert volumes.slices(spark, f"file://{tmp_path}/deep/none").count() == 0


def test_written_volumes_read_the_same(spark, tmp_path):
    own = spark.createDataFrame([(1, DIMS, PIX, AFFINE), (2, [3, 2, 1], PIX, AFFINE)], "volume_id long, dims array<int>, pixdim array<double>, affine array<array<double>>")
    given = spark.createDataFrame([(1, 0, 0, 0, 5.0), (1, 19, 17, 8, 7.0), (1, 20, 0, 0, 9.0), (1, 3, 4, 5, 2.5), (9, 0, 0, 0, 1.0)], "volume_id long, i int, j int, k int, value double")
    paths = {r["volume_id"]: r["path"] for r in volumes.write_volumes(given, own, f"file://{tmp_path}/out").collect()}
    back = volumes.voxels(spark, f"file://{tmp_path}/out", 1_000)
    assert sorted(paths) == [1, 2] and back.count() == 20 * 18 * 9 + 6
    assert sorted((r["i"], r["j"], r["k"], r["value"]) for r in back.filter("value <> 0").collect()) == [(0, 0, 0, 5.0), (3, 4, 5, 2.5), (19, 17, 8, 7.0)]


def test_morton_numbers(spark):
    places = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (3, 5, 6), (2**20 - 1,) * 3]
    got = [r["m"] for r in spark.createDataFrame([(n, *p) for n, p in enumerate(places)], "n int, a long, b long, c long").select("n", bricks.morton(F.col("a"), F.col("b"), F.col("c")).alias("m")).orderBy("n").collect()]
    plain = lambda p: sum(((v >> b) & 1) << (3 * b + axis) for axis, v in enumerate(p) for b in range(20))
    assert got == [plain(p) for p in places] and got[1:4] == [1, 2, 4]


def test_values_picked_from_bricks(spark):
    full, random = content(2, [20, 18, 40]), np.random.default_rng(3)
    rows = [(1, i, j, k, float(full[k, j, i]), i + j) for k in range(40) for j in range(18) for i in range(20)]
    sparse = [(2, i, i, i, float(i), i) for i in range(0, 40, 3)] + [(2, 3, 3, 3, 99.0, 3), (2, None, 0, 0, 1.0, 1)]
    voxels = spark.createDataFrame(rows + sparse, "volume_id int, i int, j int, k int, value double, region_id int")
    packed = bricks.packed(voxels, ("value", "region_id")).cache()
    assert packed.filter("volume_id = 1").count() == 2 * 2 * 3 and packed.filter("volume_id = 1 and places is not null").count() == 0
    asked = [(v, *map(int, random.integers(-2, 45, 3))) for v in (1, 2, 3) for _ in range(300)] + [(2, i, i, i) for i in range(40)] + [(1, None, 0, 0)] + [(1, i, 17, 39) for i in range(18, 22)]
    got = bricks.picked(spark.createDataFrame(asked, "volume_id int, voxel_i int, voxel_j int, voxel_k int"), packed, ("value", "region_id"))
    plain = {(1, i, j, k): (value, region) for _, i, j, k, value, region in rows} | {(2, i, i, i): (float(i), i) for i in range(0, 40, 3)}
    found = got.collect()
    assert len(found) == len(asked)
    for r in found:
        assert (r["value"], r["region_id"]) == plain.get((r["volume_id"], r["voxel_i"], r["voxel_j"], r["voxel_k"]), (None, None))


def test_no_row_a_voxel_meets_a_sample(spark):
    """What the join reads has a row for each brick: sixteen slices of 16 x 16 voxels are one."""
    voxels = spark.range(16 * 16 * 32).selectExpr("0 as volume_id", "cast(id % 16 as int) as i", "cast(id div 16 % 16 as int) as j", "cast(id div 256 as int) as k", "cast(id as double) as value")
    assert bricks.packed(voxels, ("value",)).count() == 2
