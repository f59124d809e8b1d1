"""Tables kept by what they were made from: found again, missed when anything changes, bounded in size."""

import os

import pytest
from pyspark.sql import functions as F

from oculith.plans import base, catalog
from oculith.sources import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark, tmp_path):
    spark.conf.set(stored.STORE, f"file://{tmp_path}/store")
    yield f"{tmp_path}/store"
    spark.conf.unset(stored.STORE)
    spark.conf.unset(stored.STORE_BYTES)
    stored._IN_USE.clear()


def test_found_again_and_missed(spark, store, tmp_path):
    source, built = f"file://{tmp_path}/in", []

    def build():
        built.append(1)
        return spark.read.parquet(source).withColumn("twice", F.col("id") * 2)

    spark.range(10).write.parquet(source)
    first = stored.kept(spark, "t", [source], build, rate=1)
    assert first.agg(F.sum("twice")).first()[0] == 90 == stored.kept(spark, "t", [source], build, rate=1).agg(F.sum("twice")).first()[0] and len(built) == 1
    stored.kept(spark, "t", [source], build, rate=2)
    stored.kept(spark, "other", [source], build, rate=1)
    assert len(built) == 3
    spark.range(3).write.mode("overwrite").parquet(source)
    assert stored.kept(spark, "t", [source], build, rate=1).count() == 3 and len(built) == 4
    assert first.count() == 10 and not [x for x in os.listdir(store) if x.endswith(".draft")]


def test_another_run_finds_the_table_and_old_ones_make_room(spark, store, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.range(1000).write.parquet(source)
    names = lambda: sorted(x.split("-")[0] for x in os.listdir(store))
    for name in "abc":
        stored.kept(spark, name, [source], lambda: spark.read.parquet(source))
        os.utime(f"{store}/{[x for x in os.listdir(store) if x.startswith(name)][0]}", (1_000 * ord(name), 1_000 * ord(name)))
    spark.conf.set(stored.STORE_BYTES, "1")
    stored.kept(spark, "d", [source], lambda: spark.read.parquet(source))
    assert names() == ["a", "b", "c", "d"]  # this driver may still read them
    stored._IN_USE.clear()  # as in another run
    assert stored.kept(spark, "a", [source], lambda: 1 / 0).count() == 1000
    stored.kept(spark, "e", [source], lambda: spark.read.parquet(source))
    assert names() == ["a", "e"]


def test_an_empty_table_and_a_failing_build(spark, store, tmp_path):
    source = f"file://{tmp_path}/in"
    spark.range(0).write.parquet(source)
    assert stored.kept(spark, "none", [source], lambda: spark.read.parquet(source)).columns == ["id"]
    with pytest.raises(ZeroDivisionError):
        stored.kept(spark, "bad", [source], lambda: 1 / 0)
    assert stored.kept(spark, "bad", [source], lambda: spark.range(2)).count() == 2


def test_later_queries_make_no_scan_of_events(spark, store):
    base.integrated(spark, SF), base.moving(spark, SF)
    for name in ("j1_interval_join_asof", "a12_velocity_distribution", "a25_coupling_validation", "a18_p3_accumulation", "a23_uncertainty_evaluation", "j5_nearest_transition"):
        assert not any("events.parquet" in f for f in catalog.queries()[name](spark, SF).inputFiles()), name
