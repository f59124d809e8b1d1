"""Recordings derived from the `events` table: gaze samples, slice events, voxels and an atlas, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oculith.operators import matrices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, event_id, event_type, t_us, k, value: events of eight sessions on one compressed clock."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    origin = table(spark, sf_dir, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))))
    events = events.withColumn("origin", origin.scalar())  # one value, read once a query
    return events.select((F.col("user_id") % 8).alias("session_id"), "event_id", "event_type", F.expr("(us - origin) div 21600").alias("t_us"), "k", "value")


def gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, src_id, device_time_stamp (µs), system_time_stamp (µs), gaze_point_on_display_area_x and _y."""
    b = clicks(spark, sf_dir).filter("event_type <> 'view'")
    place = lambda a, s, e: F.expr(f"15/1e2 + ((t_us div 1500000 * {a} + session_id * {s}) % 71) / 1e2 + ((event_id * {e}) % 21 - 10) / 5e3")
    return b.select(
        "session_id",
        F.col("event_id").alias("src_id"),
        F.col("t_us").alias("device_time_stamp"),
        F.expr("t_us + t_us div 50000").alias("system_time_stamp"),
        place(37, 11, 13).alias("gaze_point_on_display_area_x"),
        place(53, 7, 29).alias("gaze_point_on_display_area_y"),
    )


def slice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, src_id, client_timestamp (ms), plane, index (0 to 1), image_id."""
    b = clicks(spark, sf_dir).filter("event_type = 'view'")
    first = table(spark, sf_dir, "events").filter("event_type = 'view' and user_id % 8 = 7").agg(F.min("event_id")).scalar()
    keep = "session_id < 6 or (session_id = 6 and t_us < 60000000) or (session_id = 7 and event_id = first_view)"
    return b.withColumn("first_view", first).filter(keep).select(
        "session_id",
        F.col("event_id").alias("src_id"),
        F.expr("t_us / 1e3").alias("client_timestamp"),
        F.expr("case event_id % 3 when 0 then 'AXIAL' when 1 then 'SAGITTAL' else 'CORONAL' end").alias("plane"),
        F.expr("(k % 25) / 24e0").alias("index"),
        F.lit("img0").alias("image_id"),
    )


def voxels(spark: SparkSession, dims: tuple[int, int, int] = (16, 16, 25)) -> DataFrame:
    """volume_id, i, j, k (from 0), value, region_id of a small test volume."""
    nx, ny, nz = dims
    grid = spark.range(nx * ny * nz).selectExpr(f"id % {nx} as i", f"(id div {nx}) % {ny} as j", f"id div {nx * ny} as k")
    return grid.selectExpr("0L as volume_id", "i", "j", "k", "cast((i * 7 + j * 13 + k * 29) % 256 as double) as value", "case when k < 3 then 0 else 1 + (i div 8) + 2 * (j div 8) end as region_id")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, dims, pixdim, affine, oblique of 25 volumes of different sizes and spacings, a third of them turned and a
    third tilted; the last one has no extent along z. From the `nation` table's keys."""
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("volume_id")).withColumns({"k": F.expr("volume_id % 5"), "o": F.expr("volume_id div 5")})
    v = v.withColumn("dims", F.expr("array(cast(16 + 4 * k as int), cast(20 - 2 * k as int), cast(25 - 3 * o as int))"))
    v = v.withColumn("pixdim", F.expr("array(0.5d + k / 4e0, 1 + o % 2 / 2e0, if(volume_id = 24, 0d, 1d + o))"))
    kind = F.col("volume_id") % 3
    turn = matrices.rotation("z", F.when(kind == 1, 0.8).otherwise(1.0), F.when(kind == 1, 0.6).otherwise(0.0))
    tilt = matrices.rotation("x", F.when(kind == 2, 0.96).otherwise(1.0), F.when(kind == 2, 0.28).otherwise(0.0))
    shift = matrices.translated(matrices.identity(), -8.0 - F.col("k"), 4.0 * F.col("o") - 10, F.col("volume_id") / 2.0 - 20)
    flip = F.when(F.col("volume_id") % 2 == 1, -1.0).otherwise(1.0)
    affine = matrices.scaled(matrices.product(shift, matrices.product(turn, tilt)), F.col("pixdim")[0] * flip, F.col("pixdim")[1], F.col("pixdim")[2])
    return v.select("volume_id", "dims", "pixdim", affine.alias("affine"), (kind != 0).alias("oblique"))
