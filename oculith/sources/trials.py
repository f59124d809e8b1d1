"""Study inputs derived from the `events` table: error components, latency traces, estimator trials, processing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oculith.sources.recordings import clicks


def components(moving: DataFrame) -> DataFrame:
    """Samples with velocity, true position, time offset, tracker noise and drift, from integer arithmetic on their ids."""
    of = lambda m, n, d: F.expr(f"((gaze_id * {m}) % {n} - {n // 2}) / {d}")
    return moving.select(
        "session_id", "gaze_id", "time_sec", F.coalesce("velocity_deg_s", F.lit(0.0)).alias("velocity"), F.col("gaze_x").alias("true_x"), F.col("gaze_y").alias("true_y"), of(17, 41, "1e3").alias("temporal_offset"),
        of(7, 19, "1e3").alias("tracker_noise_x"), of(11, 23, "1e3").alias("tracker_noise_y"), (F.col("time_sec") / 1e4 + of(31, 13, "1e5")).alias("drift_x"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id (replicate), scenario, time, latency_ms (null where lost: one in twenty)."""
    return clicks(spark, sf_dir).select("session_id", F.col("event_type").alias("scenario"), (F.col("t_us") / F.lit(1e6)).alias("time"), F.when(F.col("event_id") % 20 != 0, F.col("value")).alias("latency_ms"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial_id, n_events, snr, sampling_freq, error (ms), prominence_ratio, sigma_delta, sigma_delta_boot."""
    return clicks(spark, sf_dir).select(
        F.col("event_id").alias("trial_id"), ((F.col("session_id") + 1) * 10).alias("n_events"), (F.col("k") % 5 + 1).alias("snr"), F.expr("case event_id % 3 when 0 then 20 when 1 then 60 else 120 end").alias("sampling_freq"),
        F.col("value").alias("error"), F.expr("1 + (event_id * 7 % 50) / 1e1").alias("prominence_ratio"), F.expr("(1 + event_id * 3 % 17) / 1e1").alias("sigma_delta"), F.expr("(1 + event_id * 3 % 17) / 1e1 * (1 + event_id * 5 % 7) / 4e0").alias("sigma_delta_boot"),
    )


def process_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """modality, session_id, true and estimated latency (ms), samples, matched samples, seconds, loss, error in space."""
    return clicks(spark, sf_dir).select(
        F.col("event_type").alias("modality"), "session_id", F.lit(100.0).alias("true_latency_ms"), (100.0 + F.col("value") / 2 * F.expr("case when event_id % 2 = 0 then 1 else -1 end")).alias("estimated_latency_ms"),
        F.expr("1000 + event_id % 7 * 100").alias("n_gaze_original"), F.expr("1000 + event_id % 7 * 100 - event_id % 11 * 20").alias("n_gaze_matched"), F.expr("(1 + event_id % 5) / 1e1").alias("processing_time_sec"), F.expr("event_id % 10 / 1e1").alias("loss"), F.expr("event_id % 13 / 1e3").alias("spatial_error"),
    )
