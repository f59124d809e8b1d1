"""Slices on screen for streams of gaze: a stream-stream join on session and time, with watermarks on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(gaze: DataFrame, shown: DataFrame, late: str = "10 seconds", longest: str = "60 seconds") -> DataFrame:
    """Gaze (session_id, at timestamp, ...) with the slice that was shown then (session_id, start, end timestamps, ...).

    A slice is sent when it ends; none is shown longer than `longest`, which bounds the state kept for gaze. Rows later
    than the watermark are dropped. Frames may be streams or tables, and give the same rows.
    """
    g = gaze.withWatermark("at", late)
    z = shown.withColumnRenamed("session_id", "shown_session").withWatermark("start", late)
    on = (F.col("session_id") == F.col("shown_session")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")) & (F.col("start") > F.col("at") - F.expr(f"interval {longest}"))
    return g.join(z, on).drop("shown_session")


def per_slice(gaze: DataFrame, window: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Samples and mean position per session and tumbling window, final once the watermark has passed."""
    return gaze.withWatermark("at", late).groupBy("session_id", F.window("at", window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("gaze_x").alias("mean_x"), F.avg("gaze_y").alias("mean_y")).select("session_id", F.col("w.start").alias("start"), "n", "mean_x", "mean_y")
