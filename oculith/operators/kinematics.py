"""Order-dependent operators on gaze: velocity, fixations, gaps, transitions, smoothing, noise, attention weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from oculith.functions.columns import norm2
from oculith.operators.ordered import SESSION, dense, islands, over, quantiles, with_stats


@dataclass(frozen=True)
class Screen:
    """Screen geometry (cm) and thresholds; angles in degrees of visual angle."""

    width_cm: float = 53.0
    height_cm: float = 30.0
    distance_cm: float = 60.0
    fixation_deg_s: float = 30.0
    min_samples: float = 12.0
    sigma_delta: float = 0.020
    independence: float = 0.3
    coupling_r2: float = 0.7
    drift_warning: float = 0.01

    @staticmethod
    def angle(size: float, distance: float) -> float:
        return math.degrees(2 * math.atan(size / (2 * distance)))

    @property
    def width_deg(self) -> float:
        return self.angle(self.width_cm, self.distance_cm)

    @property
    def height_deg(self) -> float:
        return self.angle(self.height_cm, self.distance_cm)


def visual_angle(size: Column, distance: Column) -> Column:
    return F.degrees(2.0 * F.atan(size / (2.0 * distance)))


def step(name: str, w: WindowSpec) -> Column:
    return F.col(name) - F.lag(name).over(w)


def velocity(gaze: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """dt, dx, dy, displacement, velocity_norm, displacement_deg, velocity_deg_s; null at the first sample and where no
    time passes."""
    df = over(gaze, lambda w: {"dt": step("time_sec", w), "dx": step("gaze_x", w), "dy": step("gaze_y", w)}, before=1)
    df = df.withColumn("displacement", norm2(F.col("dx"), F.col("dy")))
    df = df.withColumn("displacement_deg", norm2(F.col("dx") * screen.width_deg, F.col("dy") * screen.height_deg))
    return df.withColumns({"velocity_norm": F.try_divide("displacement", "dt"), "velocity_deg_s": F.try_divide("displacement_deg", "dt")})


def fixations_deg(moving: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """fixation_group (islands of equal flags), n_samples, is_fixation: slow samples in groups of enough samples."""
    slow = F.coalesce(F.col("velocity_deg_s") < screen.fixation_deg_s, F.lit(False))
    df = islands(moving.withColumn("slow", slow), lambda w: F.col("slow") != F.lag("slow", 1, False).over(w), "slow")
    df = df.withColumnsRenamed({"island": "fixation_group", "island_rows": "n_samples"}).drop("island_low", "island_high")
    return df.withColumn("is_fixation", F.col("slow") & (F.col("n_samples") >= screen.min_samples)).drop("slow")


def fixations_norm(gaze: DataFrame, threshold: float = 0.5, min_duration: float = 0.05, keys: tuple[str, ...] = SESSION, row: str = "gaze_id") -> DataFrame:
    """velocity, is_fixation, fixation_id, fixation_duration in normalised units; short islands lose flag and id. `row`
    numbers the rows of the keys without gaps."""
    df = gaze
    moved = lambda c, w: F.coalesce(step(c, w), F.lit(0.0))
    speed = lambda w: {"velocity": norm2(moved("gaze_x", w), moved("gaze_y", w)) / F.greatest(moved("time_sec", w), F.lit(1e-6))}
    df = over(df, speed, before=1, keys=keys, row=row).withColumn("slow", F.col("velocity") < threshold)
    df = islands(df, lambda w: F.col("slow") & ~F.lag("slow", 1, False).over(w), "slow", keys=keys, row=row)
    df = df.withColumn("span", F.col("island_high") - F.col("island_low"))
    valid = F.col("slow") & (F.col("span") >= min_duration)
    df = df.withColumns({"is_fixation": F.coalesce(valid, F.lit(False)), "fixation_id": F.when(valid, F.col("island")), "fixation_duration": F.when(valid, F.col("span"))})
    return df.drop("slow", "island", "island_rows", "island_low", "island_high", "span")


def gaps(aligned: DataFrame, seconds: float = 0.5, time: str = "time_aligned") -> DataFrame:
    """Samples that come more than `seconds` after the one before, with the gap."""
    gap = lambda w: {"gap": F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0))}
    return over(dense(aligned, time), gap, before=1, row="__row").filter(F.col("gap") > seconds).drop("__row")


def transitions(events: DataFrame, index: str = "slice_index", time: str = "z_time_sec", tie: str = "z_event_id") -> DataFrame:
    """session_id, transition_time, slice_before, slice_after where the slice changes."""
    df = over(dense(events, time, tie), lambda w: {"slice_before": F.lag(index).over(w)}, before=1, row="__row")
    return df.select("session_id", F.col(time).alias("transition_time"), "slice_before", F.col(index).alias("slice_after"), F.col(tie).alias("transition_id")).filter("slice_before <> slice_after")


def rolling_mean(name: str, before: int, after: int, w: WindowSpec) -> Column:
    """Mean over a full frame of rows of an ordered window; null near the ends."""
    frame = w.rowsBetween(-before, after)
    return F.when(F.count(F.lit(1)).over(frame) == before + after + 1, F.avg(name).over(frame))


def jitter_and_drift(moving: DataFrame) -> DataFrame:
    """jitter (distance to the mean of five samples) and drift (distance to the first known position) of each sample."""
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("gaze_id")))
    df = over(moving, lambda w: {"mx": rolling_mean("gaze_x", 2, 2, w), "my": rolling_mean("gaze_y", 2, 2, w)}, before=2, after=2)
    df = df.join(moving.groupBy("session_id").agg(known("gaze_x").alias("fx"), known("gaze_y").alias("fy")), "session_id")
    x, y = F.col("gaze_x"), F.col("gaze_y")
    return df.withColumns({"jitter": norm2(x - F.col("mx"), y - F.col("my")), "drift": norm2(x - F.col("fx"), y - F.col("fy"))}).drop("mx", "my", "fx", "fy")


def smooth_velocity(gaze: DataFrame, row: str = "gaze_id") -> DataFrame:
    """smooth_x, smooth_y (means of five), their central-difference velocity, and the residual to them; `row` numbers the
    samples of a session without gaps."""
    smooth = lambda w: {"smooth_x": rolling_mean("gaze_x", 2, 2, w), "smooth_y": rolling_mean("gaze_y", 2, 2, w)}
    slope = lambda c, w: F.try_divide(F.lead(c).over(w) - F.lag(c).over(w), F.lead("time_sec").over(w) - F.lag("time_sec").over(w))
    df = over(gaze, smooth, lambda w: {"vx": slope("smooth_x", w), "vy": slope("smooth_y", w)}, before=3, after=3, row=row)
    return df.withColumns({"smooth_velocity": norm2(F.col("vx"), F.col("vy")), "residual": norm2(F.col("gaze_x") - F.col("smooth_x"), F.col("gaze_y") - F.col("smooth_y"))})


def tracker_noise(fixed: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """Noise of the tracker per session: variance within fixations of five samples or more, weighted by samples; else
    over all fixation samples; too few samples give nulls."""
    fix = fixed.filter("is_fixation")
    group = fix.groupBy("session_id", "fixation_group").agg(F.var_samp("gaze_x").alias("vx"), F.var_samp("gaze_y").alias("vy"), F.count(F.lit(1)).alias("n"))
    n = F.when(F.col("n") >= 5, F.col("n"))
    within = group.groupBy("session_id").agg(
        F.sum("n").alias("n_fixation_samples"), F.count(n).alias("n_fixations_analyzed"), F.sqrt(F.try_divide(F.sum(F.col("vx") * n), F.sum(n))).alias("wx"), F.sqrt(F.try_divide(F.sum(F.col("vy") * n), F.sum(n))).alias("wy")
    )
    overall = fix.groupBy("session_id").agg(F.stddev_samp("gaze_x").alias("ox"), F.stddev_samp("gaze_y").alias("oy"))
    enough = F.col("n_fixation_samples") >= 10
    x, y = F.when(enough, F.coalesce("wx", "ox")), F.when(enough, F.coalesce("wy", "oy"))
    method = F.when(~enough, "insufficient_data").when(F.col("n_fixations_analyzed") > 0, "within_fixation_variance").otherwise("overall_fixation_variance")
    return within.join(overall, "session_id").select(
        "session_id", "n_fixation_samples", "n_fixations_analyzed", x.alias("sigma_x"), y.alias("sigma_y"), norm2(x, y).alias("sigma_norm"), norm2(x * screen.width_deg, y * screen.height_deg).alias("sigma_deg"), method.alias("method")
    )


def velocity_distribution(moving: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """Velocity statistics per session over samples that have one."""
    v = F.col("velocity_deg_s")
    slow = v < screen.fixation_deg_s
    q = quantiles(moving, "velocity_deg_s", (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))
    out = moving.filter(v.isNotNull()).groupBy("session_id").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.max(v).alias("max"),
        F.count_if(slow).alias("n_fixation"), F.count_if(~slow).alias("n_saccade"), F.avg(F.when(slow, v)).alias("mean_fixation"), F.avg(F.when(~slow, v)).alias("mean_saccade"), F.max(F.when(~slow, v)).alias("max_saccade"),
    ).join(q, "session_id")
    return out.select("*", *[F.col("q")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75", "p90", "p95", "p99"))]).drop("q")


def attention_weights(fixed: DataFrame, keys: tuple[str, ...] = SESSION, half: float = 0.05) -> DataFrame:
    """attention_weight: by fixation duration and slowness, summing to the number of samples of each key."""
    duration = F.when(F.col("is_fixation"), F.coalesce("fixation_duration", F.lit(0.0))).otherwise(0.0)
    df = fixed.withColumn("part", duration / (1.0 + F.col("velocity") / half))
    df = with_stats(df, keys, parts=F.sum("part"), n=F.count(F.lit(1)))  # the mean duration cancels against the sum
    own = F.when(F.col("parts") > 0, F.col("part") * F.col("n") / F.col("parts")).otherwise(F.col("part"))
    return df.withColumn("attention_weight", own).drop("part", "parts", "n")
