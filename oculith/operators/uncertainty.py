"""Uncertainty evaluation of recordings: velocity coupling, independence, accumulation, slice assignment, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oculith.functions.columns import equal_bin, norm2, normal_cdf, quantile_bin, rows, safe_corr, safe_r2
from oculith.operators.align import nearest
from oculith.operators.kinematics import Screen, rolling_mean, transitions
from oculith.operators.ordered import SESSION, dense, over, quantiles, tile, with_stats


def nearest_transition(samples: DataFrame, marks: DataFrame, time: str = "time_aligned", mark: str = "transition_time") -> DataFrame:
    """dist_to_transition: distance to the nearest mark of the session; null without any."""
    return nearest(samples, marks, time, mark, "dist_to_transition")


def confidence(df: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """assignment_confidence by distance in sigmas; is_ambiguous within three."""
    d, s = F.col("dist_to_transition"), screen.sigma_delta
    label = F.when(d > 3 * s, "High (>99.7%)").when(d > 2 * s, "Good (95-99.7%)").when(d > s, "Moderate (68-95%)").otherwise("Ambiguous (<68%)")
    return df.withColumns({"assignment_confidence": label, "is_ambiguous": d <= 3 * s})


def slice_confidence(integrated: DataFrame, events: DataFrame, screen: Screen = Screen()) -> DataFrame:
    return confidence(nearest_transition(integrated, transitions(events)), screen)


def slice_assignment(integrated: DataFrame, events: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """P4 per session: transitions, samples, ambiguous samples and their share."""
    n = transitions(events).groupBy("session_id").agg(rows().alias("n_transitions"))
    out = slice_confidence(integrated, events, screen).groupBy("session_id").agg(rows().alias("n_total"), F.count_if("is_ambiguous").alias("n_ambiguous"))
    return out.join(n, "session_id", "left").select("session_id", F.coalesce("n_transitions", F.lit(0)).alias("n_transitions"), "n_total", "n_ambiguous", (100.0 * F.col("n_ambiguous") / F.col("n_total")).alias("pct_ambiguous"))


def velocity_coupling(moving: DataFrame, screen: Screen = Screen(), n_bins: int = 10, least: int = 10) -> DataFrame:
    """P1 per session: spread of displacement against velocity over equal-width bins of enough samples."""
    v = F.col("velocity_deg_s")
    valid = moving.filter(v.isNotNull() & F.col("displacement").isNotNull())
    binned = with_stats(valid, SESSION, low=F.min(v), high=F.max(v)).withColumn("bin", equal_bin(v, F.col("low"), F.col("high"), n_bins))
    stats = binned.groupBy("session_id", "bin").agg(F.avg(v).alias("x"), F.stddev_samp("displacement").alias("y"), rows().alias("n")).filter(F.col("n") >= least)
    out = stats.groupBy("session_id").agg(rows().alias("n_bins"), safe_r2("y", "x").alias("r_squared"), F.regr_slope("y", "x").alias("slope"))
    enough = F.col("n_bins") >= 3
    r2, slope = F.when(enough, F.col("r_squared")), F.when(enough, F.col("slope"))
    return out.select("session_id", "n_bins", r2.alias("r_squared"), slope.alias("slope"), F.coalesce((r2 >= screen.coupling_r2) & (slope > 0), F.lit(False)).alias("pass"))


def independence(jittered: DataFrame, screen: Screen = Screen(), least: int = 50) -> DataFrame:
    """P2 per session: correlations of jitter, displacement and drift."""
    valid = jittered.dropna(subset=["jitter", "displacement", "drift"])
    out = valid.groupBy("session_id").agg(rows().alias("n"), safe_corr("jitter", "displacement").alias("a"), safe_corr("jitter", "drift").alias("b"), safe_corr("displacement", "drift").alias("c"))
    enough = F.col("n") >= least
    abc = [F.when(enough, F.col(x)) for x in "abc"]
    most = F.when(abc[0].isNotNull() & abc[1].isNotNull() & abc[2].isNotNull(), F.greatest(*map(F.abs, abc)))
    names = ("cor_jitter_displacement", "cor_jitter_drift", "cor_displacement_drift")
    return out.select("session_id", "n", *[x.alias(k) for x, k in zip(abc, names)], most.alias("max_correlation"), F.coalesce(most < screen.independence, F.lit(False)).alias("pass"))


def segments(df: DataFrame, n: int = 4) -> DataFrame:
    """segment: which of n runs of nearly equal size a sample of its session belongs to."""
    return dense(df, total="__total").withColumn("segment", tile(n, F.col("__row"), F.col("__total"))).drop("__row", "__total")


def accumulation(integrated: DataFrame, n: int = 4) -> DataFrame:
    """P3 per session: does the spread of time residuals grow over the session's segments?"""
    centred = with_stats(integrated, (*SESSION, "z_event_id"), centre=F.avg("time_aligned"))
    seg = segments(centred.withColumn("residual", F.col("time_aligned") - F.col("centre")), n).groupBy("session_id", "segment").agg(F.var_samp("residual").alias("v"), F.stddev_samp("residual").alias("sd"), F.avg("time_sec").alias("t"))
    out = seg.groupBy("session_id").agg(rows().alias("n_segments"), F.max(F.when(F.col("segment") == 1, F.col("v"))).alias("first"), F.max(F.when(F.col("segment") == n, F.col("v"))).alias("last"), F.regr_slope("sd", "t").alias("slope"))
    ratio = F.try_divide("last", "first")
    slope = F.when(F.col("n_segments") >= 3, F.col("slope"))
    return out.select("session_id", ratio.alias("variance_ratio"), F.sqrt("first").alias("first_sd"), F.sqrt("last").alias("last_sd"), slope.alias("trend_slope"), (ratio > 1).alias("grows_with_time"))


def calibration_drift(gaze: DataFrame, screen: Screen = Screen(), n: int = 4) -> DataFrame:
    """P5 per session: movement of the mean position from the first to the last segment."""
    seg = segments(gaze, n).groupBy("session_id", "segment").agg(F.avg("gaze_x").alias("x"), F.avg("gaze_y").alias("y"), F.avg("time_sec").alias("t"))
    at = lambda c, k: F.max(F.when(F.col("segment") == k, F.col(c)))
    out = seg.groupBy("session_id").agg((at("x", n) - at("x", 1)).alias("drift_x"), (at("y", n) - at("y", 1)).alias("drift_y"), F.regr_slope("x", "t").alias("slope_x"), F.regr_slope("y", "t").alias("slope_y"))
    span = gaze.groupBy("session_id").agg((F.max("time_sec") - F.min("time_sec")).alias("duration"))
    total = norm2(F.col("drift_x"), F.col("drift_y"))
    degrees = norm2(F.col("drift_x") * screen.width_deg, F.col("drift_y") * screen.height_deg)
    per_minute = F.try_divide(total, "duration") * 60
    return out.join(span, "session_id").select("session_id", "drift_x", "drift_y", total.alias("total_drift"), degrees.alias("total_drift_deg"), per_minute.alias("rate_per_min"), "slope_x", "slope_y", (per_minute > screen.drift_warning).alias("needs_recalibration"))


def recorded_coupling(smooth: DataFrame) -> DataFrame:
    """P1 on recordings: mean residual against smoothed velocity over deciles of velocity."""
    v = F.col("smooth_velocity")
    valid = smooth.filter((v > 0) & F.col("residual").isNotNull())
    breaks = quantiles(valid, "smooth_velocity", tuple(i / 10 for i in range(11)), name="breaks")
    binned = valid.join(breaks, "session_id").withColumn("bin", quantile_bin(v, F.col("breaks")))
    stats = binned.filter("bin is not null").groupBy("session_id", "bin").agg(F.avg(v).alias("x"), F.avg("residual").alias("y"), rows().alias("n"))
    lx, ly = F.log10("x"), F.log10(F.when(F.col("y") > 0, F.col("y")))
    return stats.groupBy("session_id").agg(F.sum("n").alias("n"), safe_corr("x", "y").alias("correlation"), F.regr_slope(ly, lx).alias("log_slope"), safe_r2(ly, lx).alias("log_r2"))


def clock_drift(gaze: DataFrame) -> DataFrame:
    """P3 on recordings: the tracker's system clock against its device clock."""
    gap = (F.col("system_time_stamp") - F.col("device_time_stamp")).cast("double")
    df = with_stats(gaze, SESSION, first=F.min_by(gap, F.struct("device_time_stamp", "gaze_id"))).withColumn("drift_ms", (gap - F.col("first")) / 1000.0)
    out = df.groupBy("session_id").agg(rows().alias("n"), F.max_by("drift_ms", F.struct("device_time_stamp", "gaze_id")).alias("total_ms"), F.regr_slope("drift_ms", "time_sec").alias("slope"), safe_r2("drift_ms", "time_sec").alias("r_squared"))
    return out.select("session_id", "n", "total_ms", (F.col("slope") * 1000).alias("slope_ppm"), "r_squared")


def recorded_assignment(gaze: DataFrame, events: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """P4 on recordings: every event counts as a transition; the chance of a right assignment is Φ(distance / σ)."""
    marks = events.select("session_id", F.col("z_time_sec").alias("transition_time"), F.col("z_event_id").alias("transition_id"))
    near = nearest_transition(gaze, marks, "time_sec")
    d = F.col("dist_to_transition")
    p = normal_cdf(d / screen.sigma_delta)
    close = d < 0.005
    few = events.groupBy("session_id").agg(rows().alias("n_events"))
    out = near.withColumn("p", p).groupBy("session_id").agg(rows().alias("n"), (100 * F.avg((d < 3 * screen.sigma_delta).cast("double"))).alias("pct_ambiguous"), F.avg("p").alias("mean_p"), F.count_if(close).alias("n_close"), F.avg(F.when(close, F.col("p"))).alias("mean_p_close"))
    out = out.join(few, "session_id").join(quantiles(near, "dist_to_transition", (0.5,)), "session_id", "left")
    return out.select("session_id", "n", "n_events", "pct_ambiguous", "mean_p", F.col("q")[0].alias("median_distance"), "n_close", "mean_p_close", F.when(F.col("n_events") < 5, "too few events").otherwise("ok").alias("status"))


def slow_drift(gaze: DataFrame, before: int = 124, after: int = 125) -> DataFrame:
    """slow_x, slow_y: means over a long frame of samples, null near the ends."""
    return over(gaze, lambda w: {"slow_x": rolling_mean("gaze_x", before, after, w), "slow_y": rolling_mean("gaze_y", before, after, w)}, before=before, after=after)


def expected_variance(velocity: Column, seconds: Column, sigma_tracker: float = 0.5, alpha: float = 0.01, sigma_latency: float = 0.02, sigma_transform: float = 0.1) -> Column:
    """Sum of the variance of tracker, drift, latency and transformation."""
    return F.lit(sigma_tracker**2) + F.pow(alpha * seconds, F.lit(2.0)) + F.pow(velocity / 60.0 * sigma_latency, F.lit(2.0)) + F.lit(sigma_transform**2)
