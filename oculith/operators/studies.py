"""Checks of error models against recordings, and summaries across sessions, scenarios and trials."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oculith.functions.columns import by, norm2, normal_cdf, quantile_bin, rows, safe_corr, safe_r2, student_quantile, two_sided_p
from oculith.operators.align import as_of
from oculith.operators.kinematics import rolling_mean, smooth_velocity
from oculith.operators.latency import POSITIONS, SUMS, correlated, lag_sums, peaks
from oculith.operators.ordered import SESSION, dense, numbered, over, quantiles, running, with_stats
from oculith.sources.stored import stored

#: The normal distribution's 97.5 % point.
NORMAL = 1.959963984540054
#: A scale that turns velocity in degrees a second into screens a second: the screen spans about 60 degrees.
SCREEN_DEG = 60.0


def decile_bins(df: DataFrame, value: str, n: int = 10, keys: tuple[str, ...] = SESSION) -> DataFrame:
    """bin: number of the quantile bin of the value within its key; null where quantiles coincide."""
    breaks = quantiles(df, value, tuple(i / n for i in range(n + 1)), keys, "breaks")
    return df.join(breaks, list(keys)).withColumn("bin", quantile_bin(F.col(value), F.col("breaks"))).drop("breaks")


def bin_means(df: DataFrame, value: str, error: str, n: int = 10) -> DataFrame:
    """session_id, bin, n, mean of value and error, deviation and standard error of the error, by quantile bin."""
    stats = decile_bins(df, value, n).filter("bin is not null").groupBy("session_id", "bin")
    out = stats.agg(rows().alias("n"), F.avg(value).alias("value_mean"), F.avg(error).alias("error_mean"), F.stddev_samp(error).alias("error_sd"))
    return out.withColumn("error_se", F.col("error_sd") / F.sqrt(F.col("n").cast("double")))


def induced_error(df: DataFrame, velocity: str = "velocity", offset: str = "temporal_offset", x: str = "true_x", y: str = "true_y") -> DataFrame:
    """v_normalized, induced_error_x, induced_error_y, induced_error_magnitude: velocity times the given time offset,
    along the direction to the next sample; none where the eye rests, at the last sample, and where it doesn't move."""
    to = lambda c, w: F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0))
    df = over(df, lambda w: {"v_normalized": F.col(velocity) / SCREEN_DEG, "to_x": to(x, w), "to_y": to(y, w)}, after=1)
    length = norm2(F.col("to_x"), F.col("to_y"))
    part = lambda c: F.when(F.col("v_normalized") > 0.001, F.col("v_normalized") * F.col(offset) * F.coalesce(F.try_divide(F.col(c), length), F.lit(0.0))).otherwise(0.0)
    df = df.withColumns({"induced_error_x": part("to_x"), "induced_error_y": part("to_y")}).drop("to_x", "to_y")
    return df.withColumn("induced_error_magnitude", norm2(F.col("induced_error_x"), F.col("induced_error_y")))


def coupling_validation(df: DataFrame, sigma_latency: float = 0.020, n: int = 10, least: int = 50) -> DataFrame:
    """Per session: does the mean induced error grow with velocity as its latency predicts? A fit over quantile bins of
    moving samples, weighted by their size. Fewer than `least` samples or three bins give nulls and valid = false."""
    moving = df.filter("v_normalized > 0.01")
    bins = bin_means(moving, "v_normalized", "induced_error_magnitude", n).filter("error_sd is not null")
    w, x, y = F.col("n").cast("double"), F.col("value_mean"), F.col("error_mean")
    s = bins.groupBy("session_id").agg(
        rows().alias("n_bins"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"), safe_corr(x, y).alias("correlation")
    )
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) / F.col("w") for a, b, c in (("wxx", "wx", "wx"), ("wxy", "wx", "wy"), ("wyy", "wy", "wy")))
    expected = sigma_latency * math.sqrt(2 / math.pi)
    total = moving.groupBy("session_id").agg(rows().alias("n_samples"))
    out = total.join(s, "session_id", "left")
    valid = F.coalesce((F.col("n_samples") >= least) & (F.col("n_bins") >= 3), F.lit(False))
    slope = F.when(valid, F.try_divide(sxy, sxx))
    r2 = F.when(valid, F.try_divide(sxy * sxy, sxx * syy))
    close = F.coalesce(F.abs(slope - expected) / expected < 0.5, F.lit(False))
    return out.select("session_id", "n_samples", F.coalesce("n_bins", F.lit(0)).alias("n_bins"), valid.alias("valid"), slope.alias("observed_slope"), F.lit(expected).alias("expected_slope"), (slope / expected).alias("slope_ratio"), r2.alias("r_squared"), F.when(valid, F.col("correlation")).alias("correlation"), close.alias("slope_within_tolerance"))


def independence_validation(df: DataFrame, limit: float = 0.3, least: int = 20) -> DataFrame:
    """Per session, over samples with induced error: correlations of tracker noise, induced error and steps of drift,
    and the largest one between the components themselves."""
    moving = df.filter((F.abs("induced_error_x") > 1e-10) | (F.abs("induced_error_y") > 1e-10))
    moving = over(dense(moving), lambda w: {"step": F.coalesce(F.col("drift_x") - F.lag("drift_x").over(w), F.lit(0.0))}, before=1, row="__row")
    pairs = {
        "ix": ("tracker_noise_x", "induced_error_x"), "iy": ("tracker_noise_y", "induced_error_y"), "td": ("tracker_noise_x", "step"), "id": ("induced_error_x", "step"),
        "tx": ("tracker_noise_x", "drift_x"), "xx": ("induced_error_x", "drift_x"),
    }
    out = moving.groupBy("session_id").agg(rows().alias("n_samples"), *[F.abs(safe_corr(*p)).alias(k) for k, p in pairs.items()])
    enough = F.col("n_samples") >= least
    top = F.when(enough, F.greatest("ix", "tx", "xx"))
    return out.select("session_id", "n_samples", F.when(enough, F.greatest("ix", "iy")).alias("tracker_induced"), F.when(enough, F.col("td")).alias("tracker_drift"), F.when(enough, F.col("id")).alias("induced_drift"), top.alias("max_off_diagonal"), F.coalesce(top < limit, F.lit(False)).alias("independent"))


def accumulation_validation(events: DataFrame, sigma_0: float = 0.001, alpha: float = 1e-5, time: str = "event_time_sec", sigma: str = "accumulated_sigma") -> DataFrame:
    """Per session: start and growth of sigma recovered from a line through its square against squared time."""
    t2, s2 = F.col(time) * F.col(time), F.col(sigma) * F.col(sigma)
    expected = F.sqrt(sigma_0**2 + F.pow(alpha * F.col(time), F.lit(2.0)))
    out = events.groupBy("session_id").agg(F.regr_slope(s2, t2).alias("slope"), F.regr_intercept(s2, t2).alias("at"), safe_r2(s2, t2).alias("r_squared"), F.avg(F.abs(F.col(sigma) - expected)).alias("mean_residual"))
    found = F.sqrt(F.abs("slope"))
    return out.select("session_id", "r_squared", F.sqrt(F.abs("at")).alias("sigma_0"), found.alias("alpha"), "mean_residual", F.coalesce(F.abs(found - alpha) / alpha < 0.5, F.lit(False)).alias("recovered"))


def boundary_probes(transitions: DataFrame, sigma: float = 0.020, n: int = 100) -> DataFrame:
    """n probes within three sigmas around every transition, with the chance of each side."""
    probes = transitions.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("offset_sigma_units", F.lit(6.0) * F.col("probe") / F.lit(float(n - 1)) - 3.0)
    u = F.col("offset_sigma_units")
    p = normal_cdf(-u)
    return probes.withColumns({"offset_from_transition": u * sigma, "time_sec": F.col("transition_time") + u * sigma, "p_slice_before": p, "p_slice_after": 1.0 - p, "is_ambiguous": F.abs(u) <= 1.0})


def boundary_validation(probes: DataFrame) -> DataFrame:
    """Per session: share of ambiguous probes and the mean chance next to the transition, which should be a half."""
    near = F.avg(F.when(F.abs("offset_sigma_units") < 0.1, F.col("p_slice_before")))
    out = probes.groupBy("session_id").agg(F.avg(F.col("is_ambiguous").cast("double")).alias("fraction_ambiguous"), near.alias("mean_p_at_boundary"), F.count_distinct("transition_id").alias("n_transitions"), rows().alias("n_points"))
    return out.withColumn("calibrated", F.abs(F.col("mean_p_at_boundary") - 0.5) < 0.1)


def drift_validation(points: DataFrame, time: str = "calibration_time_sec", drift: str = "total_drift", acceptable: float = 0.01) -> DataFrame:
    """Per session: rate of drift and the time after which the acceptable drift is reached."""
    out = points.groupBy("session_id").agg(F.regr_slope(drift, time).alias("rate"), safe_r2(drift, time).alias("r_squared"))
    return out.select("session_id", "rate", (F.col("rate") * 60).alias("rate_per_min"), "r_squared", F.try_divide(F.lit(acceptable), "rate").alias("recalibration_sec"))


def recorded_independence(gaze: DataFrame, least: int = 500, least_valid: int = 100, before: int = 124, after: int = 125) -> DataFrame:
    """P2 on recordings, per session: the residual to the smoothed path is split into a part that velocity explains (a
    log-log fit) and the tracker's; both are correlated with slow drift. Too few samples give nulls and a status."""
    known = gaze.dropna(subset=["gaze_x", "gaze_y"])
    total = known.groupBy("session_id").agg(rows().alias("n_all"))
    m = smooth_velocity(dense(known), "__row").drop("__row").filter("smooth_velocity > 0 and residual is not null")
    lv, lr = F.log10("smooth_velocity"), F.log10(F.col("residual") + 1e-10)
    fit = m.filter("residual > 0").groupBy("session_id").agg(F.regr_slope(lr, lv).alias("slope"), F.regr_intercept(lr, lv).alias("at"))
    mean = m.groupBy("session_id").agg(F.avg("gaze_x").alias("mean_x"))
    m = over(dense(m), lambda w: {"slow_x": rolling_mean("gaze_x", before, after, w)}, before=before, after=after, row="__row").filter("slow_x is not null")
    m = m.withColumn("x_resid", F.col("gaze_x") - F.col("smooth_x"))
    m = m.join(fit, "session_id").join(mean, "session_id")
    explained = F.coalesce(F.try_divide("x_resid", "residual"), F.lit(0.0)) * F.pow(F.lit(10.0), F.col("at") + F.col("slope") * lv)
    m = m.withColumns({"vel": explained, "drift": F.col("slow_x") - F.col("mean_x")}).withColumn("tracker", F.col("x_resid") - F.col("vel"))
    out = total.join(m.groupBy("session_id").agg(rows().alias("n"), safe_corr("vel", "drift").alias("a"), safe_corr("vel", "tracker").alias("b"), safe_corr("drift", "tracker").alias("c")), "session_id", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("n_all") < least, "insufficient data").when(n < least_valid, "insufficient valid samples").otherwise("ok")
    a, b, c = (F.when(status == "ok", F.col(k)) for k in "abc")
    top = F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.greatest(F.abs(a), F.abs(b), F.abs(c)))
    return out.select("session_id", n.alias("n_samples"), a.alias("r_velocity_drift"), b.alias("r_velocity_tracker"), c.alias("r_drift_tracker"), top.alias("max_abs_r"), F.coalesce(top < 0.3, F.lit(False)).alias("pass"), status.alias("status"))


def pairs_long(df: DataFrame) -> DataFrame:
    """Correlations as rows: session_id, pair, correlation."""
    names = {"r_velocity_drift": "Velocity vs Drift", "r_velocity_tracker": "Velocity vs Tracker", "r_drift_tracker": "Drift vs Tracker"}
    label = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        label = label.when(F.col("pair") == k, v)
    return df.unpivot(["session_id"], list(names), "pair", "correlation").withColumn("pair", label)


def case_summary(cases: DataFrame, value: str, passed: Column | None = None, keys: tuple[str, ...] = (), worst: Column | None = None) -> DataFrame:
    """n_cases (those with a value), n_pass, mean, sd, min, max of a value across sessions, and the worst of them: the
    largest, or the largest of the expression `worst`."""
    good = F.count_if(passed) if passed is not None else F.lit(None).cast("long")
    stats = [rows().alias("n_cases"), good.alias("n_pass"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.max(F.col(value) if worst is None else worst).alias("worst")]
    return cases.filter(F.col(value).isNotNull()).groupBy(*keys).agg(*stats)


def sync_error(latency: Column, duration: Column, polls: float = 4.0) -> dict[str, Column]:
    """Latency with half a polling interval, chance of the wrong slice, and quality."""
    total = latency + 1000.0 / polls / 2.0
    wrong = F.least(F.lit(1.0), total / duration)
    return {"total_latency_ms": total, "misassignment_rate": wrong, "data_quality_score": 1.0 - wrong}


def queue_bounds(arrivals: Column, processing_ms: Column) -> dict[str, Column]:
    """Load, delay in the queue (ms, null where it has no bound) and stability of a single server."""
    service = 1000.0 / processing_ms
    load = arrivals / service
    return {"utilization": load, "queue_delay_ms": F.when(load < 1, 1000.0 * load / (service * (1.0 - load))), "stable": load < 1}


def sync_performance(trace: DataFrame, durations: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean and 95th percentile of latency, loss, and accuracy against the mean time a slice is shown (one row: duration_ms
    of `durations`). Traces without any latency have accuracy 0."""
    high = quantiles(trace, "latency_ms", (0.95,), keys).select(*keys, F.col("q")[0].alias("p95_latency"))
    out = trace.groupBy(*keys).agg(F.avg("latency_ms").alias("mean_latency"), F.avg(F.col("latency_ms").isNull().cast("double")).alias("packet_loss"))
    out = out.join(high, list(keys), "left").crossJoin(F.broadcast(durations.agg(F.avg("duration_ms").alias("mean_duration"))))  # one row
    return out.select(*keys, "mean_latency", "p95_latency", "packet_loss", F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.col("mean_latency") / F.col("mean_duration")), F.lit(0.0)).alias("sync_accuracy"))


def interval_summary(df: DataFrame, value: str, keys: tuple[str, ...], low: float = 0.025, high: float = 0.975) -> DataFrame:
    out = df.groupBy(*keys).agg(rows().alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).join(quantiles(df, value, (low, 0.5, high), keys), list(keys))
    return out.select(*keys, "n", "mean", "sd", *[F.col("q")[i].alias(k) for i, k in enumerate(("low", "median", "high"))])


def crossing(curve: DataFrame, x: str, y: str, level: float, keys: tuple[str, ...]) -> DataFrame:
    """Per key: the largest x with y at the level or above, and where a line between neighbours first falls through it."""
    w = by(keys, x)
    df = curve.withColumns({"nx": F.lead(x).over(w), "ny": F.lead(y).over(w)})
    falls = (F.col(y) >= level) & (F.col("ny") < level)
    at = F.col(x) + (F.col(y) - level) * (F.col("nx") - F.col(x)) / (F.col(y) - F.col("ny"))
    return df.groupBy(*keys).agg(F.max(F.when(F.col(y) >= level, F.col(x))).alias("largest"), F.min(F.when(falls, at)).alias("crossing"))


def error_summary(df: DataFrame, error: str, keys: tuple[str, ...], limits: dict[str, float]) -> DataFrame:
    """n, mean, sd, median, 95th percentile, max of an error, and for each limit the share (percent) below it."""
    below = [(100.0 * F.avg((F.col(error) < limit).cast("double"))).alias(name) for name, limit in limits.items()]
    out = df.groupBy(*keys).agg(rows().alias("n"), F.avg(error).alias("mean"), F.stddev_samp(error).alias("sd"), F.max(error).alias("max"), *below)
    return out.join(quantiles(df, error, (0.5, 0.95), keys), list(keys)).select(*keys, "n", "mean", "sd", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "max", *limits)


def correlation_test(df: DataFrame, x: str, y: str, gate: float = 1e-10) -> DataFrame:
    """One row: Pearson's r of x with log10(y), its t, degrees of freedom and p; null where a side's variance is under the
    gate."""
    ly = F.log10(F.when(F.col(y) > 0, F.col(y)))
    used = df.select(F.col(x).alias("x"), ly.alias("y")).dropna()
    out = used.agg(rows().alias("n"), safe_corr("x", "y").alias("r"), F.least(F.var_samp("x"), F.var_samp("y")).alias("v"))
    r = F.when(F.col("v") > gate, F.col("r"))
    t, free = F.try_divide(r * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(1.0 - r * r)), (F.col("n") - 2).cast("double")
    return out.select("n", r.alias("r"), t.alias("t"), free.alias("df")).withColumn("p", two_sided_p(F.col("t"), F.col("df")))


def welch_test(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: Welch's t of the values where `group` holds against the others, degrees of freedom, two-sided p."""
    side = df.groupBy(group.alias("g")).agg(F.avg(value).alias("m"), (F.var_samp(value) / rows()).alias("e"), rows().alias("n"))
    both = side.agg(*[F.max(F.when(F.col("g") == hit, F.col(c))).alias(f"{c}{k}") for k, hit in ((1, True), (2, False)) for c in ("m", "e", "n")])
    e1, e2 = F.col("e1"), F.col("e2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    free = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return both.select(t.alias("t"), free.alias("df")).withColumn("p", two_sided_p(F.col("t"), F.col("df")))


def nearest_in_time(samples: DataFrame, others: DataFrame, time: str, other_time: str, tie: str, payload: tuple[str, ...], tolerance: float = 0.001) -> DataFrame:
    """Samples with `match`: the other row nearest in time of the same session (the earlier on ties), null beyond the
    tolerance. Two as-of searches, no pairs."""
    back = as_of(samples, others, time, other_time, payload, tie).withColumnRenamed("hit", "back")
    both = as_of(back, others, time, other_time, payload, tie, forward=True).withColumnRenamed("hit", "forth")
    before, after = F.col(time) - F.col("back.at"), F.col("forth.at") - F.col(time)
    pick = F.when(before.isNotNull() & (after.isNull() | (before <= after)), F.col("back")).otherwise(F.col("forth"))
    near = F.least(before, after) <= tolerance
    return both.withColumn("match", F.when(near, pick)).drop("back", "forth")


def event_signal(samples: DataFrame, events: DataFrame, time: str = "time_sec", start: str = "start", end: str = "end", tie: str = "event_id") -> DataFrame:
    """signal: 1 where the sample lies strictly within an event. Events may overlap: each start carries the largest end
    of all that have begun, so one as-of search answers for all of them."""
    marks = events.groupBy("session_id", start).agg(F.max(end).alias("until"), F.max(tie).alias(tie))
    marks = running(dense(marks, start, tie), "reach", F.col("until"), F.max, row="__row")
    # strictly after the start: a sample at a start looks at the starts before it, kept in `earlier`
    marks = over(marks, lambda w: {"earlier": F.lag("reach").over(w)}, before=1, row="__row")
    found = as_of(samples, marks, time, start, ("reach", "earlier"), tie)
    until = F.when(F.col("hit.at") < F.col(time), F.col("hit.reach")).otherwise(F.col("hit.earlier"))
    return found.withColumn("signal", F.coalesce((F.col(time) < until).cast("int"), F.lit(0))).drop("hit")


def bootstrap_latency(signal: DataFrame, replicates: int, max_lag: int, hertz: float, size: int = POSITIONS) -> DataFrame:
    """session_id, n, sd_ms: deviation of the latency estimate over resamples of each session's samples with replacement.

    Gaze is drawn and events stay in place. A replicate draws, for every position, the gaze at a hashed position. A block
    of positions works out what it draws, and asks each block of samples for its share in one packed row: 8 bytes a draw
    go there, 12 come back, whatever the session's length. Draws are uniform, so no block is asked for more than others.
    """
    if replicates * size >= 1 << 31:
        raise ValueError(f"at most {(1 << 31) // size} replicates")
    if max_lag > size:
        raise ValueError(f"the largest lag is over {size} positions")
    block = lambda c: F.floor(c / F.lit(size)).cast("long")
    order = numbered(signal.select("session_id", F.col("idx").cast("long").alias("idx"), F.col("gaze").cast("double").alias("gaze"), F.col("event").cast("double").alias("event")), SESSION, ("idx",), block(F.col("idx")), "at", total="size")
    order = stored(with_stats(order, SESSION, level_x=F.avg("gaze"), level_y=F.avg("event")).withColumns({"block": block(F.col("idx")), "source": block(F.col("at") - 1)}), "draws")
    kind = signal.schema["session_id"].dataType.simpleString()

    def asked(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        session, at_block = key
        of, idx = int(own["size"].iloc[0]), own["idx"].tolist()
        drawn = np.empty((replicates, len(idx)), np.int64)
        for r in range(replicates):
            head = f"{session}-{r + 1}-"
            drawn[r] = [int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:8], 16) for i in idx]
        drawn = (drawn % of).reshape(-1)
        place = (np.arange(replicates)[:, None] * size + (own["idx"].to_numpy() - at_block * size)).reshape(-1).astype("<i4")
        by_source = np.argsort(drawn, kind="stable")
        source, first = np.unique(drawn[by_source] // size, return_index=True)
        cut = lambda x: [p.tobytes() for p in np.split(x, first[1:])]
        return pd.DataFrame({"session_id": session, "source": source, "block": at_block, "offset": cut((drawn[by_source] % size).astype("<i4")), "place": cut(place[by_source])})

    def answered(key: tuple, requests: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        gaze = np.full(size, np.nan)
        gaze[own["at"].to_numpy() - 1 - key[1] * size] = (own["gaze"] - own["level_x"]).to_numpy()
        value = [gaze[np.frombuffer(o, "<i4")].tobytes() for o in requests["offset"]]
        return pd.DataFrame({"session_id": key[0], "block": requests["block"], "place": requests["place"], "value": value})

    def correlate(key: tuple, answers: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(answers):  # only the halo of its neighbours
            return pd.DataFrame([], columns=["session_id", "replicate", "lag", *SUMS])
        x, y = np.full((replicates, size), np.nan), np.full(size + 2 * max_lag, np.nan)
        for place, value in zip(answers["place"], answers["value"]):
            x.reshape(-1)[np.frombuffer(place, "<i4")] = np.frombuffer(value, "<f8")
        y[own["idx"].to_numpy() - key[1] * size + max_lag] = (own["event"] - own["level_y"]).to_numpy()
        every = [lag_sums(x[r], y, max_lag).assign(replicate=np.int32(r + 1)) for r in range(replicates)]
        return pd.concat(every).assign(session_id=key[0])[["session_id", "replicate", "lag", *SUMS]]

    requests = order.select("session_id", "idx", "size", "block").groupBy("session_id", "block").applyInPandas(asked, f"session_id {kind}, source long, block long, offset binary, place binary")
    own = order.select("session_id", "source", "at", "gaze", "level_x").groupBy("session_id", "source")
    answers = requests.groupBy("session_id", "source").cogroup(own).applyInPandas(answered, f"session_id {kind}, block long, place binary, value binary")
    near = F.explode(F.array_distinct(F.array(F.col("block"), block(F.col("idx") - max_lag), block(F.col("idx") + max_lag)))).alias("block")
    beside = order.select("session_id", "idx", "event", "level_y", near).groupBy("session_id", "block")
    sums = answers.groupBy("session_id", "block").cogroup(beside).applyInPandas(correlate, f"session_id {kind}, replicate int, lag int, {', '.join(f'{c} double' for c in SUMS)}")
    found = peaks(correlated(sums, ("session_id", "replicate")), hertz, ("session_id", "replicate"))
    return found.groupBy("session_id").agg(rows().alias("n"), F.stddev_samp("latency_ms").alias("sd_ms"))


def trial_columns(trials: DataFrame) -> DataFrame:
    """Logarithms, product and success of latency trials (error in ms; under 50 is a success)."""
    product = F.col("n_events") * F.col("snr")
    return trials.withColumns({
        "n_snr_product": product, "log_error": F.log(F.col("error") + 1), "log_n": F.log("n_events"), "log_snr": F.log(F.col("snr") + 1), "log_n_snr": F.log(product + 1),
        "log_fs": F.log("sampling_freq"), "success": F.col("error") < 50,
    })


def linear_model(df: DataFrame, features: tuple[str, ...], label: str) -> DataFrame:
    """term, estimate, std_error, low, high (95 % confidence limits), df of an ordinary least-squares fit; rows with a null
    are left out. The normal equations are sums over all rows; only these few numbers are solved on the driver."""
    used = df.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)]).dropna().withColumn("intercept", F.lit(1.0))
    terms, k = (*features, "intercept"), len(features) + 1
    # Sums around the means keep the equations well conditioned; the means come back into the intercept.
    mean = used.agg(*[F.avg(c).alias(c) for c in (*features, label)]).first()
    off = {c: F.col(c) - (mean[c] or 0.0) for c in (*features, label)} | {"intercept": F.col("intercept")}
    pairs = [(a, b) for i, a in enumerate((*terms, label)) for b in (*terms, label)[i:]]
    sums = dict(zip(pairs, used.agg(*[F.sum(off[a] * off[b]) for a, b in pairs]).first()))
    x = np.array([[sums.get((a, b), sums.get((b, a))) or 0.0 for b in terms] for a in terms])
    y = np.array([sums[a, label] or 0.0 for a in terms])
    n, spread = x[-1, -1], sums[label, label] or 0.0
    schema = "term string, estimate double, std_error double, low double, high double, df double"
    if n <= k or np.linalg.matrix_rank(x) < k:
        return df.sparkSession.createDataFrame([], schema)
    inverse = np.linalg.inv(x)
    beta = inverse @ y
    shift = np.eye(k)
    shift[-1, :-1] = [-mean[c] for c in features]
    cov = shift @ inverse @ shift.T * max(0.0, spread - beta @ y) / (n - k)
    estimate = shift @ beta
    estimate[-1] += mean[label]
    error, reach = np.sqrt(np.diag(cov)), student_quantile(0.975, n - k)
    return df.sparkSession.createDataFrame([(t, float(e), float(s), float(e - reach * s), float(e + reach * s), float(n - k)) for t, e, s in zip(terms, estimate, error)], schema)


@dataclass(frozen=True)
class Logistic:
    """A fitted logistic model: terms (products of features; the empty one is the intercept), estimates, their covariance."""

    terms: tuple[tuple[str, ...], ...]
    estimates: np.ndarray
    covariance: np.ndarray
    rows: int
    rounds: int
    #: Why there is no fit; empty where there is one.
    fault: str = ""

    def table(self, spark: SparkSession) -> DataFrame:
        """term, estimate, std_error, low, high (95 % limits), p (that the term is 0); no rows without a fit."""
        error = np.sqrt(np.diag(self.covariance))
        out = [(":".join(t) or "intercept", float(e), float(s), float(e - NORMAL * s), float(e + NORMAL * s)) for t, e, s in zip(self.terms, self.estimates, error)]
        df = spark.createDataFrame(out if not self.fault else [], "term string, estimate double, std_error double, low double, high double")
        return df.withColumn("p", 2.0 * normal_cdf(-F.abs(F.try_divide("estimate", "std_error"))))

    def predicted(self, df: DataFrame) -> DataFrame:
        """df with probability, and its 95 % limits probability_low and probability_high; null without a fit or a feature."""
        if self.fault:
            return df.withColumns({c: F.lit(None).cast("double") for c in ("probability", "probability_low", "probability_high")})
        x = [_product(t, {c: F.col(c).cast("double") for c in t}) for t in self.terms]
        at = _sum(x[i] * float(b) for i, b in enumerate(self.estimates))
        spread = F.sqrt(F.greatest(F.lit(0.0), _sum(x[i] * x[j] * float(self.covariance[i, j]) for i in range(len(x)) for j in range(len(x)))))
        chance = lambda v: 1.0 / (1.0 + F.exp(-v))
        df = df.withColumns({"__at": at, "__spread": spread})
        return df.withColumns({"probability": chance(F.col("__at")), "probability_low": chance(F.col("__at") - NORMAL * F.col("__spread")), "probability_high": chance(F.col("__at") + NORMAL * F.col("__spread"))}).drop("__at", "__spread")


def _product(term: tuple[str, ...], of: dict[str, Column]) -> Column:
    out = F.lit(1.0)
    for c in term:
        out = out * of[c]
    return out


def _sum(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def logistic_model(df: DataFrame, features: tuple[str, ...], label: str, rounds: int = 25, tolerance: float = 1e-12) -> Logistic:
    """Chance of the label by its features and all their products, fitted by reweighted least squares.

    Rows that share all features are counted once, before the shuffle and in a stored table; a round sums the Newton step's
    matrices over it, and only these few numbers are solved on the driver. Features are centred and scaled meanwhile, so the
    equations stay well conditioned. Rows with a null are left out. Constant features, too few different rows and labels that
    the features separate have no fit: `fault` says which.
    """
    terms = tuple(t for k in range(len(features) + 1) for t in combinations(features, k))
    used = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__label")).dropna()
    cells = stored(used.groupBy(*features).agg(rows().cast("double").alias("__n"), F.sum("__label").alias("__k")), "logistic")
    n, hits, *sums = cells.agg(F.coalesce(F.sum("__n"), F.lit(0.0)), F.sum("__k"), *[F.sum(F.col("__n") * F.col(c)) for c in features]).first()
    none = lambda why, k=0: Logistic(terms, np.zeros(len(terms)), np.zeros((len(terms), len(terms))), int(n), k, why)
    if n == 0 or hits in (0, n):
        return none("one label only")
    mean = {c: v / n for c, v in zip(features, sums)}
    spread = cells.agg(*[F.sqrt(F.sum(F.col("__n") * (F.col(c) - mean[c]) ** 2) / n) for c in features]).first()
    if any(not v for v in spread):
        return none("constant feature")
    scale = dict(zip(features, spread))
    z = {c: (F.col(c) - mean[c]) / scale[c] for c in features}
    cells = cells.select("__n", "__k", *[_product(t, z).alias(f"t{i}") for i, t in enumerate(terms)])
    x = [F.col(f"t{i}") for i in range(len(terms))]
    pairs, beta, done = [(i, j) for i in range(len(x)) for j in range(i, len(x))], np.zeros(len(x)), 0

    def step() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + F.exp(-F.least(F.greatest(_sum(v * float(b) for v, b in zip(x, beta)), F.lit(-30.0)), F.lit(30.0))))
        at = cells.withColumn("__p", p)
        weight, off = F.col("__n") * F.col("__p") * (1.0 - F.col("__p")), F.col("__k") - F.col("__n") * F.col("__p")
        got = list(at.agg(*[F.sum(x[i] * x[j] * weight) for i, j in pairs], *[F.sum(v * off) for v in x]).first())
        h = np.zeros((len(x), len(x)))
        for (i, j), v in zip(pairs, got):
            h[i, j] = h[j, i] = v
        return h, np.array(got[len(pairs) :])

    h, slope = step()
    while done < rounds:
        if np.linalg.cond(h) > 1e13:
            return none("labels are separated" if done else "too few different rows", done)
        move = np.linalg.solve(h, slope)
        beta, done = beta + move, done + 1
        h, slope = step()
        if np.abs(move).max() < tolerance:
            break
    else:
        return none("labels are separated", done)
    # Products of centred features are sums of products of the features themselves.
    back = np.zeros((len(terms), len(terms)))
    for i, t in enumerate(terms):
        for k in range(len(t) + 1):
            for kept_ in combinations(t, k):
                back[terms.index(kept_), i] = math.prod(1 / scale[c] for c in t) * math.prod(-mean[c] for c in t if c not in kept_)
    return Logistic(terms, back @ beta, back @ np.linalg.inv(h) @ back.T, int(n), done)
