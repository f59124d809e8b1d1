"""Queries on velocity, fixations, noise, weights and the uncertainty evaluation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from oculith.functions.columns import by, equal_bin, normal_cdf, rounded, rows
from oculith.operators import kinematics, uncertainty
from oculith.operators.ordered import over, quantiles, with_stats
from oculith.plans.base import SCREEN, H, W, events, fixed, fixed_norm, gaze, integrated, moving, on_screen, rsql, spans

#: Samples a second that the recordings are meant to have.
NOMINAL = 8.0
WS = "(partition by session_id order by time_sec, gaze_id)"
JIT = """
 j0 as (select *, case when count(*) over w5 = 5 then avg(gaze_x) over w5 end as mx, case when count(*) over w5 = 5 then avg(gaze_y) over w5 end as my,
  first(gaze_x) over wa as fx, first(gaze_y) over wa as fy from m
  window w5 as (partition by session_id order by time_sec, gaze_id rows between 2 preceding and 2 following), wa as (partition by session_id order by time_sec, gaze_id rows between unbounded preceding and unbounded following)),
 j as (select *, sqrt((gaze_x - mx) ** 2 + (gaze_y - my) ** 2) as jitter, sqrt((gaze_x - fx) ** 2 + (gaze_y - fy) ** 2) as drift,
  ((lead(mx) over w) - (lag(mx) over w)) / nullif((lead(time_sec) over w) - (lag(time_sec) over w), 0) as vx, ((lead(my) over w) - (lag(my) over w)) / nullif((lead(time_sec) over w) - (lag(time_sec) over w), 0) as vy
  from j0 window w as (partition by session_id order by time_sec, gaze_id)),
 js as (select *, sqrt(vx * vx + vy * vy) as smooth_velocity from j)"""
NEAR = """
 near as (select i.*, (select min(abs(i.time_aligned - t.transition_time)) from tr t where t.session_id = i.session_id) as d from i)"""
NEAR_ALL = """
 neara as (select g.session_id, g.gaze_id, (select min(abs(g.time_sec - t.z_time_sec)) from z t where t.session_id = g.session_id) as d from g)"""
SAFE = "try_cast(case when stddev_samp({x}) > 0 and stddev_samp({y}) > 0 then covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) end as double)"
R2 = "case when var_samp({y}) > 0 then regr_r2({y}, {x}) end"


def corr(x: str, y: str) -> str:
    return SAFE.format(x=x, y=y)


def phi(z: str) -> str:
    u = f"(abs({z}) / sqrt(2::double))"
    t = f"(1 / (1 + 0.3275911::double * {u}))"
    poly = f"(((((1.061405429::double * {t} - 1.453152027::double) * {t}) + 1.421413741::double) * {t} - 0.284496736::double) * {t} + 0.254829592::double) * {t}"
    return f"(case when {z} >= 0 then 0.5::double * (2 - {poly} * exp(-{u} * {u})) else 0.5::double * ({poly} * exp(-{u} * {u})) end)"


def p1_bins(s, d):
    v = F.col("velocity_deg_s")
    known = with_stats(moving(s, d).filter(v.isNotNull()), ("session_id",), low=F.min(v), high=F.max(v))
    return rounded(known.withColumn("bin", equal_bin(v, F.col("low"), F.col("high"), 50)).groupBy("session_id", "bin").agg(rows().alias("n")))


def a30(s, d):
    return rounded(kinematics.attention_weights(fixed_norm(s, d)).select("session_id", "gaze_id", "attention_weight"))


def a13(s, d):
    """Samples and share of each class of confidence, the largest first, with the session's ambiguous samples and share."""
    c = uncertainty.slice_confidence(on_screen(s, d), events(s, d), SCREEN)
    n = c.groupBy("session_id", "assignment_confidence").agg(rows().alias("n"), F.count_if("is_ambiguous").alias("ambiguous"))
    own = by(("session_id",))  # four rows a session
    n = n.withColumns({"pct": 100.0 * F.col("n") / F.sum("n").over(own), "n_ambiguous": F.sum("ambiguous").over(own)}).withColumn("pct_ambiguous", 100.0 * F.col("n_ambiguous") / F.sum("n").over(own))
    return rounded(n.drop("ambiguous").orderBy("session_id", F.desc("n")))


def a44(s, d):
    """Recording diagnostics with the rows of each file: gaze, and slice events by plane (a file each)."""
    g = moving(s, d).groupBy("session_id").agg(rows().alias("n"), F.max("time_sec").alias("duration"), F.try_divide(rows().cast("double"), F.max("time_sec")).alias("rate"), F.count_if(F.col("dt") > 1).alias("n_gaps"))
    z = events(s, d).groupBy("session_id").agg(*[F.count_if(F.col("plane") == p).alias(f"n_{p.lower()}") for p in ("AXIAL", "SAGITTAL", "CORONAL")])
    files = [f"n_{p}" for p in ("axial", "sagittal", "coronal")]
    return rounded(g.join(z, "session_id", "left").fillna(0, files).select("session_id", "n", "duration", "rate", "n_gaps", *files))


def a45(s, d):
    """How well each recording keeps its nominal rate (8 samples a second), rounded as reported."""
    m = moving(s, d).groupBy("session_id").agg(rows().alias("n"), F.avg("dt").alias("mean_interval"), F.stddev_samp("dt").alias("sd_interval"), F.stddev_samp("gaze_x").alias("sd_x"), F.stddev_samp("gaze_y").alias("sd_y"), F.bround(F.try_divide(F.lit(1.0), F.avg("dt")), 2).alias("rate"), F.bround(F.try_divide(F.lit(1.0), F.avg("dt")) - NOMINAL, 2).alias("rate_error"))
    apparent = spans(s, d).select("session_id", F.bround((F.col("z_duration") - F.col("gaze_duration")) * 1000, 1).alias("apparent_latency_ms"))
    return rounded(m.join(apparent, "session_id", "left"))


def a71(s, d):
    """Summary of a column over everything, and by plane of what was on screen (row `all` first)."""
    i = integrated(s, d)
    stats = [F.min("gaze_x").alias("min"), F.avg("gaze_x").alias("mean"), F.max("gaze_x").alias("max"), F.stddev_samp("gaze_x").alias("sd")]
    both = i.unionByName(i.withColumn("plane", F.lit("all"))).select("plane", "gaze_x")
    q = quantiles(both, "gaze_x", (0.25, 0.5, 0.75), ("plane",))
    out = both.groupBy("plane").agg(*stats).join(q, "plane")
    return rounded(out.select("plane", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), "mean", F.col("q")[2].alias("q3"), "max", "sd"))


def w11(s, d):
    centred = with_stats(integrated(s, d), ("session_id", "z_event_id"), centre=F.avg("time_aligned"))
    return rounded(centred.select("session_id", "gaze_id", (F.col("time_aligned") - F.col("centre")).alias("residual")))


def w8(s, d):
    means = lambda w: {"mean5": kinematics.rolling_mean("gaze_x", 2, 2, w), "mean250": kinematics.rolling_mean("gaze_x", 124, 125, w)}
    return rounded(over(gaze(s, d), means, before=124, after=125).select("session_id", "gaze_id", "mean5", "mean250"))


def w12(s, d):
    ahead = lambda w: {"step_x": F.coalesce(F.lead("gaze_x").over(w) - F.col("gaze_x"), F.lit(0.0))}
    return rounded(over(gaze(s, d), ahead, after=1).select("session_id", "gaze_id", "step_x"))


def a23(s, d):
    """All five parts of the evaluation, one row per session."""
    g, z, m = gaze(s, d), events(s, d), moving(s, d)
    i = integrated(s, d).select("session_id", "gaze_id", "time_sec", "time_aligned", "z_event_id")
    p1 = uncertainty.velocity_coupling(m, SCREEN).select("session_id", F.col("r_squared").alias("p1_r_squared"), F.col("pass").alias("p1_pass"))
    p2 = uncertainty.independence(kinematics.jitter_and_drift(m), SCREEN).select("session_id", F.col("max_correlation").alias("p2_max"), F.col("pass").alias("p2_pass"))
    p3 = uncertainty.accumulation(i).select("session_id", F.col("variance_ratio").alias("p3_ratio"))
    p4 = uncertainty.slice_assignment(i, z, SCREEN).select("session_id", F.col("pct_ambiguous").alias("p4_pct"))
    p5 = uncertainty.calibration_drift(g, SCREEN).select("session_id", F.col("rate_per_min").alias("p5_rate"))
    noise = kinematics.tracker_noise(fixed(s, d), SCREEN).select("session_id", F.col("sigma_norm"))
    out = g.select("session_id").distinct()
    for part in (noise, p1, p2, p3, p4, p5):
        out = out.join(part, "session_id", "left")
    return rounded(out)


P1 = """
 pv as (select *, min(velocity_deg_s) over (partition by session_id) as lo, max(velocity_deg_s) over (partition by session_id) as hi from m where velocity_deg_s is not null and displacement is not null),
 pb as (select session_id, coalesce(greatest(1, least({n}, ceil((velocity_deg_s - lo) * {n}e0 / nullif(hi - lo, 0)))), 1)::int as bin, avg(velocity_deg_s) as x, stddev_samp(displacement) as y, count(*) as n from pv group by 1, 2),
 p1 as (select session_id, count(*) as n_bins, case when var_samp(y) > 0 then regr_r2(y, x) end as r2, regr_slope(y, x) as sl from pb where n >= 10 group by 1)"""
P2 = f", p2a as (select session_id, count(*) as n, {corr('jitter', 'displacement')} as a, {corr('jitter', 'drift')} as b, {corr('displacement', 'drift')} as c from j where jitter is not null and displacement is not null and drift is not null group by 1), p2 as (select session_id, n, case when n >= 50 then a end as a, case when n >= 50 then b end as b, case when n >= 50 then c end as c from p2a)"
P3 = ", p3a as (select *, time_aligned - avg(time_aligned) over (partition by session_id, z_event_id) as r, ntile(4) over (partition by session_id order by time_sec, gaze_id) as seg from i), p3b as (select session_id, seg, var_samp(r) as v, stddev_samp(r) as sd, avg(time_sec) as t from p3a group by 1, 2), p3 as (select session_id, max(v) filter (where seg = 4) / nullif(max(v) filter (where seg = 1), 0) as ratio, sqrt(max(v) filter (where seg = 1)) as f, sqrt(max(v) filter (where seg = 4)) as l, case when count(*) >= 3 then regr_slope(sd, t) end as sl from p3b group by 1)"
P5 = ", p5a as (select session_id, seg, avg(gaze_x) as x, avg(gaze_y) as y, avg(time_sec) as t from (select *, ntile(4) over (partition by session_id order by time_sec, gaze_id) as seg from g) group by 1, 2), p5b as (select session_id, max(x) filter (where seg = 4) - max(x) filter (where seg = 1) as dx, max(y) filter (where seg = 4) - max(y) filter (where seg = 1) as dy, regr_slope(x, t) as sx, regr_slope(y, t) as sy from p5a group by 1), p5 as (select *, sqrt(dx * dx + dy * dy) as total, sqrt(dx * dx + dy * dy) / nullif(gaze_duration, 0) * 60 as rate from p5b join sp0 using (session_id))"
A11 = ", fg as (select session_id, fixation_group, var_samp(gaze_x) as vx, var_samp(gaze_y) as vy, count(*) as n from f where is_fixation group by 1, 2), fw as (select session_id, sum(n)::bigint as nf, count(*) filter (where n >= 5) as na, sqrt(sum(vx * n) filter (where n >= 5) / nullif(sum(n) filter (where n >= 5), 0)) as wx, sqrt(sum(vy * n) filter (where n >= 5) / nullif(sum(n) filter (where n >= 5), 0)) as wy from fg group by 1), fo as (select session_id, stddev_samp(gaze_x) as ox, stddev_samp(gaze_y) as oy from f where is_fixation group by 1), noise as (select session_id, nf, na, case when nf >= 10 then coalesce(wx, ox) end as sx, case when nf >= 10 then coalesce(wy, oy) end as sy, case when nf < 10 then 'insufficient_data' when na > 0 then 'within_fixation_variance' else 'overall_fixation_variance' end as method from fw join fo using (session_id))"

QUERIES = {
    "w1_velocity": (lambda s, d: rounded(moving(s, d).select("session_id", "gaze_id", "dt", "displacement", "velocity_norm", "displacement_deg", "velocity_deg_s")), rsql("session_id; gaze_id; ~dt; ~displacement; ~velocity_norm; ~displacement_deg; ~velocity_deg_s", "from m")),
    "w2_fixations_deg": (lambda s, d: fixed(s, d).select("session_id", "gaze_id", "fixation_group", "n_samples", "is_fixation"), rsql("session_id; gaze_id; fixation_group; n_samples; is_fixation", "from f")),
    "j6_fixation_stats": (
        lambda s, d: fixed(s, d).select("session_id", "gaze_id", (F.col("n_samples") >= SCREEN.min_samples).alias("valid_fixation")),
        rsql("session_id; gaze_id; n_samples >= 3 as valid_fixation", "from f"),
    ),
    "w3_fixations_norm": (
        lambda s, d: rounded(fixed_norm(s, d).select("session_id", "gaze_id", "velocity", "is_fixation", F.col("fixation_id").cast("double").alias("fixation_id"), "fixation_duration")),
        rsql("session_id; gaze_id; ~velocity; is_fixation_n as is_fixation; fixation_id::double as fixation_id; ~fixation_duration", "from fn"),
    ),
    "a9_fixation_events": (
        lambda s, d: rounded(fixed(s, d).filter("is_fixation").groupBy("session_id", "fixation_group").agg(rows().alias("n_samples"), ((F.max("time_sec") - F.min("time_sec")) * 1000).alias("duration_ms"))),
        rsql("session_id; fixation_group; count(*) as n_samples; ~(max(time_sec) - min(time_sec)) * 1000 as duration_ms", "from f where is_fixation group by all"),
    ),
    "a10_fixation_totals": (
        lambda s, d: rounded(fixed(s, d).groupBy("session_id").agg(F.count_distinct(F.when(F.col("is_fixation"), F.col("fixation_group"))).alias("n_fixations"), F.count_if("is_fixation").alias("n_samples"), (100 * F.avg(F.col("is_fixation").cast("double"))).alias("pct"))),
        rsql("session_id; count(distinct fixation_group) filter (where is_fixation) as n_fixations; count(*) filter (where is_fixation) as n_samples; ~100 * avg(is_fixation::int) as pct", "from f group by 1"),
    ),
    "a11_tracker_noise": (
        lambda s, d: rounded(kinematics.tracker_noise(fixed(s, d), SCREEN)),
        rsql(f"session_id; nf as n_fixation_samples; na as n_fixations_analyzed; ~sx as sigma_x; ~sy as sigma_y; ~sqrt(sx * sx + sy * sy) as sigma_norm; ~sqrt((sx * {W!r}::double) ** 2 + (sy * {H!r}::double) ** 2) as sigma_deg; method", "from noise", A11[1:]),
    ),
    "a12_velocity_distribution": (
        lambda s, d: rounded(kinematics.velocity_distribution(moving(s, d), SCREEN)),
        rsql(
            "session_id; count(v) as n; ~avg(v) as mean; ~stddev_samp(v) as sd; ~max(v) as max; count(*) filter (where v < 30) as n_fixation; count(*) filter (where v >= 30) as n_saccade; ~avg(v) filter (where v < 30) as mean_fixation; ~avg(v) filter (where v >= 30) as mean_saccade; ~max(v) filter (where v >= 30) as max_saccade;"
            + "; ".join(f"~quantile_cont(v, {q}) as p{round(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)),
            "from (select session_id, velocity_deg_s as v from m where velocity_deg_s is not null) group by 1",
        ),
    ),
    "a68_velocity_histogram": (p1_bins, rsql("session_id; bin; n", "from pb", P1.format(n=50).lstrip())),
    "a30_attention_weights": (
        a30,
        rsql(
            "session_id; gaze_id; ~case when total > 0 then raw * count(*) over (partition by session_id) / total else raw end as attention_weight", "from aw2",
            "aw0 as (select *, case when is_fixation_n then coalesce(fixation_duration, 0) else 0 end as du from fn), aw1 as (select *, (case when avg(du) over (partition by session_id) > 0.000001 then du / avg(du) over (partition by session_id) else du end) / (1 + velocity / 0.05::double) as raw from aw0), aw2 as (select *, sum(raw) over (partition by session_id) as total from aw1)",
        ),
    ),
    "w8_rolling_mean": (
        w8,
        rsql("session_id; gaze_id; ~case when count(*) over a = 5 then avg(gaze_x) over a end as mean5; ~case when count(*) over b = 250 then avg(gaze_x) over b end as mean250", "from g window a as (partition by session_id order by time_sec, gaze_id rows between 2 preceding and 2 following), b as (partition by session_id order by time_sec, gaze_id rows between 124 preceding and 125 following)"),
    ),
    "w9_central_velocity": (lambda s, d: rounded(kinematics.smooth_velocity(gaze(s, d)).select("session_id", "gaze_id", "vx", "vy", "smooth_velocity")), rsql("session_id; gaze_id; ~vx; ~vy; ~smooth_velocity", "from js", JIT.lstrip())),
    "w10_drift": (lambda s, d: rounded(kinematics.jitter_and_drift(moving(s, d)).select("session_id", "gaze_id", "jitter", "drift")), rsql("session_id; gaze_id; ~jitter; ~drift", "from js", JIT.lstrip())),
    "w7_segments": (lambda s, d: uncertainty.segments(gaze(s, d)).select("session_id", "gaze_id", "segment"), rsql(f"session_id; gaze_id; ntile(4) over {WS}::int as segment", "from g")),
    "w11_interval_residual": (
        w11,
        rsql("session_id; gaze_id; ~time_aligned - avg(time_aligned) over (partition by session_id, z_event_id) as residual", "from i"),
    ),
    "w12_forward_direction": (
        w12,
        rsql(f"session_id; gaze_id; ~coalesce(lead(gaze_x) over {WS} - gaze_x, 0) as step_x", "from g"),
    ),
    "w13_clock_offset": (
        lambda s, d: rounded(gaze(s, d).groupBy("session_id").agg(F.min_by("gaze_x", "gaze_id").alias("first_x"), F.max_by("gaze_x", "gaze_id").alias("last_x"))),
        rsql("session_id; ~arg_min(gaze_x, gaze_id) as first_x; ~arg_max(gaze_x, gaze_id) as last_x", "from g group by 1"),
    ),
    "w15_every_100th": (lambda s, d: gaze(s, d).filter((F.col("gaze_id") - 1) % 100 == 0).select("session_id", "gaze_id"), rsql("session_id; gaze_id", "from g where (gaze_id - 1) % 100 = 0")),
    "j5_nearest_transition": (
        lambda s, d: rounded(uncertainty.nearest_transition(on_screen(s, d), kinematics.transitions(events(s, d))).select("session_id", "gaze_id", "dist_to_transition")),
        rsql("session_id; gaze_id; ~d as dist_to_transition", "from near", NEAR.lstrip()),
    ),
    "a13_confidence": (
        a13,
        rsql("session_id; c as assignment_confidence; n; ~100e0 * n / sum(n) over (partition by session_id) as pct; (sum(a) over (partition by session_id))::bigint as n_ambiguous; ~100e0 * sum(a) over (partition by session_id) / sum(n) over (partition by session_id) as pct_ambiguous", "from (select session_id, case when d > 0.06::double then 'High (>99.7%)' when d > 0.04::double then 'Good (95-99.7%)' when d > 0.02::double then 'Moderate (68-95%)' else 'Ambiguous (<68%)' end as c, count(*) as n, count(*) filter (where d <= 0.06::double) as a from near group by 1, 2)", NEAR.lstrip()),
    ),
    "a20_p4_slice_assignment": (
        lambda s, d: rounded(uncertainty.slice_assignment(on_screen(s, d), events(s, d), SCREEN)),
        rsql("session_id; coalesce(k.n, 0) as n_transitions; count(*) as n_total; count(*) filter (where d <= 0.06::double) as n_ambiguous; ~100e0 * count(*) filter (where d <= 0.06::double) / count(*) as pct_ambiguous", "from near left join (select session_id, count(*) as n from tr group by 1) k using (session_id) group by session_id, k.n", NEAR.lstrip()),
    ),
    "a14_p1_velocity_coupling": (
        lambda s, d: rounded(uncertainty.velocity_coupling(moving(s, d), SCREEN)),
        rsql('session_id; n_bins; ~case when n_bins >= 3 then r2 end as r_squared; ~case when n_bins >= 3 then sl end as slope; coalesce(n_bins >= 3 and r2 >= 0.7 and sl > 0, false) as pass', "from p1", P1.format(n=10).lstrip()),
    ),
    "a15_p1_recorded": (
        lambda s, d: rounded(uncertainty.recorded_coupling(kinematics.smooth_velocity(gaze(s, d)))),
        rsql(
            f"session_id; sum(n)::bigint as n; ~{corr('x', 'y')} as correlation; ~regr_slope(log10(y), log10(x)) as log_slope; ~{R2.format(y='log10(y)', x='log10(x)')} as log_r2", "from rb group by 1",
            JIT.lstrip() + ", rv as (select session_id, smooth_velocity as v, jitter as r from js where smooth_velocity > 0 and jitter is not null), rk as (select session_id, quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as q from rv group by 1), rb as (select session_id, bin, avg(v) as x, avg(r) as y, count(*) as n from (select session_id, v, r, 1 + len(list_filter(q[2:10], lambda b: v > b)) as bin from rv join rk using (session_id) where len(list_distinct(q)) = 11) group by 1, 2)",
        ),
    ),
    "a16_p2_independence": (
        lambda s, d: rounded(uncertainty.independence(kinematics.jitter_and_drift(moving(s, d)), SCREEN)),
        rsql("session_id; n; ~a as cor_jitter_displacement; ~b as cor_jitter_drift; ~c as cor_displacement_drift; ~case when a is not null and b is not null and c is not null then greatest(abs(a), abs(b), abs(c)) end as max_correlation; coalesce(greatest(abs(a), abs(b), abs(c)) < 0.3, false) as pass", "from p2", JIT.lstrip() + P2),
    ),
    "a18_p3_accumulation": (
        lambda s, d: rounded(uncertainty.accumulation(integrated(s, d))),
        rsql("session_id; ~ratio as variance_ratio; ~f as first_sd; ~l as last_sd; ~sl as trend_slope; ratio > 1 as grows_with_time", "from p3", P3[1:].lstrip()),
    ),
    "a19_p3_clock_drift": (
        lambda s, d: rounded(uncertainty.clock_drift(gaze(s, d))),
        rsql(
            f"session_id; count(*) as n; ~arg_max(e, gaze_id) as total_ms; ~regr_slope(e, time_sec) * 1000 as slope_ppm; ~{R2.format(y='e', x='time_sec')} as r_squared", "from (select *, (o - first(o) over (partition by session_id order by gaze_id)) / 1e3 as e from (select *, (system_time_stamp - device_time_stamp)::double as o from g)) group by 1",
        ),
    ),
    "a21_p4_recorded": (
        lambda s, d: rounded(uncertainty.recorded_assignment(gaze(s, d), events(s, d), SCREEN)),
        rsql(
            f"session_id; count(*) as n; n_events; ~100 * avg((d < 0.06::double)::int) as pct_ambiguous; ~avg({phi('(d / 0.02::double)')}) as mean_p; ~quantile_cont(d, 0.5) as median_distance; count(*) filter (where d < 0.005::double) as n_close; ~avg({phi('(d / 0.02::double)')}) filter (where d < 0.005::double) as mean_p_close; case when n_events < 5 then 'too few events' else 'ok' end as status",
            "from neara join sp1 using (session_id) group by session_id, n_events", NEAR_ALL.lstrip(),
        ),
    ),
    "f33_p_correct": (
        lambda s, d: rounded(uncertainty.nearest_transition(gaze(s, d), events(s, d).select("session_id", F.col("z_time_sec").alias("transition_time"), F.col("z_event_id").alias("transition_id")), "time_sec").select("session_id", "gaze_id", normal_cdf(F.col("dist_to_transition") / 0.02).alias("p_correct"))),
        rsql(f"session_id; gaze_id; ~{phi('(d / 0.02::double)')} as p_correct", "from neara", NEAR_ALL.lstrip()),
    ),
    "a22_p5_calibration_drift": (
        lambda s, d: rounded(uncertainty.calibration_drift(gaze(s, d), SCREEN)),
        rsql(f"session_id; ~dx as drift_x; ~dy as drift_y; ~total as total_drift; ~sqrt((dx * {W!r}::double) ** 2 + (dy * {H!r}::double) ** 2) as total_drift_deg; ~rate as rate_per_min; ~sx as slope_x; ~sy as slope_y; rate > 0.01::double as needs_recalibration", "from p5", P5[1:].lstrip()),
    ),
    "a23_uncertainty_evaluation": (
        a23,
        rsql(
            "session_id; ~sqrt(noise.sx * noise.sx + noise.sy * noise.sy) as sigma_norm; ~case when n_bins >= 3 then r2 end as p1_r_squared; case when p1.session_id is not null then coalesce(n_bins >= 3 and r2 >= 0.7 and p1.sl > 0, false) end as p1_pass; ~case when a is not null and b is not null and c is not null then greatest(abs(a), abs(b), abs(c)) end as p2_max; case when p2.session_id is not null then coalesce(greatest(abs(a), abs(b), abs(c)) < 0.3, false) end as p2_pass; ~p3.ratio as p3_ratio; ~p4.pct as p4_pct; ~p5.rate as p5_rate",
            "from sp0 left join noise using (session_id) left join p1 using (session_id) left join p2 using (session_id) left join p3 using (session_id) left join p4 using (session_id) left join p5 using (session_id)",
            JIT.lstrip() + "," + P1.format(n=10) + "," + NEAR + P2 + P3 + P5 + A11 + ", p4 as (select session_id, 100e0 * count(*) filter (where d <= 0.06::double) / count(*) as pct from near group by 1)",
        ),
    ),
    "f28_expected_variance": (
        lambda s, d: rounded(moving(s, d).select("session_id", "gaze_id", uncertainty.expected_variance(F.coalesce("velocity_deg_s", F.lit(0.0)), F.col("time_sec")).alias("variance"))),
        rsql("session_id; gaze_id; ~0.25::double + (0.01::double * time_sec) ** 2 + (coalesce(velocity_deg_s, 0) / 60 * 0.02::double) ** 2 + 0.01::double as variance", "from m"),
    ),
    "f41_sigma_delta": (
        lambda s, d: rounded(events(s, d).select("session_id", "z_event_id", F.sqrt(F.lit(0.001**2) + F.pow(0.00001 * F.col("z_time_sec"), F.lit(2.0))).alias("sigma"))),
        rsql("session_id; z_event_id; ~sqrt(0.001::double ** 2 + (0.00001::double * z_time_sec) ** 2) as sigma", "from z"),
    ),
    "f44_theory_curve": (
        lambda s, d: rounded(moving(s, d).groupBy("session_id").agg(F.max("velocity_norm").alias("most")).select("session_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("step"), "most").select("session_id", "step", (F.col("most") * F.col("step") / 99.0 * 0.02 * math.sqrt(2 / math.pi)).alias("error"))),
        rsql(f"session_id; t.step::int as step; ~most * t.step / 99e0 * 0.02::double * {math.sqrt(2 / math.pi)!r}::double as error", "from (select session_id, max(velocity_norm) as most from m group by 1), (select unnest(range(100)) as step) t"),
    ),
    "a44_recording_diagnostics": (
        a44,
        rsql(
            "session_id; n; ~duration; ~n / nullif(duration, 0) as rate; n_gaps; coalesce(a, 0) as n_axial; coalesce(b, 0) as n_sagittal; coalesce(c, 0) as n_coronal",
            "from (select session_id, count(*) as n, max(time_sec) as duration, count(*) filter (where dt > 1) as n_gaps from m group by 1) left join (select session_id, count(*) filter (where plane = 'AXIAL') as a, count(*) filter (where plane = 'SAGITTAL') as b, count(*) filter (where plane = 'CORONAL') as c from ev group by 1) using (session_id)",
        ),
    ),
    "a45_sampling_validation": (
        a45,
        rsql("session_id; n; ~mi as mean_interval; ~si as sd_interval; ~sx as sd_x; ~sy as sd_y; ~round_even(1 / mi, 2) as rate; ~round_even(1 / mi - 8, 2) as rate_error; ~round_even((z_duration - gaze_duration) * 1e3, 1) as apparent_latency_ms", "from (select session_id, count(*) as n, avg(dt) as mi, stddev_samp(dt) as si, stddev_samp(gaze_x) as sx, stddev_samp(gaze_y) as sy from m group by 1) left join spans using (session_id)"),
    ),
    "a71_column_summary": (
        a71,
        rsql("case when grouping(plane) = 1 then 'all' else plane end as plane; ~min(gaze_x) as min; ~quantile_cont(gaze_x, 0.25) as q1; ~quantile_cont(gaze_x, 0.5) as median; ~avg(gaze_x) as mean; ~quantile_cont(gaze_x, 0.75) as q3; ~max(gaze_x) as max; ~stddev_samp(gaze_x) as sd", "from i group by grouping sets ((plane), ())"),
    ),
}
