"""Queries on error models, cross-session summaries, latency studies and attention maps."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from oculith.functions.columns import by, equal_bin, norm2, rounded, rows, safe_r2
from oculith.operators.ordered import with_stats
from oculith.operators import align, geometry, heatmap, kinematics, studies, uncertainty
from oculith.operators.geometry import slice_number
from oculith.plans.base import SCREEN, events, gaze, integrated, moving, on_screen, rsql, spans
from oculith.plans.geometry import LOC, SIG, VOLUME, located, signals, valued
from oculith.plans.motion import JIT, P2, corr, phi
from oculith.sources import recordings, trials

DIMS = VOLUME.dims

# error components ---------------------------------------------------------------------------------------------------


def induced(s, d):
    return studies.induced_error(trials.components(moving(s, d)))


IND = """
 co as (select session_id, gaze_id, time_sec, coalesce(velocity_deg_s, 0) as velocity, gaze_x as true_x, gaze_y as true_y, ((gaze_id * 17) % 41 - 20) / 1e3 as temporal_offset,
  ((gaze_id * 7) % 19 - 9) / 1e3 as tnx, ((gaze_id * 11) % 23 - 11) / 1e3 as tny, time_sec / 1e4 + ((gaze_id * 31) % 13 - 6) / 1e5 as drift_x from m),
 ie0 as (select *, velocity / 60 as vn, coalesce(lead(true_x) over w - true_x, 0) as tox, coalesce(lead(true_y) over w - true_y, 0) as toy from co window w as (partition by session_id order by time_sec, gaze_id)),
 ie1 as (select *, case when vn > 0.001::double then vn * temporal_offset * coalesce(tox / nullif(sqrt(tox * tox + toy * toy), 0), 0) else 0 end as iex, case when vn > 0.001::double then vn * temporal_offset * coalesce(toy / nullif(sqrt(tox * tox + toy * toy), 0), 0) else 0 end as iey from ie0),
 ie as (select *, sqrt(iex * iex + iey * iey) as mag from ie1),
 mo as (select * from ie where vn > 0.01::double),
 br as (select session_id, quantile_cont(vn, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) as b from mo group by 1),
 bi as (select mo.*, case when len(list_distinct(b)) = 11 then len(list_filter(b[2:10], lambda q: vn > q)) + 1 end as bin from mo join br using (session_id)),
 bs as (select session_id, bin::int as bin, count(*) as n, avg(vn) as x, avg(mag) as y, stddev_samp(mag) as sd from bi where bin is not null group by 1, 2)"""
CPL = IND + """,
 c0 as (select session_id, count(*) as nb, sum(n) as w, sum(n * x) as wx, sum(n * y) as wy, sum(n * x * x) as wxx, sum(n * x * y) as wxy, sum(n * y * y) as wyy, {corr} as co from bs where sd is not null group by 1),
 c1 as (select session_id, count(*) as ns from mo group by 1),
 c2 as (select *, coalesce(ns >= 50 and nb >= 3, false) as ok, wxx - wx * wx / w as sxx, wxy - wx * wy / w as sxy, wyy - wy * wy / w as syy from c1 left join c0 using (session_id)),
 c3 as (select *, case when ok then sxy / nullif(sxx, 0) end as sl, 0.02::double * sqrt(2 / pi()) as ex from c2)""".format(corr=corr("x", "y"))


def sigma_events(s, d):
    z = events(s, d)
    jitter = F.lit(1.0) + ((F.col("z_event_id") * 13) % 7 - 3) / F.lit(1e2)
    return z.select("session_id", F.col("z_time_sec").alias("event_time_sec"), (F.sqrt(F.lit(1e-6) + F.pow(F.col("z_time_sec") * 1e-4, F.lit(2.0))) * jitter).alias("accumulated_sigma"))


def drift_points(s, d):
    """Distance of each second's mean position from the session's centre line, as calibration checks."""
    g = gaze(s, d).groupBy("session_id", F.floor("time_sec").cast("long").alias("sec")).agg(F.avg("gaze_x").alias("x"), F.avg("gaze_y").alias("y"))
    return g.select("session_id", F.col("sec").cast("double").alias("calibration_time_sec"), norm2(F.col("x") - 0.5, F.col("y") - 0.5).alias("total_drift"))


PROBES = f"""
 pr0 as (select tr.*, p.probe, 6e0 * p.probe / 99e0 - 3 as u from tr cross join (select unnest(range(100)) as probe) p),
 pr as (select *, {phi('(-u)')} as pb, abs(u) <= 1 as amb, transition_time + u * 0.02::double as probe_sec from pr0)"""
RI = """
 ri0 as (select *, case when count(*) over w5 = 5 then avg(gaze_x) over w5 end as sx, case when count(*) over w5 = 5 then avg(gaze_y) over w5 end as sy from g
  window w5 as (partition by session_id order by time_sec, gaze_id rows between 2 preceding and 2 following)),
 ri1 as (select *, sqrt(((lead(sx) over w - lag(sx) over w) / nullif(lead(time_sec) over w - lag(time_sec) over w, 0)) ** 2 + ((lead(sy) over w - lag(sy) over w) / nullif(lead(time_sec) over w - lag(time_sec) over w, 0)) ** 2) as v,
  sqrt((gaze_x - sx) ** 2 + (gaze_y - sy) ** 2) as r, gaze_x - sx as xr from ri0 window w as (partition by session_id order by time_sec, gaze_id)),
 ri2 as (select *, log10(v) as lv, log10(r + 1e-10) as lr from ri1 where v > 0 and r is not null),
 ri3 as (select session_id, regr_slope(lr, lv) as sl, regr_intercept(lr, lv) as ic from ri2 where r > 0 group by 1),
 ri4 as (select *, case when count(*) over w = 250 then avg(gaze_x) over w end as slow, avg(gaze_x) over (partition by session_id) as mx from ri2 window w as (partition by session_id order by time_sec, gaze_id rows between 124 preceding and 125 following)),
 ri5 as (select session_id, coalesce(xr / nullif(r, 0), 0) * pow(10e0, ic + sl * lv) as vel, slow - mx as dr, xr from ri4 join ri3 using (session_id) where slow is not null),
 ri6 as (select session_id, count(*) as n, {a} as a, {b} as b, {c} as c from (select *, xr - vel as tk from ri5) group by 1),
 ri7 as (select session_id, coalesce(n, 0) as n, a, b, c, case when n_gaze < 500 then 'insufficient data' when coalesce(n, 0) < 100 then 'insufficient valid samples' else 'ok' end as st from sp0 left join ri6 using (session_id)),
 ri as (select session_id, n, st, case when st = 'ok' then a end as a, case when st = 'ok' then b end as b, case when st = 'ok' then c end as c from ri7)""".format(a=corr("vel", "dr"), b=corr("vel", "tk"), c=corr("dr", "tk"))


def a24(s, d):
    """Cross-session summary of three checks, one row each."""
    p2 = uncertainty.independence(kinematics.jitter_and_drift(moving(s, d)), SCREEN)
    p3 = uncertainty.clock_drift(gaze(s, d))
    p4 = uncertainty.slice_assignment(on_screen(s, d), events(s, d), SCREEN)
    parts = {
        "independence": studies.case_summary(p2, "max_correlation", F.col("pass")),
        "clock": studies.case_summary(p3, "total_ms", F.abs("total_ms") < 1, worst=F.abs("total_ms")),
        "assignment": studies.case_summary(p4, "pct_ambiguous", F.col("pct_ambiguous") < 50),
    }
    out = None
    for name, part in parts.items():
        part = part.withColumn("check", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


# latency studies ----------------------------------------------------------------------------------------------------

TRC = """
 trc as (select session_id, event_type as scenario, t_us / 1e6 as time, case when event_id % 20 <> 0 then value end as latency_ms from b0),
 dur as (select avg(time_end - time_start) * 1e3 as mean_duration from zi where integration_mode <> 'single_event')"""
TRI = """
 tri as (select event_id as trial_id, (session_id + 1) * 10 as n_events, k % 5 + 1 as snr, case event_id % 3 when 0 then 20 when 1 then 60 else 120 end as fs, value as error, 1 + (event_id * 7 % 50) / 1e1 as prom, (1 + event_id * 3 % 17) / 1e1 as sd, (1 + event_id * 3 % 17) / 1e1 * (1 + event_id * 5 % 7) / 4e0 as sb from b0)"""
LOG = """
 lg as (select event_type as modality, session_id, abs(value / 2) as err, 1000 + event_id % 7 * 100 as n0, 1000 + event_id % 7 * 100 - event_id % 11 * 20 as n1, (1 + event_id % 5) / 1e1 as sec, event_id % 10 / 1e1 as loss, event_id % 13 / 1e3 as se from b0)"""


def durations(s, d):
    z = align.intervals(events(s, d), spans(s, d)).filter("integration_mode <> 'single_event'")
    return z.select(((F.col("time_end") - F.col("time_start")) * 1000.0).alias("duration_ms"))


def f29(s, d):
    t = trials.traces(s, d).filter("latency_ms is not null")
    return rounded(t.select("session_id", "scenario", "latency_ms", *[c.alias(k) for k, c in studies.sync_error(F.col("latency_ms"), F.lit(2000.0)).items()]))


def f30(s, d):
    """Quality of every scenario's mean latency over a grid of losses."""
    t = trials.traces(s, d).groupBy("scenario").agg(F.avg("latency_ms").alias("latency_ms"))
    grid = t.withColumn("loss", F.explode(F.sequence(F.lit(0), F.lit(25)))).withColumn("loss", F.col("loss") * 2 / F.lit(1e3))
    return rounded(grid.select("scenario", "loss", (studies.sync_error(F.col("latency_ms"), F.lit(2000.0))["data_quality_score"] * (1.0 - F.col("loss") * 10)).alias("quality")))


def curve(s, d):
    """Share of latencies of each scenario that stay above a bound: a falling curve over bounds of 10 ms."""
    t = trials.traces(s, d).filter("latency_ms is not null").withColumn("x", F.floor(F.col("latency_ms") / 10).cast("long"))
    n = t.groupBy("scenario", "x").agg(rows().alias("n"))
    w = by(("scenario",), F.desc("x"))
    return n.select("scenario", (F.col("x") * 10.0).alias("x"), (F.sum("n").over(w) / F.sum("n").over(by(("scenario",)))).alias("y"))


CRV = TRC + """,
 cv0 as (select scenario, floor(latency_ms / 10)::bigint as b, count(*) as n from trc where latency_ms is not null group by 1, 2),
 cv1 as (select scenario, b * 10e0 as x, (sum(n) over (partition by scenario order by b desc) / (sum(n) over (partition by scenario))::double) as y from cv0),
 cv as (select *, lead(x) over w as nx, lead(y) over w as ny from cv1 window w as (partition by scenario order by x))"""


def a46(s, d):
    p = trials.process_log(s, d)
    err = F.abs(F.col("estimated_latency_ms") - F.col("true_latency_ms"))
    stats = {
        "mean_error": F.avg(err), "sd_error": F.stddev_samp(err), "pct_accurate": 100.0 * F.avg((err < 50).cast("double")), "assignment_rate": F.avg(F.col("n_gaze_matched") / F.col("n_gaze_original")),
        "ms_per_1000": F.avg(F.col("processing_time_sec") * 1000.0 / (F.col("n_gaze_original") / 1000.0)), "points_per_sec": F.avg(F.col("n_gaze_original") / F.col("processing_time_sec")), "spatial_error": F.avg("spatial_error"),
    }
    return rounded(p.groupBy("modality").agg(*[c.alias(k) for k, c in stats.items()]), 2)


def a66(s, d):
    p = trials.process_log(s, d)
    err, match = F.abs(F.col("estimated_latency_ms") - F.col("true_latency_ms")), F.col("n_gaze_matched") / F.col("n_gaze_original")
    return rounded(p.groupBy("modality").agg(F.avg(match).alias("match_mean"), F.stddev_samp(match).alias("match_sd"), F.min(F.when(match >= 0.95, F.col("n_gaze_original"))).alias("least_rate"), F.max(F.when(err < 50, F.col("loss"))).alias("most_loss"), F.avg("loss").alias("mean_loss")))


# round trips and positions ------------------------------------------------------------------------------------------


def plane_latency(s, d):
    """Durations, latency and share of the session's samples of every session and plane."""
    i = integrated(s, d).groupBy("session_id", "plane").agg(rows().alias("n"), (F.max("time_sec") - F.min("time_sec")).alias("gaze_duration"), (F.max("z_time_sec") - F.min("z_time_sec")).alias("z_duration"))
    n = gaze(s, d).groupBy("session_id").agg(rows().alias("n_gaze"))
    return i.join(n, "session_id").select("session_id", "plane", "n", "gaze_duration", "z_duration", (F.col("z_duration") - F.col("gaze_duration")).alias("latency"), (F.col("n") / F.col("n_gaze")).alias("match_rate"))


PLANES = """
 pl0 as (select session_id, plane, count(*) as n, max(time_sec) - min(time_sec) as gd, max(z_time_sec) - min(z_time_sec) as zd from i group by 1, 2),
 pl as (select pl0.*, zd - gd as latency, n / n_gaze as match_rate from pl0 join sp0 using (session_id))"""


def a58(s, d):
    """The regression of log error on counts, signal, their product and rate, with confidence limits."""
    return rounded(studies.linear_model(studies.trial_columns(trials.trials(s, d)), ("log_n", "log_snr", "log_n_snr", "log_fs"), "log_error"), 4)


def ols_sql(features: dict[str, str], y: str) -> tuple[str, str]:
    """CTEs and final source of an ordinary least-squares fit. Each term in turn comes last in a chain that takes every
    other term out of all columns; its estimate is then a quotient of two sums, and what is left of y gives the error."""
    names = list(features)
    ctes = [("ols", f"select {y} as y, {', '.join(f'{e} as {n}' for n, e in features.items())} from tri")]
    ends = []
    for k, last in enumerate(names):
        before, order = "ols", [n for n in names if n != last]
        for i, out in enumerate(order):
            rest = ["y", *order[i + 1 :], last]
            taken = ", ".join(f"{c} - sum({c} * {out}) over () / sum({out} * {out}) over () * {out} as {c}" for c in rest)
            ctes.append((f"o{k}_{i}", f"select {taken} from {before}"))
            before = f"o{k}_{i}"
        ends.append(f"select '{last}' as term, sum(y * {last}) / sum({last} * {last}) as estimate, sum({last} * {last}) as own, sum(y * y) - sum(y * {last}) ** 2 / sum({last} * {last}) as rss, count(*) - {len(names)}e0 as df from {before}")
    z = 1.959963984540054
    reach = f"({z!r}::double + {(z**3 + z) / 4!r}::double / df + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r}::double / (df * df))"
    ctes.append(("fit", f"select *, sqrt(rss / df / own) as std_error, {reach} as reach from ({' union all '.join(ends)})"))
    return ", ".join(f"{n} as materialized ({q})" for n, q in ctes), "from fit"


OLS = ols_sql({"log_n": "ln(n_events)", "log_snr": "ln(snr + 1)", "log_n_snr": "ln(n_events * snr + 1)", "log_fs": "ln(fs)", "intercept": "1e0"}, "ln(error + 1)")


def a59(s, d):
    """Slope of log bootstrap sigma on log sigma by rate, R squared, and whether the slope lies within 0.8 and 1.2."""
    x, y = F.log("sigma_delta"), F.log("sigma_delta_boot")
    out = trials.trials(s, d).groupBy("sampling_freq").agg(rows().alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), safe_r2(y, x).alias("r_squared"))
    return rounded(out.withColumn("in_range", F.col("slope").between(0.8, 1.2)))


#: Features of the success model in units that keep its estimates readable: tens of events, signal to noise, 100 Hz.
FEATURES = {"n": "n_events / 10e0", "s": "snr * 1e0", "f": "fs / 100e0"}
#: Where the model is asked: three events at twenty times the noise, at two rates (Hz).
ASKED = ((3, 20, 120), (3, 20, 240))


def success_trials(s, d):
    t = studies.trial_columns(trials.trials(s, d))
    return t.withColumns({"n": F.col("n_events") / 10.0, "s": F.col("snr") * 1.0, "f": F.col("sampling_freq") / 100.0})


def success(s, d):
    return studies.logistic_model(success_trials(s, d), tuple(FEATURES), "success")


def a60_grid(s, d):
    """Chance of success where it is asked, with limits, and whether it exceeds 0.9."""
    grid = s.createDataFrame(list(ASKED), "n_events int, snr int, sampling_freq int")
    out = success(s, d).predicted(grid.withColumns({"n": F.col("n_events") / 10.0, "s": F.col("snr") * 1.0, "f": F.col("sampling_freq") / 100.0}))
    return rounded(out.select("n_events", "snr", "sampling_freq", "probability", "probability_low", "probability_high", (F.col("probability") > 0.9).alias("likely")), 4)


def logistic_sql(rounds: int = 9) -> str:
    """CTEs of the success model, by Newton's method on the plain features; the last are `beta` (b0, ...), `errors` (v0, ...
    variances of the estimates) and `asked` (a row for each asked point, with its variance)."""
    names = list(FEATURES)
    terms = [()] + [(a,) for a in names] + [("n", "s"), ("n", "f"), ("s", "f"), ("n", "s", "f")]
    k, product_ = len(terms), lambda t: " * ".join(t) or "1e0"
    ctes = [("lt0", "select " + ", ".join(f"{e} as {c}" for c, e in FEATURES.items()) + ", count(*)::double as m, count(*) filter (where error < 50)::double as hits from tri group by 1, 2, 3")]
    ctes.append(("lt", "select m, hits, " + ", ".join(f"{product_(t)} as t{i}" for i, t in enumerate(terms)) + " from lt0"))
    ctes.append(("beta0", "select " + ", ".join(f"0e0 as b{i}" for i in range(k))))
    at = " + ".join(f"b{i} * t{i}" for i in range(k))

    def solved(name: str, source: str, sides: list[str]) -> None:
        """Adds `name`: x{side}_{i}, the solutions of the symmetric equations in a{i}_{j} (i <= j) and r{side}_{i}."""
        for p in range(k - 1):
            cols = [f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p} as a{i}_{j}" if i > p else f"a{i}_{j}" for i in range(k) for j in range(i, k)]
            cols += [f"r{q}_{i} - a{p}_{i} * r{q}_{p} / a{p}_{p} as r{q}_{i}" if i > p else f"r{q}_{i}" for q in sides for i in range(k)]
            ctes.append((f"{name}_{p}", f"select {', '.join(cols)} from {source}"))
            source = f"{name}_{p}"
        for i in reversed(range(k)):
            rest = "".join(f" - a{i}_{j} * x{{q}}_{j}" for j in range(i + 1, k))
            ctes.append((f"{name}s{i}", f"select *, {', '.join(f'(r{q}_{i}{rest.format(q=q)}) / a{i}_{i} as x{q}_{i}' for q in sides)} from {source}"))
            source = f"{name}s{i}"
        ctes.append((name, f"select * from {source}"))

    sums = ", ".join(f"sum(t{i} * t{j} * w) as a{i}_{j}" for i in range(k) for j in range(i, k))
    weighted = lambda r: f"(select *, m * p * (1 - p) as w, hits - m * p as off from (select lt.*, 1 / (1 + exp(-({at}))) as p from lt, beta{r}))"
    for r in range(rounds):
        ctes.append((f"lh{r}", f"select {sums}, {', '.join(f'sum(t{i} * off) as r0_{i}' for i in range(k))} from {weighted(r)}"))
        solved(f"ls{r}", f"lh{r}", ["0"])
        ctes.append((f"beta{r + 1}", f"select {', '.join(f'b{i} + x0_{i} as b{i}' for i in range(k))} from beta{r}, ls{r}"))
    ctes.append(("beta", f"select * from beta{rounds}"))
    points = [[math.prod(dict(zip(names, (a / 10, b, c / 100)))[v] for v in t) for t in terms] for a, b, c in ASKED]
    sides = [[float(i == j) for i in range(k)] for j in range(k)] + points
    fixed_ = ", ".join(f"{float(v)!r}::double as r{q}_{i}" for q, side in enumerate(sides) for i, v in enumerate(side))
    ctes.append(("hz", f"select {sums}, {fixed_} from {weighted(rounds)}"))
    solved("nz", "hz", [str(q) for q in range(len(sides))])
    ctes.append(("errors", f"select {', '.join(f'x{i}_{i} as v{i}' for i in range(k))} from nz"))
    ctes.append(("asked", " union all ".join(f"select {a}::int as n_events, {b}::int as snr, {c}::int as sampling_freq, {' + '.join(f'{v!r}::double * b{i}' for i, v in enumerate(x))} as eta, {' + '.join(f'{v!r}::double * x{k + q}_{i}' for i, v in enumerate(x))} as var from beta, nz" for q, ((a, b, c), x) in enumerate(zip(ASKED, points)))))
    ctes.append(("model", " union all ".join(f"select '{':'.join(t) or 'intercept'}' as term, b{i} as estimate, sqrt(v{i}) as std_error from beta, errors" for i, t in enumerate(terms))))
    own = [f"{product_(t)}" for t in terms]
    ctes.append(("each", f"select trial_id, 1 / (1 + exp(-({' + '.join(f'b{i} * {e}' for i, e in enumerate(own))}))) as probability from (select trial_id, {', '.join(f'{e} as {c}' for c, e in FEATURES.items())} from tri), beta"))
    return ", ".join(f"{n} as materialized ({q})" for n, q in ctes)


SUCCESS = logistic_sql()


def a8(s, d):
    x, y = geometry.canvas(F.col("gaze_x"), F.col("gaze_y"))
    i = on_screen(s, d)
    hit = heatmap.slice_hits(i, DIMS).join(heatmap.viewed_slices(i, DIMS).select("plane", "slice_num").distinct(), ["plane", "slice_num"], "left_semi")
    ok = x.between(0, 1) & y.between(0, 1)
    return rounded(hit.groupBy("plane", "slice_num").agg(rows().alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), (100.0 * F.count_if(ok) / rows()).alias("percent_valid")))


def hits(where: str = "true", keys: str = "session_id") -> str:
    return f"""
 sv as (select distinct session_id, plane, round_even(slice_index * case plane when 'AXIAL' then 24 else 15 end, 0)::int + 1 as slice_num from i),
 sh as (select i.*, sv.slice_num, case i.plane when 'SAGITTAL' then 16 else 16 end as nx, case i.plane when 'AXIAL' then 16 else 25 end as ny
  from i join (select distinct {keys}, plane, slice_num from sv) sv on {'i.session_id = sv.session_id and ' if keys == 'session_id' else ''}i.plane = sv.plane and abs(i.slice_index - (sv.slice_num - 1) / case i.plane when 'AXIAL' then 24e0 else 15e0 end) < 0.02::double where {where})"""


HEAT = hits("within_bounds") + """,
 hw0 as (select *, coalesce(time_sec - lag(time_sec) over w, 0) as hdt, coalesce(gaze_x - lag(gaze_x) over w, 0) as hdx, coalesce(gaze_y - lag(gaze_y) over w, 0) as hdy from sh window w as (partition by session_id, plane, slice_num order by time_sec, gaze_id)),
 hw1 as (select *, sqrt(hdx * hdx + hdy * hdy) / greatest(hdt, 0.000001::double) as hv from hw0),
 hw2 as (select *, hv < 0.5 as hs from hw1),
 hw3 as (select *, (hs and not lag(hs, 1, false) over w)::int as hr from hw2 window w as (partition by session_id, plane, slice_num order by time_sec, gaze_id)),
 hw4 as (select *, case when hs then sum(hr) over (partition by session_id, plane, slice_num order by time_sec, gaze_id rows unbounded preceding) end as hi from hw3),
 hw5 as (select *, max(time_sec) over w - min(time_sec) over w as hspan from hw4 window w as (partition by session_id, plane, slice_num, hi)),
 hw6 as (select *, case when hs and hspan >= 0.05::double then hspan else 0 end as du from hw5),
 hw7 as (select *, (case when avg(du) over w > 0.000001 then du / avg(du) over w else du end) / (1 + hv / 0.05::double) as raw from hw6 window w as (partition by session_id, plane, slice_num)),
 hw as (select *, case when sum(raw) over w > 0 then raw * count(*) over w / sum(raw) over w else raw end as wt from hw7 window w as (partition by session_id, plane, slice_num)),
 hc as (select session_id, plane, slice_num, gx.v as gx, gy.v as gy, sum(wt * exp(-0.5::double * ((gaze_x * (nx - 1) - gx.v) / 2e0) ** 2) / (2e0 * 2.5066282746310002::double) * exp(-0.5::double * ((gaze_y * (ny - 1) - gy.v) / 2e0) ** 2) / (2e0 * 2.5066282746310002::double)) / sum(wt) as att
  from hw, (select unnest(range(16)) as v) gx, (select unnest(range(25)) as v) gy where wt > 0 and gx.v < nx and gy.v < ny group by 1, 2, 3, 4, 5),
 hn as (select *, att / max(att) over (partition by session_id, plane, slice_num) as att_n, att / max(att) over (partition by session_id, plane) as att_v from hc)"""


def a34(s, d):
    """Unweighted density of every session on a 12 x 12 grid of the screen, with the reference bandwidth."""
    g = gaze(s, d)
    one = {"weight": F.lit(1.0), "nx": F.lit(12), "ny": F.lit(12), "x0": F.lit(0.0), "x1": F.lit(1.0), "y0": F.lit(0.0), "y1": F.lit(1.0)}
    df = g.join(heatmap.reference_bandwidth(g, ("session_id",), "gaze_x", "gaze_y"), "session_id").withColumns(one)
    return rounded(heatmap.grid_density(df, ("session_id",), ("gaze_x", "gaze_y", "weight", "hx", "hy", "nx", "ny", "x0", "x1", "y0", "y1")))


def a37(s, d):
    """Spatial variance over twenty equal windows of each session's time."""
    v = located(s, d)
    v = with_stats(v, ("session_id",), low=F.min("time_sec"), high=F.max("time_sec"))
    df = v.withColumn("window", equal_bin(F.col("time_sec"), F.col("low"), F.col("high"), 20))
    return rounded(df.groupBy("session_id", "window").agg(rows().alias("n"), (F.var_samp("mm_x") + F.var_samp("mm_y") + F.var_samp("mm_z")).alias("variance")))


def f24(s, d):
    """Nine points around the volume's centre on every slice that a session opened: where on the screen are they?"""
    centre = geometry.transform(VOLUME.matrix(), *[F.lit((n - 1) / 2) for n in DIMS])
    offsets = [(0, 0, 0), (20, 0, 0), (-20, 0, 0), (-20, 0, 0), (20, 0, 0), (0, 20, 0), (0, -20, 0), (40, 40, 30), (-40, -40, -30)]  # fixed values, mm
    targets = F.array(*[F.struct(F.lit(i + 1).alias("target_id"), *[(c + float(o)).alias(f"w{a}") for c, o, a in zip(centre, off, "xyz")]) for i, off in enumerate(offsets)])
    df = heatmap.viewed_slices(integrated(s, d), DIMS).select("*", F.inline(targets))
    voxel = geometry.transform(VOLUME.inverse(), *[F.col(f"w{a}") for a in "xyz"])
    df = df.withColumns(dict(zip(("vi", "vj", "vk"), voxel)))
    inside, on = F.lit(True), F.lit(False)
    x = y = F.lit(None).cast("double")
    for c, n in zip(("vi", "vj", "vk"), DIMS):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    for plane, (a, b, k) in geometry.AXES.items():
        names, hit = ("vi", "vj", "vk"), F.col("plane") == plane
        on = on | (hit & (F.abs(F.col(names[k]) - (F.col("slice_num") - 1)) <= 0.5))
        x, y = F.when(hit, F.col(names[a]) / (DIMS[a] - 1.0)).otherwise(x), F.when(hit, F.col(names[b]) / (DIMS[b] - 1.0)).otherwise(y)
    return rounded(df.withColumn("valid", inside & on).filter("valid").select("session_id", "plane", "slice_num", "target_id", x.alias("screen_x"), y.alias("screen_y")))


def j4(s, d):
    """Half a session's length of latency leaves some sessions without any match; they fall back to counted events."""
    out = align.align(gaze(s, d), events(s, d), latency=1000.0, fallback=True)
    return rounded(out.select("session_id", "gaze_id", "z_event_id", "integration_mode"))


def j10(s, d):
    g = gaze(s, d)
    i = on_screen(s, d).select("session_id", F.col("gaze_id").alias("other_id"), F.col("time_sec").alias("other_sec"), F.col("gaze_x").alias("ox"), F.col("gaze_y").alias("oy"))
    m = studies.nearest_in_time(g.filter("gaze_id % 10 = 1").select("session_id", "gaze_id", "time_sec", "gaze_x", "gaze_y"), i, "time_sec", "other_sec", "other_id", ("ox", "oy"))
    return m.select("session_id", "gaze_id", norm2(F.col("gaze_x") - F.col("match.ox"), F.col("gaze_y") - F.col("match.oy")).alias("error"))


def j11(s, d):
    z = align.intervals(events(s, d), spans(s, d)).filter("integration_mode <> 'single_event' and plane = 'AXIAL'")
    z = z.select("session_id", F.col("time_start").alias("start"), F.col("time_end").alias("end"), F.col("z_event_id").alias("event_id"))
    return studies.event_signal(gaze(s, d).select("session_id", "gaze_id", "time_sec"), z).groupBy("session_id").agg(rows().alias("n"), F.sum("signal").alias("n_inside"))


def s6(s, d):
    """Voxels of the axial slices that were opened (a session each), with the slice's sum and range."""
    v = recordings.voxels(s, DIMS).withColumn("slice_num", (F.col("k") + 1).cast("int"))
    seen = heatmap.viewed_slices(integrated(s, d).filter("plane = 'AXIAL'"), DIMS).select("slice_num").distinct()
    return rounded(v.join(seen, "slice_num", "left_semi").groupBy("slice_num").agg(rows().alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")))


def f38(s, d):
    """Voxel sizes as text for every event, their anisotropy and the kind of orientation."""
    b = recordings.clicks(s, d)
    text = F.concat_ws("x", F.lit("2"), (F.col("k") % 3 + 1).cast("string"), (F.col("k") % 5 + 2).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("RAS", "LPS", "LAS", "RPI", "ASL"))), (F.col("event_id") % 5 + 1).cast("int"))
    df = b.select(geometry.anisotropy(text).alias("max_anisotropy"), geometry.orientation_class(kind, F.col("event_id") % 7 == 0).alias("orientation_type"), "value")
    return rounded(df.groupBy("max_anisotropy", "orientation_type").agg(rows().alias("n"), F.avg("value").alias("mean_error")))


def f6(s, d):
    out = align.within_image(gaze(s, d), **geometry.letterbox(16 / 9, 1.0))
    return rounded(out.select("session_id", "gaze_id", "gaze_x_adjusted", "gaze_y_adjusted", "within_bounds"))


def a51(s, d):
    """Mean position of each session's samples on each atlas region, and the plane of the first of them."""
    v = valued(s, d).filter("region_id > 0")
    return rounded(v.groupBy("session_id", F.col("region_id").cast("long").alias("region_id")).agg(rows().alias("n"), F.avg("gaze_x").alias("mean_x"), F.avg("gaze_y").alias("mean_y"), F.min_by("plane", F.struct("time_sec", "gaze_id")).alias("plane")))


def a60(s, d):
    """Chance of success of every trial by its events, signal and rate."""
    return rounded(success(s, d).predicted(success_trials(s, d)).select("trial_id", "probability"), 4)


NEAREST = "case when (select count(*) from i where i.session_id = g.session_id and i.time_sec = g.time_sec) > 0 then (select sqrt((g.gaze_x - i.gaze_x) ** 2 + (g.gaze_y - i.gaze_y) ** 2) from i where i.session_id = g.session_id and i.time_sec = g.time_sec order by i.gaze_id desc limit 1) else (select sqrt((g.gaze_x - i.gaze_x) ** 2 + (g.gaze_y - i.gaze_y) ** 2) from i where i.session_id = g.session_id and abs(i.time_sec - g.time_sec) <= 0.001::double order by abs(i.time_sec - g.time_sec), i.time_sec, i.gaze_id limit 1) end"
BOOT = """,
 so as (select *, row_number() over (partition by session_id order by idx) as at, count(*) over (partition by session_id) as size from ss),
 dr as (select so.session_id, rep, so.idx, so.event, ('0x' || substr(md5(so.session_id || '-' || rep || '-' || so.idx), 1, 8))::bigint % size + 1 as at from so, (select unnest(range(1, 101)) as rep)),
 dn as (select dr.session_id, rep, dr.idx, dr.event, so.gaze from dr join so on dr.session_id = so.session_id and dr.at = so.at),
 bc as (select a.session_id, a.rep, lag, case when stddev_samp(a.gaze) > 1e-6 and stddev_samp(b.event) > 1e-6 then covar_samp(a.gaze, b.event) / (stddev_samp(a.gaze) * stddev_samp(b.event)) end as r
  from dn a cross join (select unnest(range(-10, 11)) as lag) l join ss b on a.session_id = b.session_id and b.idx = a.idx + lag group by 1, 2, 3)"""
QUERIES = {
    "f40_induced_error": (lambda s, d: rounded(induced(s, d).select("session_id", "gaze_id", "v_normalized", "induced_error_x", "induced_error_y", "induced_error_magnitude")), rsql("session_id; gaze_id; ~vn as v_normalized; ~iex as induced_error_x; ~iey as induced_error_y; ~mag as induced_error_magnitude", "from ie", IND.lstrip())),
    "a70_bin_means": (lambda s, d: rounded(studies.bin_means(induced(s, d).filter("v_normalized > 0.01"), "v_normalized", "induced_error_magnitude")), rsql("session_id; bin; n; ~x as value_mean; ~y as error_mean; ~sd as error_sd; ~sd / sqrt(n) as error_se", "from bs", IND.lstrip())),
    "a25_coupling_validation": (lambda s, d: rounded(studies.coupling_validation(induced(s, d))), rsql("session_id; ns as n_samples; coalesce(nb, 0) as n_bins; ok as valid; ~sl as observed_slope; ~ex as expected_slope; ~sl / ex as slope_ratio; ~case when ok then sxy * sxy / nullif(sxx * syy, 0) end as r_squared; ~case when ok then co end as correlation; coalesce(abs(sl - ex) / ex < 0.5, false) as slope_within_tolerance", "from c3", CPL.lstrip())),
    "a26_independence_validation": (
        lambda s, d: rounded(studies.independence_validation(induced(s, d))),
        rsql("session_id; n as n_samples; ~case when n >= 20 then greatest(ix, iy) end as tracker_induced; ~case when n >= 20 then td end as tracker_drift; ~case when n >= 20 then id end as induced_drift; ~case when n >= 20 then greatest(ix, tx, xx) end as max_off_diagonal; coalesce(n >= 20 and greatest(ix, tx, xx) < 0.3, false) as independent", "from iv1",
             IND.lstrip() + ", iv0 as (select *, coalesce(drift_x - lag(drift_x) over (partition by session_id order by time_sec, gaze_id), 0) as stp from ie where abs(iex) > 1e-10 or abs(iey) > 1e-10), iv1 as (select session_id, count(*) as n, " + ", ".join(f"abs({corr(a, b)}) as {k}" for k, a, b in (("ix", "tnx", "iex"), ("iy", "tny", "iey"), ("td", "tnx", "stp"), ("id", "iex", "stp"), ("tx", "tnx", "drift_x"), ("xx", "iex", "drift_x"))) + " from iv0 group by 1)"),
    ),
    "a27_accumulation_validation": (
        lambda s, d: rounded(studies.accumulation_validation(sigma_events(s, d), alpha=1e-4)),
        rsql("session_id; ~r2 as r_squared; ~sqrt(abs(ic)) as sigma_0; ~sqrt(abs(sl)) as alpha; ~mr as mean_residual; coalesce(abs(sqrt(abs(sl)) - 1e-4) / 1e-4 < 0.5, false) as recovered", "from av1",
             "av0 as (select session_id, z_time_sec * z_time_sec as t2, sqrt(1e-6 + (z_time_sec * 1e-4) ** 2) as ex, sqrt(1e-6 + (z_time_sec * 1e-4) ** 2) * (1 + ((z_event_id * 13) % 7 - 3) / 1e2) as sg from z), av1 as (select session_id, regr_slope(sg * sg, t2) as sl, regr_intercept(sg * sg, t2) as ic, case when var_samp(sg * sg) > 0 then regr_r2(sg * sg, t2) end as r2, avg(abs(sg - ex)) as mr from av0 group by 1)"),
    ),
    "f34_boundary_probes": (lambda s, d: rounded(studies.boundary_probes(kinematics.transitions(events(s, d)), n=100).select("session_id", "transition_id", "probe", "time_sec", "offset_sigma_units", "p_slice_before", "is_ambiguous")), rsql("session_id; transition_id; probe::int as probe; ~probe_sec as time_sec; ~u as offset_sigma_units; ~pb as p_slice_before; amb as is_ambiguous", "from pr", PROBES.lstrip())),
    "a28_boundary_validation": (lambda s, d: rounded(studies.boundary_validation(studies.boundary_probes(kinematics.transitions(events(s, d))))), rsql("session_id; ~avg(amb::int) as fraction_ambiguous; ~avg(pb) filter (where abs(u) < 0.1::double) as mean_p_at_boundary; count(distinct transition_id) as n_transitions; count(*) as n_points; abs(avg(pb) filter (where abs(u) < 0.1::double) - 0.5) < 0.1 as calibrated", "from pr group by session_id", PROBES.lstrip())),
    "a29_drift_validation": (
        lambda s, d: rounded(studies.drift_validation(drift_points(s, d)), 3),
        rsql("session_id; " + "; ".join(f"round({e} + 7.071e-7, 3) + 0e0 as {k}" for e, k in (("sl", "rate"), ("sl * 60", "rate_per_min"), ("r2", "r_squared"), ("0.01::double / nullif(sl, 0)", "recalibration_sec"))), "from dv1",
             "dv0 as (select session_id, floor(time_sec) as t, sqrt((avg(gaze_x) - 0.5) ** 2 + (avg(gaze_y) - 0.5) ** 2) as dr from g group by 1, 2), dv1 as (select session_id, regr_slope(dr, t) as sl, case when var_samp(dr) > 0 then regr_r2(dr, t) end as r2 from dv0 group by 1)"),
    ),
    "a17_p2_recorded": (lambda s, d: rounded(studies.recorded_independence(gaze(s, d))), rsql("session_id; n as n_samples; ~a as r_velocity_drift; ~b as r_velocity_tracker; ~c as r_drift_tracker; ~case when a is not null and b is not null and c is not null then greatest(abs(a), abs(b), abs(c)) end as max_abs_r; coalesce(a is not null and b is not null and c is not null and greatest(abs(a), abs(b), abs(c)) < 0.3, false) as pass; st as status", "from ri", RI.lstrip())),
    "u4_correlations_long": (lambda s, d: rounded(studies.pairs_long(studies.recorded_independence(gaze(s, d)))), rsql("session_id; p as pair; ~v as correlation", "from (select session_id, unnest(['Velocity vs Drift', 'Velocity vs Tracker', 'Drift vs Tracker']) as p, unnest([a, b, c]) as v from ri)", RI.lstrip())),
    "a24_case_summary": (
        a24,
        rsql("check_name as \"check\"; n as n_cases; np as n_pass; ~mean; ~sd; ~mn as min; ~mx as max; ~wo as worst", "from (select 'independence' as check_name, count(*) as n, count(*) filter (where t < 0.3) as np, avg(t) as mean, stddev_samp(t) as sd, min(t) as mn, max(t) as mx, max(t) as wo from s2 where t is not null union all select 'clock', count(*), count(*) filter (where abs(t) < 1), avg(t), stddev_samp(t), min(t), max(t), max(abs(t)) from s3 union all select 'assignment', count(*), count(*) filter (where t < 50), avg(t), stddev_samp(t), min(t), max(t), max(t) from s4)",
             JIT.lstrip() + P2 + ", s2 as (select case when a is not null and b is not null and c is not null then greatest(abs(a), abs(b), abs(c)) end as t from p2), s3 as (select arg_max(gap, gaze_id) - arg_min(gap, gaze_id) as t from (select session_id, gaze_id, (system_time_stamp - device_time_stamp) / 1e3 as gap from g) group by session_id), s4 as (select 100e0 * count(*) filter (where d <= 0.06::double) / count(*) as t from (select session_id, (select min(abs(i.time_aligned - t.transition_time)) from tr t where t.session_id = i.session_id) as d from i) group by session_id)"),
    ),
    "f29_sync_error": (f29, rsql("session_id; scenario; ~latency_ms; ~latency_ms + 125 as total_latency_ms; ~least(1, (latency_ms + 125) / 2e3) as misassignment_rate; ~1 - least(1, (latency_ms + 125) / 2e3) as data_quality_score", "from trc where latency_ms is not null", TRC.lstrip())),
    "f30_quality_envelope": (f30, rsql("scenario; ~l * 2 / 1e3 as loss; ~(1 - least(1, (m + 125) / 2e3)) * (1 - l * 2 / 1e3 * 10) as quality", "from (select scenario, avg(latency_ms) as m from trc group by 1), (select unnest(range(26)) as l)", TRC.lstrip())),
    "f31_queue_bounds": (
        lambda s, d: rounded(trials.traces(s, d).groupBy("scenario").agg(F.avg("latency_ms").alias("ms"), (rows() / (F.max("time") - F.min("time"))).alias("rate")).select("scenario", *[c.alias(k) for k, c in studies.queue_bounds(F.col("rate"), F.col("ms")).items()])),
        rsql("scenario; ~rate * ms / 1e3 as utilization; ~case when rate * ms / 1e3 < 1 then 1e3 * (rate * ms / 1e3) / (1e3 / ms * (1 - rate * ms / 1e3)) end as queue_delay_ms; rate * ms / 1e3 < 1 as stable", "from (select scenario, avg(latency_ms) as ms, count(*) / (max(time) - min(time)) as rate from trc group by 1)", TRC.lstrip()),
    ),
    "a63_sync_performance": (lambda s, d: rounded(studies.sync_performance(trials.traces(s, d), durations(s, d), ("scenario", "session_id"))), rsql("scenario; session_id; ~avg(latency_ms) as mean_latency; ~quantile_cont(latency_ms, 0.95) as p95_latency; ~avg((latency_ms is null)::int) as packet_loss; ~coalesce(greatest(0, 1 - avg(latency_ms) / max(mean_duration)), 0) as sync_accuracy", "from trc, dur group by 1, 2", TRC.lstrip())),
    "a64_scenario_summary": (lambda s, d: rounded(studies.interval_summary(trials.traces(s, d).filter("latency_ms is not null"), "latency_ms", ("scenario",))), rsql("scenario; count(*) as n; ~avg(latency_ms) as mean; ~stddev_samp(latency_ms) as sd; ~quantile_cont(latency_ms, 0.025) as low; ~quantile_cont(latency_ms, 0.5) as median; ~quantile_cont(latency_ms, 0.975) as high", "from trc where latency_ms is not null group by 1", TRC.lstrip())),
    "a65_threshold": (lambda s, d: rounded(studies.crossing(curve(s, d), "x", "y", 0.5, ("scenario",))), rsql("scenario; ~max(x) filter (where y >= 0.5) as largest; ~min(x + (y - 0.5) * (nx - x) / (y - ny)) filter (where y >= 0.5 and ny < 0.5) as crossing", "from cv group by 1", CRV.lstrip())),
    "a46_modality_performance": (a46, rsql("modality; " + "; ".join(f"round({e} + 7.071e-6, 2) + 0e0 as {k}" for e, k in (("avg(err)", "mean_error"), ("stddev_samp(err)", "sd_error"), ("100e0 * avg((err < 50)::int)", "pct_accurate"), ("avg(n1 / n0)", "assignment_rate"), ("avg(sec * 1e3 / (n0 / 1e3))", "ms_per_1000"), ("avg(n0 / sec)", "points_per_sec"), ("avg(se)", "spatial_error"))), "from lg group by 1", LOG.lstrip())),
    "a66_stress": (a66, rsql("modality; ~avg(n1 / n0) as match_mean; ~stddev_samp(n1 / n0) as match_sd; min(n0) filter (where n1 / n0 >= 0.95) as least_rate; ~max(loss) filter (where err < 50) as most_loss; ~avg(loss) as mean_loss", "from lg group by 1", LOG.lstrip())),
    "a56_grid_summary": (lambda s, d: rounded(trials.trials(s, d).groupBy("n_events", "snr", "sampling_freq").agg(rows().alias("n"), F.avg("error").alias("mean_error"), (F.stddev_samp("error") / F.sqrt(rows().cast("double"))).alias("se"))), rsql("n_events; snr; fs as sampling_freq; count(*) as n; ~avg(error) as mean_error; ~stddev_samp(error) / sqrt(count(*)) as se", "from tri group by 1, 2, 3", TRI.lstrip())),
    "a57_success_rate": (lambda s, d: rounded(studies.trial_columns(trials.trials(s, d)).filter("n_snr_product > 60").groupBy("snr").agg(rows().alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"))), rsql("snr; count(*) as n; ~avg((error < 50)::int) as success_rate", "from tri where n_events * snr > 60 group by 1", TRI.lstrip())),
    "a58_error_model": (
        a58,
        rsql("term; " + "; ".join(f"round({e} + 7.071e-8, 4) + 0e0 as {k}" for e, k in (("estimate", "estimate"), ("std_error", "std_error"), ("estimate - reach * std_error", "low"), ("estimate + reach * std_error", "high"), ("df", "df"))), OLS[1], TRI.lstrip() + ", " + OLS[0]),
    ),
    "a59_calibration": (
        a59,
        rsql("fs as sampling_freq; count(*) as n; ~regr_slope(ln(sb), ln(sd)) as slope; ~regr_intercept(ln(sb), ln(sd)) as intercept; ~regr_r2(ln(sb), ln(sd)) as r_squared; regr_slope(ln(sb), ln(sd)) between 0.8::double and 1.2::double as in_range", "from tri group by 1", TRI.lstrip()),
    ),
    "a60_success_model": (a60, rsql("trial_id; round(probability + 7.071e-8, 4) + 0e0 as probability", "from each", TRI.lstrip() + ", " + SUCCESS)),
    "a60_success_grid": (
        a60_grid,
        rsql("n_events; snr; sampling_freq; " + "; ".join(f"round(1 / (1 + exp(-(eta{e}))) + 7.071e-8, 4) + 0e0 as probability{k}" for k, e in (("", ""), ("_low", f" - {studies.NORMAL!r}::double * sqrt(var)"), ("_high", f" + {studies.NORMAL!r}::double * sqrt(var)"))) + "; 1 / (1 + exp(-eta)) > 0.9::double as likely", "from asked", TRI.lstrip() + ", " + SUCCESS),
    ),
    "a60_success_terms": (
        lambda s, d: rounded(success(s, d).table(s), 4),
        rsql("term; " + "; ".join(f"round({e} + 7.071e-8, 4) + 0e0 as {k}" for e, k in (("estimate", "estimate"), ("std_error", "std_error"), (f"estimate - {studies.NORMAL!r}::double * std_error", "low"), (f"estimate + {studies.NORMAL!r}::double * std_error", "high"), (f"2 * {phi('(-abs(estimate / std_error))')}", "p"))), "from model", TRI.lstrip() + ", " + SUCCESS),
    ),
    "a55_bootstrap": (
        lambda s, d: rounded(studies.bootstrap_latency(signals(s, d), 100, 10, 10.0)),
        rsql("session_id; count(*) as n; ~stddev_samp(-lag * 100e0) as sd_ms", "from (select session_id, rep, arg_max(lag, (round(abs(r), 12), -lag)) as lag from bc where r is not null group by 1, 2) group by 1", SIG.split(",\n cc as")[0].lstrip() + BOOT),
    ),
    "a8_slice_validity": (a8, rsql("plane; slice_num; count(*) as total; count(*) filter (where ok) as valid; count(*) filter (where not ok) as invalid; ~100e0 * count(*) filter (where ok) / count(*) as percent_valid", "from (select *, (gaze_x * 2624 - 350) / 1924 between 0 and 1 and (gaze_y * 1640 - 80) / 1560 between 0 and 1 as ok from sh) group by 1, 2", hits("true", "0 as one").lstrip())),
    "a32_slice_heatmaps": (lambda s, d: rounded(heatmap.slice_heatmaps(on_screen(s, d), DIMS, 2.0)), rsql("session_id; plane; slice_num; gx::int as gx; gy::int as gy; ~att_n as attention", "from hn", HEAT.lstrip())),
    "a33_volume_heatmap": (
        lambda s, d: rounded(heatmap.volume_heatmap(on_screen(s, d), DIMS, 2.0)),
        rsql("session_id; plane; (case plane when 'SAGITTAL' then slice_num - 1 else gx end)::int as voxel_i; (case plane when 'AXIAL' then gy when 'SAGITTAL' then gx else slice_num - 1 end)::int as voxel_j; (case plane when 'AXIAL' then slice_num - 1 else gy end)::int as voxel_k; ~att_v as attention", "from hn", HEAT.lstrip()),
    ),
    "f42_overlay": (lambda s, d: heatmap.overlay(heatmap.slice_heatmaps(on_screen(s, d), DIMS, 2.0)).groupBy("session_id", "plane", "slice_num").agg(rows().alias("n"), F.count("attention").alias("n_shown")), rsql("session_id; plane; slice_num; count(*) as n; count(*) filter (where att_n >= 0.05) as n_shown", "from hn group by 1, 2, 3", HEAT.lstrip())),
    "s8_attention_export": (
        lambda s, d: rounded(heatmap.attention_export(heatmap.volume_heatmap(on_screen(s, d), DIMS, 2.0), 0.2)).groupBy("session_id", "plane").agg(rows().alias("n"), F.max("attention").alias("top")),
        rsql("session_id; plane; count(*) as n; ~max(att_v) as top", "from hn where att_v > 0.2 group by 1, 2", HEAT.lstrip()),
    ),
    "a34_reference_density": (
        a34,
        rsql("session_id; gx.v::int as gx; gy.v::int as gy; ~sum(exp(-0.5::double * ((gaze_x - gx.v / 11e0) / hx) ** 2) / (hx * 2.5066282746310002::double) * exp(-0.5::double * ((gaze_y - gy.v / 11e0) / hy) ** 2) / (hy * 2.5066282746310002::double)) / count(*) as density", "from g join hb using (session_id), (select unnest(range(12)) as v) gx, (select unnest(range(12)) as v) gy group by 1, 2, 3",
             "hb as (select session_id, 1.06::double * least(stddev_samp(gaze_x), (quantile_cont(gaze_x, 0.75) - quantile_cont(gaze_x, 0.25)) / 1.34::double) * count(*) ** (-0.2::double) as hx, 1.06::double * least(stddev_samp(gaze_y), (quantile_cont(gaze_y, 0.75) - quantile_cont(gaze_y, 0.25)) / 1.34::double) * count(*) ** (-0.2::double) as hy from g group by 1)"),
    ),
    "a37_variance_over_time": (
        a37,
        rsql("session_id; coalesce(greatest(1, least(20, ceil((time_sec - lo) * 20e0 / nullif(hi - lo, 0)))), 1)::int as window; count(*) as n; ~var_samp(mx) + var_samp(my) + var_samp(mz) as variance", "from (select *, min(time_sec) over (partition by session_id) as lo, max(time_sec) over (partition by session_id) as hi from lc) group by 1, 2", LOC.lstrip()),
    ),
    "a39_gaze_volume": (lambda s, d: located(s, d).filter("valid").groupBy("session_id", "voxel_i", "voxel_j", "voxel_k").agg(rows().alias("n")), rsql("session_id; vi as voxel_i; vj as voxel_j; vk as voxel_k; count(*) as n", "from lc where vi between 0 and 15 and vj between 0 and 15 and vk between 0 and 24 group by 1, 2, 3, 4", LOC.lstrip())),
    "a43_plane_latency": (
        lambda s, d: rounded(plane_latency(s, d)),
        rsql("session_id; plane; n; ~gd as gaze_duration; ~zd as z_duration; ~latency; ~match_rate", "from pl", PLANES.lstrip()),
    ),
    "a43_latency_statistics": (
        lambda s, d: rounded(studies.case_summary(plane_latency(s, d), "latency", keys=("plane",)).withColumn("range", F.col("max") - F.col("min")).drop("n_pass", "worst")),
        rsql("plane; count(*) as n_cases; ~avg(latency) as mean; ~stddev_samp(latency) as sd; ~min(latency) as min; ~max(latency) as max; ~max(latency) - min(latency) as range", "from pl group by 1", PLANES.lstrip()),
    ),
    "a52_pattern_summary": (
        lambda s, d: rounded(valued(s, d).groupBy("session_id").agg(rows().alias("n"), (F.max("time_sec") - F.min("time_sec")).alias("duration"), F.count_if("valid").alias("n_valid"), F.count_distinct("region_id").alias("n_regions"))),
        rsql("session_id; count(*) as n; ~max(time_sec) - min(time_sec) as duration; count(*) filter (where vi is not null and vj is not null and vk is not null) as n_valid; count(distinct region_id) as n_regions", "from lv group by 1", LOC.lstrip()),
    ),
    "a69_overlay_statistics": (lambda s, d: rounded(heatmap.slice_hits(integrated(s, d), DIMS).groupBy("plane", "slice_num").agg(rows().alias("n"), (F.max("time_aligned") - F.min("time_aligned")).alias("seconds"), F.avg("gaze_x").alias("mean_x"), F.avg("gaze_y").alias("mean_y"))), rsql("plane; sn::int as slice_num; count(*) as n; ~max(time_aligned) - min(time_aligned) as seconds; ~avg(gaze_x) as mean_x; ~avg(gaze_y) as mean_y", "from i, (select unnest(range(1, 26)) as sn) where case when plane = 'AXIAL' then abs(slice_index - (sn - 1) / 24e0) < 0.02::double else sn <= 16 and abs(slice_index - (sn - 1) / 15e0) < 0.02::double end group by 1, 2")),
    "f24_targets_on_screen": (
        f24,
        rsql("session_id; plane; slice_num; t as target_id; ~case plane when 'SAGITTAL' then y / 15 else x / 15 end as screen_x; ~case plane when 'AXIAL' then y / 15 else z / 24 end as screen_y",
             "from sv, (select t, 7.5 + ox / 2e0 as x, 7.5 + oy / 2e0 as y, 12 + oz / 3e0 as z from (values (1, 0, 0, 0), (2, 20, 0, 0), (3, -20, 0, 0), (4, -20, 0, 0), (5, 20, 0, 0), (6, 0, 20, 0), (7, 0, -20, 0), (8, 40, 40, 30), (9, -40, -40, -30)) v(t, ox, oy, oz)) where x >= 0 and x < 16 and y >= 0 and y < 16 and z >= 0 and z < 25 and abs(case plane when 'AXIAL' then z when 'SAGITTAL' then x else y end - (slice_num - 1)) <= 0.5", hits().lstrip()),
    ),
    "j4_fallback": (
        j4,
        rsql("session_id; gaze_id; z_event_id; integration_mode", "from (select session_id, gaze_id, z_event_id, integration_mode from z1 union all select a.session_id, gaze_id, case when integration_mode = 'single_event' then 1 else n_events end, case when integration_mode = 'single_event' then 'single_event' else integration_mode || '_alt' end from (select * from g where session_id not in (select session_id from z1)) a join spans using (session_id))",
             "z1 as (select g.session_id, gaze_id, zs.z_event_id, 'sparse_coverage' as integration_mode from g join spans using (session_id) join (select session_id, max(z_event_id) as z_event_id from z group by 1) zs using (session_id) where integration_mode = 'sparse_coverage' and time_sec + 1000 < gaze_duration + 1001)"),
    ),
    "j8_positional_join": (
        lambda s, d: rounded(gaze(s, d).join(integrated(s, d).select("session_id", "gaze_id", slice_number("slice_index", "plane", DIMS).alias("slice_num")), ["session_id", "gaze_id"], "full_outer").groupBy("session_id").agg(rows().alias("n"), F.count_if(F.col("slice_num").isNull()).alias("n_unpaired"))),
        rsql("session_id; count(*) as n; count(*) filter (where i.gaze_id is null) as n_unpaired", "from g left join i using (session_id, gaze_id) group by 1"),
    ),
    "j10_nearest_sample": (lambda s, d: rounded(j10(s, d)), rsql(f"session_id; gaze_id; ~{NEAREST} as error", "from g where gaze_id % 10 = 1")),
    "a47_spatial_accuracy": (
        lambda s, d: rounded(studies.error_summary(j10(s, d).filter("error is not null"), "error", ("session_id",), {"pct_below": 0.01}).select("session_id", "n", "mean", "sd", "max", "pct_below")),
        rsql("session_id; count(*) as n; ~avg(error) as mean; ~stddev_samp(error) as sd; ~max(error) as max; ~100e0 * avg((error < 0.01::double)::int) as pct_below", f"from (select session_id, {NEAREST} as error from g where gaze_id % 10 = 1) where error is not null group by 1"),
    ),
    "j11_event_membership": (j11, rsql("session_id; count(*) as n; count(*) filter (where exists (select 1 from zi where zi.session_id = g.session_id and plane = 'AXIAL' and integration_mode <> 'single_event' and time_start < g.time_sec and g.time_sec < time_end)) as n_inside", "from g group by 1")),
    "s6_slice_matrix": (s6, rsql("k::int + 1 as slice_num; count(*) as n; ~sum(value) as total; ~min(value) as low; ~max(value) as high", "from vx where k + 1 in (select slice_num from lc where plane = 'AXIAL') group by 1", LOC.lstrip())),
    "f38_anisotropy": (
        f38,
        rsql("~greatest(2, k % 3 + 1, k % 5 + 2) / least(2, k % 3 + 1, k % 5 + 2) as max_anisotropy; o as orientation_type; count(*) as n; ~avg(value) as mean_error", "from (select *, case when event_id % 7 = 0 then 'Oblique' else ['RAS', 'LPS', 'LAS', 'RPI', 'Other'][event_id % 5 + 1] end as o from b0) group by 1, 2"),
    ),
    "f6_letterbox": (f6, rsql("session_id; gaze_id; ~(gaze_x - 0.21875) / 0.5625 as gaze_x_adjusted; ~gaze_y as gaze_y_adjusted; (gaze_x - 0.21875) / 0.5625 between 0 and 1 and gaze_y between 0 and 1 as within_bounds", "from g")),
    "a51_region_means": (a51, rsql("session_id; region_id::bigint as region_id; count(*) as n; ~avg(gaze_x) as mean_x; ~avg(gaze_y) as mean_y; arg_min(plane, (time_sec, gaze_id)) as plane", "from lv where region_id > 0 group by 1, 2", LOC.lstrip())),
    "f11_valid_samples": (lambda s, d: moving(s, d).filter("velocity_norm > 0").dropna(subset=["gaze_x", "gaze_y"]).groupBy("session_id").agg(rows().alias("n")), rsql("session_id; count(*) as n", "from m where velocity_norm > 0 and gaze_x is not null and gaze_y is not null group by 1")),
    "f13_index_of_slice": (lambda s, d: rounded(events(s, d).select("session_id", "z_event_id", geometry.index_of(slice_number("slice_index", "plane", (128, 128, 128)), 128).alias("index"))), rsql("session_id; z_event_id; ~round_even(slice_index * 127, 0) / 127 as index", "from z")),
    "f27_visual_angle": (lambda s, d: rounded(moving(s, d).select("session_id", "gaze_id", kinematics.visual_angle(F.col("displacement") * 53.0, F.lit(60.0)).alias("degrees"))), rsql("session_id; gaze_id; ~degrees(2 * atan(displacement * 53 / 120)) as degrees", "from m")),
}
