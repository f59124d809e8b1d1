"""Queries on clocks, spans, the interval join and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from oculith.functions.columns import by, rounded, rows
from oculith.operators import align, heatmap, kinematics
from oculith.operators.geometry import slice_number
from oculith.operators.ordered import over, quantiles
from oculith.plans.base import DIMS, events, gaze, integrated, rsql, spans
from oculith.sources import recordings

I_COLS = "session_id; gaze_id; ~time_sec; ~time_aligned; ~gaze_x; ~gaze_y; z_event_id; ~z_time_sec; plane; ~slice_index; image_id; ~time_start; ~time_end; integration_mode; ~coverage_ratio; ~gaze_x_adjusted; ~gaze_y_adjusted; within_bounds"
SLICE = "case plane when 'AXIAL' then round_even(slice_index * 24, 0) when 'SAGITTAL' then round_even(slice_index * 511, 0) when 'CORONAL' then round_even(slice_index * 511, 0) end::int + 1"


def a7(s, d):
    """Per-slice gaze summary of in-bounds samples."""
    i = integrated(s, d).filter("within_bounds").withColumn("slice_num", slice_number("slice_index", "plane", DIMS))
    out = i.groupBy("session_id", "plane", "slice_num").agg(rows().alias("n_gaze"), (F.max("time_aligned") - F.min("time_aligned")).alias("duration"), F.avg("gaze_x_adjusted").alias("mean_x"), F.avg("gaze_y_adjusted").alias("mean_y"), F.stddev_samp("gaze_x_adjusted").alias("sd_x"), F.stddev_samp("gaze_y_adjusted").alias("sd_y"))
    return rounded(out)


def a5(s, d):
    """By session and plane, and over all planes of each session (plane `overall`)."""
    i = integrated(s, d).groupingSets([("session_id", "plane"), ("session_id",)], "session_id", "plane")
    out = i.agg(F.grouping("plane").alias("all_planes"), rows().alias("n"), F.count_if("within_bounds").alias("n_within"), F.bround(100.0 * F.count_if("within_bounds") / rows(), 1).alias("pct_within"))
    return rounded(out.withColumn("plane", F.when(F.col("all_planes") == 1, "overall").otherwise(F.col("plane"))).drop("all_planes"))


def a2(s, d):
    own = spans(s, d)
    return rounded(align.integration_report(own, integrated(s, d)))


def k3(s, d):
    """The ten most viewed slices of all sessions, and those that tie with the tenth."""
    n = integrated(s, d).groupBy("plane", "slice_index").agg(rows().alias("n"))
    tenth = n.orderBy(F.desc("n")).limit(10).agg(F.min("n").alias("least"))
    return rounded(n.crossJoin(F.broadcast(tenth)).filter("n >= least").select("plane", "slice_index", "n"))  # one row


def j9(s, d):
    """Every slice of an axial list against all samples within 0.02 of its index."""
    i = integrated(s, d).filter("plane = 'AXIAL' and within_bounds")
    return heatmap.slice_hits(i, DIMS).groupBy("session_id", "slice_num").agg(rows().alias("n"))


def f5(s, d):
    g = gaze(s, d)
    out = quantiles(g, "gaze_x", (0.02, 0.98), name="x").join(quantiles(g, "gaze_y", (0.02, 0.98), name="y"), "session_id")
    return rounded(out.select("session_id", F.col("x")[0].alias("left"), F.col("x")[1].alias("right"), F.col("y")[0].alias("top"), F.col("y")[1].alias("bottom")))


def near_slices(s, d):
    """How many slices were on screen within a second of each sample: intervals widened by a second overlap."""
    z = align.intervals(events(s, d), spans(s, d)).filter("integration_mode <> 'single_event'")
    z = z.select("session_id", "z_event_id", (F.col("time_start") - 1).alias("low"), (F.col("time_end") + 1).alias("high"))
    return align.held(gaze(s, d).select("session_id", "gaze_id", "time_sec"), z, "time_sec", "low", "high", "z_event_id").select("session_id", "gaze_id", "n", "first", "last")


QUERIES = {
    "j1_overlapping": (near_slices, rsql("session_id; gaze_id; count(*) as n; min(zi.z_event_id) as first; max(zi.z_event_id) as last", "from g join zi using (session_id) where zi.integration_mode <> 'single_event' and time_sec >= time_start - 1 and time_sec < time_end + 1 group by 1, 2")),
    "f1_gaze_clock": (lambda s, d: rounded(gaze(s, d).select("session_id", "src_id", "gaze_id", "time_sec", "gaze_x", "gaze_y")), rsql("session_id; src_id; gaze_id; ~time_sec; ~gaze_x; ~gaze_y", "from g")),
    "f2_event_clock": (lambda s, d: rounded(events(s, d).select("session_id", "z_event_id", "z_time_sec", "plane", "slice_index")), rsql("session_id; z_event_id; ~z_time_sec; plane; ~slice_index", "from z")),
    "a1_session_spans": (lambda s, d: rounded(align.session_spans(gaze(s, d), events(s, d))), rsql("session_id; n_gaze; ~gaze_duration; n_events; ~z_duration; integration_mode; ~coverage_ratio; ~latency", "from spans")),
    "f3_latency_shift": (
        lambda s, d: rounded(gaze(s, d).join(spans(s, d).select("session_id", "latency"), "session_id").select("session_id", "gaze_id", (F.col("time_sec") + F.col("latency")).alias("time_aligned"))),
        rsql("session_id; gaze_id; ~time_aligned", "from ga"),
    ),
    "j3_integration_mode": (lambda s, d: align.session_spans(gaze(s, d), events(s, d)).select("session_id", "integration_mode"), rsql("session_id; integration_mode", "from spans")),
    "j2_intervals": (lambda s, d: rounded(align.intervals(events(s, d), spans(s, d)).select("session_id", "z_event_id", "time_start", "time_end", "integration_mode")), rsql("session_id; z_event_id; ~time_start; ~time_end; integration_mode", "from zi")),
    "w4_event_intervals": (
        lambda s, d: rounded(over(events(s, d), lambda w: {"time_end": F.lead("z_time_sec").over(w)}, after=1, row="z_event_id").select("session_id", "z_event_id", F.col("z_time_sec").alias("time_start"), "time_end")),
        rsql("session_id; z_event_id; ~z_time_sec as time_start; ~lead(z_time_sec) over (partition by session_id order by z_time_sec, z_event_id) as time_end", "from z"),
    ),
    "j1_interval_join_asof": (lambda s, d: rounded(integrated(s, d)), rsql(I_COLS, "from i")),
    "j1_interval_join_range": (lambda s, d: rounded(integrated(s, d, "range")), rsql(I_COLS, "from i")),
    "f4_within_image": (lambda s, d: rounded(integrated(s, d).select("session_id", "gaze_id", "gaze_x_adjusted", "gaze_y_adjusted", "within_bounds")), rsql("session_id; gaze_id; ~gaze_x_adjusted; ~gaze_y_adjusted; within_bounds", "from i")),
    "a2_integration_report": (
        a2,
        rsql(
            "session_id; n_gaze; n_events; ~gaze_duration; ~z_duration; integration_mode; ~coverage_ratio; ~latency; coalesce(k.n, 0) as n_matched; n_gaze - coalesce(k.n, 0) as n_unmatched; ~100e0 * coalesce(k.n, 0) / n_gaze as pct_matched",
            "from spans left join (select session_id, count(*) as n from i group by 1) k using (session_id)",
        ),
    ),
    "a3_gaze_per_event": (lambda s, d: integrated(s, d).groupBy("session_id", "z_event_id").agg(rows().alias("n")), rsql("session_id; z_event_id; count(*) as n", "from i group by all")),
    "a4_plane_coverage": (lambda s, d: rounded(integrated(s, d).groupBy("session_id", "plane").agg(rows().alias("n"), (F.max("time_aligned") - F.min("time_aligned")).alias("span"))), rsql("session_id; plane; count(*) as n; ~max(time_aligned) - min(time_aligned) as span", "from i group by all")),
    "a5_bounds_summary": (a5, rsql("session_id; case when grouping(plane) = 1 then 'overall' else plane end as plane; count(*) as n; count(*) filter (where within_bounds) as n_within; ~round_even(100e0 * count(*) filter (where within_bounds) / count(*), 1) as pct_within", "from i group by grouping sets ((session_id, plane), (session_id))")),
    "a6_observed_bounds": (
        lambda s, d: rounded(integrated(s, d).filter("within_bounds").groupBy("session_id").agg(F.min("gaze_x").alias("left"), F.max("gaze_x").alias("right"), F.min("gaze_y").alias("top"), F.max("gaze_y").alias("bottom"))),
        rsql('session_id; ~min(gaze_x) as "left"; ~max(gaze_x) as "right"; ~min(gaze_y) as top; ~max(gaze_y) as bottom', "from i where within_bounds group by all"),
    ),
    "a7_gaze_by_slice": (
        a7,
        rsql(f"session_id; plane; {SLICE} as slice_num; count(*) as n_gaze; ~max(time_aligned) - min(time_aligned) as duration; ~avg(gaze_x_adjusted) as mean_x; ~avg(gaze_y_adjusted) as mean_y; ~stddev_samp(gaze_x_adjusted) as sd_x; ~stddev_samp(gaze_y_adjusted) as sd_y", "from i where within_bounds group by all"),
    ),
    "f5_image_bounds": (f5, rsql('session_id; ~quantile_cont(gaze_x, 0.02) as "left"; ~quantile_cont(gaze_x, 0.98) as "right"; ~quantile_cont(gaze_y, 0.02) as top; ~quantile_cont(gaze_y, 0.98) as bottom', "from g group by 1")),
    "f8_slice_selector": (
        lambda s, d: rounded(integrated(s, d).filter((F.col("plane") == "AXIAL") & (F.abs(F.col("slice_index") - 11 / 24) < 0.02) & F.col("within_bounds")).select("session_id", "gaze_id", "time_aligned")),
        rsql("session_id; gaze_id; ~time_aligned", "from i where plane = 'AXIAL' and abs(slice_index - 11/24e0) < 0.02 and within_bounds"),
    ),
    "f9_plane_filter": (lambda s, d: integrated(s, d).filter("plane = 'CORONAL'").select("session_id", "gaze_id"), rsql("session_id; gaze_id", "from i where plane = 'CORONAL'")),
    "f10_in_bounds": (lambda s, d: integrated(s, d).filter("within_bounds").select("session_id", "gaze_id"), rsql("session_id; gaze_id", "from i where within_bounds")),
    "f14_slice_number": (lambda s, d: integrated(s, d).select("session_id", "gaze_id", slice_number("slice_index", "plane", DIMS).alias("slice_num")), rsql(f"session_id; gaze_id; {SLICE} as slice_num", "from i")),
    "f37_slice_label": (
        lambda s, d: integrated(s, d).select(F.concat_ws(" ", "plane", F.rint(F.col("slice_index") * 100).cast("int").cast("string")).alias("label")).groupBy("label").agg(rows().alias("n")),
        rsql("plane || ' ' || round_even(slice_index * 100, 0)::int as label; count(*) as n", "from i group by all"),
    ),
    "j9_slice_grid": (j9, rsql("session_id; c.slice_num::int as slice_num; count(*) as n", "from i join (select unnest(range(1, 26)) as slice_num) c on abs(slice_index - (c.slice_num - 1) / 24e0) < 0.02 where plane = 'AXIAL' and within_bounds group by all")),
    "w5_time_gaps": (
        lambda s, d: rounded(kinematics.gaps(integrated(s, d)).select("session_id", "gaze_id", "time_aligned", "gap")),
        rsql("session_id; gaze_id; ~time_aligned; ~gap", "from (select *, coalesce(time_aligned - lag(time_aligned) over (partition by session_id order by time_aligned, gaze_id), 0) as gap from i) where gap > 0.5"),
    ),
    "w6_transitions": (lambda s, d: rounded(kinematics.transitions(events(s, d))), rsql("session_id; ~transition_time; ~slice_before; ~slice_after; transition_id", "from tr")),
    "w14_percent_of_total": (
        lambda s, d: rounded(integrated(s, d).groupBy("session_id", "plane").agg(rows().alias("n")).withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(by(("session_id",))))),
        rsql("session_id; plane; n; ~100e0 * n / sum(n) over (partition by session_id) as pct", "from (select session_id, plane, count(*) as n from i group by all)"),
    ),
    "a41_frames": (
        lambda s, d: rounded(integrated(s, d).withColumn("second", F.floor("time_aligned").cast("long")).groupBy("session_id", "second", "plane", "slice_index").agg(F.avg("gaze_x").alias("mean_x"), F.avg("gaze_y").alias("mean_y"), rows().alias("n"))),
        rsql("session_id; floor(time_aligned)::bigint as second; plane; ~slice_index; ~avg(gaze_x) as mean_x; ~avg(gaze_y) as mean_y; count(*) as n", "from i group by session_id, floor(time_aligned), plane, slice_index"),
    ),
    "a42_plane_duration": (lambda s, d: rounded(integrated(s, d).groupBy("plane").agg((F.max("time_aligned") - F.min("time_aligned")).alias("duration"))), rsql("plane; ~max(time_aligned) - min(time_aligned) as duration", "from i group by 1")),
    "a67_frequency": (lambda s, d: recordings.slice_events(s, d).groupBy("plane").agg(rows().alias("n")), rsql("plane; count(*) as n", "from ev group by 1")),
    "k3_top_slices": (
        k3,
        rsql("plane; ~slice_index; n", "from (select plane, slice_index, count(*) as n, rank() over (order by count(*) desc) as r from i group by 1, 2) where r <= 10"),
    ),
    "k4_first_slices": (
        lambda s, d: rounded(integrated(s, d).groupBy("session_id", "slice_index").agg(F.min("time_aligned").alias("first_seen")).withColumn("rank", F.row_number().over(by(("session_id",), "first_seen", "slice_index"))).filter("rank <= 5")),
        rsql("session_id; ~slice_index; ~first_seen; rank::int as rank", "from (select *, row_number() over (partition by session_id order by first_seen, slice_index) as rank from (select session_id, slice_index, min(time_aligned) as first_seen from i group by 1, 2)) where rank <= 5"),
    ),
    "k6_argmax_slice": (
        lambda s, d: rounded(integrated(s, d).groupBy("session_id", "plane", "slice_index").agg(rows().alias("n")).groupBy("session_id").agg(F.max_by(F.struct("plane", "slice_index"), F.struct("n", "plane", "slice_index")).alias("b"), F.max("n").alias("n")).select("session_id", "b.plane", "b.slice_index", "n")),
        rsql("session_id; plane; ~slice_index; n", "from (select session_id, plane, slice_index, count(*) as n from i group by all) qualify row_number() over (partition by session_id order by n desc, plane desc, slice_index desc) = 1"),
    ),
    "s4_session_events": (
        lambda s, d: recordings.slice_events(s, d).join(recordings.gaze(s, d).filter("gaze_point_on_display_area_x > 0.8").select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(rows().alias("n")),
        rsql("session_id; count(*) as n", "from ev where session_id in (select session_id from gaze where x > 0.8) group by 1"),
    ),
    "u1_union_by_name": (
        lambda s, d: recordings.gaze(s, d).select("session_id", "src_id").unionByName(recordings.slice_events(s, d).select("session_id", "src_id", "plane"), allowMissingColumns=True).groupBy("session_id", "plane").agg(rows().alias("n")),
        rsql("session_id; plane; count(*) as n", "from (select session_id, null as plane from gaze union all select session_id, plane from ev) group by all"),
    ),
}
