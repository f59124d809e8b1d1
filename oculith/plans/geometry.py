"""Queries on coordinates, voxels, densities and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from oculith.functions.columns import norm2, rounded, rows
from oculith.operators import bricks, geometry, heatmap, kinematics, latency, studies
from oculith.operators.geometry import Volume, slice_number
from oculith.plans.base import events, gaze, integrated, rsql, shared
from oculith.sources import recordings

#: The volume of the queries: the test volume's size, anisotropic, shifted.
VOLUME = Volume((16, 16, 25), (2.0, 2.0, 3.0), ((2.0, 0.0, 0.0, -16.0), (0.0, 2.0, 0.0, -16.0), (0.0, 0.0, 3.0, -36.0), (0.0, 0.0, 0.0, 1.0)))
CLAMP = "least(greatest({c}, 0), 1)"
X, Y = CLAMP.format(c="gaze_x"), CLAMP.format(c="gaze_y")
LOC = f"""
 lc0 as (select *, case plane when 'AXIAL' then round_even(slice_index * 24, 0) when 'SAGITTAL' then round_even(slice_index * 15, 0) when 'CORONAL' then round_even(slice_index * 15, 0) end::int + 1 as slice_num from i),
 lc1 as (select *, case plane when 'AXIAL' then round_even({X} * 15, 0) when 'SAGITTAL' then slice_num - 1 when 'CORONAL' then round_even({X} * 15, 0) end::int as vi,
  case plane when 'AXIAL' then round_even({Y} * 15, 0) when 'SAGITTAL' then round_even({X} * 15, 0) when 'CORONAL' then slice_num - 1 end::int as vj,
  case plane when 'AXIAL' then slice_num - 1 when 'SAGITTAL' then round_even({Y} * 24, 0) when 'CORONAL' then round_even({Y} * 24, 0) end::int as vk,
  case plane when 'AXIAL' then {X} when 'SAGITTAL' then (slice_num - 1) / 15e0 when 'CORONAL' then {X} end as fi,
  case plane when 'AXIAL' then {Y} when 'SAGITTAL' then {X} when 'CORONAL' then (slice_num - 1) / 15e0 end as fj,
  case plane when 'AXIAL' then (slice_num - 1) / 24e0 when 'SAGITTAL' then {Y} when 'CORONAL' then {Y} end as fk from lc0),
 lc as (select *, 2 * (16 * fi - 0.5::double) - 16 as mx, 2 * (16 * fj - 0.5::double) - 16 as my, 3 * (25 * fk - 0.5::double) - 36 as mz from lc1),
 vx as (select id % 16 as i, (id // 16) % 16 as j, id // 256 as k, (((id % 16) * 7 + ((id // 16) % 16) * 13 + (id // 256) * 29) % 256)::double as value,
  case when id // 256 < 3 then 0 else 1 + ((id % 16) // 8) + 2 * (((id // 16) % 16) // 8) end as region_id from (select unnest(range(6400)) as id)),
 lv as (select lc.*, value, region_id from lc left join vx on vi = vx.i and vj = vx.j and vk = vx.k)"""


def located(s, d):
    i = integrated(s, d).withColumn("slice_num", slice_number("slice_index", "plane", VOLUME.dims))
    return geometry.located(i, VOLUME)


def voxel_bricks(s, d):
    """The test volume in bricks."""
    return shared(s, d, "bricks", lambda: bricks.packed(recordings.voxels(s, VOLUME.dims), ("value", "region_id")), dims=VOLUME.dims)


def valued(s, d):
    """Located samples with intensity and region of their voxels, picked from bricks."""
    v = located(s, d).withColumn("volume_id", F.lit(0).cast("long"))
    return bricks.picked(v, voxel_bricks(s, d), ("value", "region_id")).drop("volume_id")


def f26(s, d):
    """Voxel of each sample to millimetres and back, with the error."""
    v = located(s, d).filter("valid")
    ijk = [F.col(c).cast("double") for c in ("voxel_i", "voxel_j", "voxel_k")]
    mm = geometry.transform(VOLUME.matrix(), *ijk)
    back = geometry.transform(VOLUME.inverse(), *mm)
    return rounded(v.select("session_id", "gaze_id", mm[0].alias("x"), mm[1].alias("y"), mm[2].alias("z"), norm2(*[b - a for a, b in zip(ijk, back)]).alias("error")))


def f7(s, d):
    x, y = geometry.canvas(F.col("gaze_x"), F.col("gaze_y"))
    return rounded(gaze(s, d).select("session_id", "gaze_id", x.alias("x"), y.alias("y"), (x.between(0, 1) & y.between(0, 1)).alias("in_bounds")))


def signals(s, d):
    """Ten values a second of each session: mean gaze_x, and whether an axial slice was opened."""
    return shared(s, d, "signals", lambda: _signals(s, d))


def _signals(s, d):
    g = gaze(s, d).groupBy("session_id", F.floor(F.col("time_sec") * 10).cast("long").alias("idx")).agg(F.avg("gaze_x").alias("gaze"))
    z = events(s, d).filter("plane = 'AXIAL'").select("session_id", F.floor(F.col("z_time_sec") * 10).cast("long").alias("idx")).distinct().withColumn("hit", F.lit(1.0))
    return g.join(z, ["session_id", "idx"], "left").select("session_id", "idx", "gaze", F.coalesce("hit", F.lit(0.0)).alias("event"))


def a35(s, d):
    """Views, time (up to each sample from the one before it) and mean intensity of every voxel looked at."""
    spent = kinematics.velocity(gaze(s, d)).select("session_id", "gaze_id", F.coalesce("dt", F.lit(0.0)).alias("spent"))
    v = valued(s, d).filter("valid").join(spent, ["session_id", "gaze_id"])
    return v.groupBy("voxel_i", "voxel_j", "voxel_k").agg(rows().alias("n_views"), F.sum("spent").alias("total_time"), F.avg("value").alias("mean_intensity"))


def detections(s, d):
    """Scores from 0 and labels 0 or 1, by level of the signal."""
    return recordings.clicks(s, d).select((F.col("k") % 5 + 1).alias("snr"), F.floor("value").cast("double").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


ROC = """
 rc0 as (select k % 5 + 1 as snr, floor(value)::double as s, sum((event_type = 'purchase')::int) as p, sum((event_type <> 'purchase')::int) as q from b0 group by 1, 2),
 rc as (select *, sum(p) over w as tp, sum(q) over w as fp, sum(p) over (partition by snr) as np, sum(q) over (partition by snr) as nq from rc0 window w as (partition by snr order by s desc))"""


def p_sql(t: str, free: str) -> str:
    """Two-sided p of Student's t: the density over the angle, integrated by a fine midpoint rule."""
    most = f"least(pi() / 2, 12 / sqrt({free}))"
    area = lambda upto: f"list_sum(list_transform(range(4000), lambda i: pow(cos((i + 0.5::double) * {upto} / 4000e0), {free} - 1))) * {upto} / 4000e0"
    return f"greatest(0, 1 - {area(f'least(atan(abs({t}) / sqrt({free})), {most})')} / ({area(most)}))"


SIG = """
 sg as (select session_id, floor(time_sec * 10)::bigint as idx, avg(gaze_x) as gaze from g group by 1, 2),
 sz as (select distinct session_id, floor(z_time_sec * 10)::bigint as idx from z where plane = 'AXIAL'),
 ss as (select sg.session_id, sg.idx, gaze, case when sz.idx is null then 0e0 else 1e0 end as event from sg left join sz using (session_id, idx)),
 cc as (select a.session_id, lag, count(*) as n, case when stddev_samp(a.gaze) > 0 and stddev_samp(b.event) > 0 then covar_samp(a.gaze, b.event) / (stddev_samp(a.gaze) * stddev_samp(b.event)) end as r
  from ss a cross join (select unnest(range(-20, 21)) as lag) l join ss b on a.session_id = b.session_id and b.idx = a.idx + lag group by 1, 2)"""

QUERIES = {
    "f16_gaze_to_voxels": (
        lambda s, d: rounded(located(s, d).select("session_id", "gaze_id", "voxel_i", "voxel_j", "voxel_k", "mm_x", "mm_y", "mm_z", "valid")),
        rsql("session_id; gaze_id; vi as voxel_i; vj as voxel_j; vk as voxel_k; ~mx as mm_x; ~my as mm_y; ~mz as mm_z; vi between 0 and 15 and vj between 0 and 15 and vk between 0 and 24 as valid", "from lc", LOC.lstrip()),
    ),
    "f26_round_trip": (f26, rsql("session_id; gaze_id; ~2 * vi - 16e0 as x; ~2 * vj - 16e0 as y; ~3 * vk - 36e0 as z; ~0e0 as error", "from lc", LOC.lstrip())),
    "f7_canvas": (f7, rsql("session_id; gaze_id; ~(gaze_x * 2624 - 350) / 1924 as x; ~(gaze_y * 1640 - 80) / 1560 as y; (gaze_x * 2624 - 350) / 1924 between 0 and 1 and (gaze_y * 1640 - 80) / 1560 between 0 and 1 as in_bounds", "from g")),
    "f12_slice_of_index": (
        lambda s, d: events(s, d).select("session_id", "z_event_id", *[geometry.slice_of(F.col("slice_index"), 128, m).alias(m) for m in ("round", "floor", "ceiling")]),
        rsql("session_id; z_event_id; round_even(slice_index * 127, 0)::int + 1 as round; floor(slice_index * 127)::int + 1 as floor; ceil(slice_index * 127)::int + 1 as ceiling", "from z"),
    ),
    "j14_voxel_intensity": (lambda s, d: rounded(valued(s, d).select("session_id", "gaze_id", "value")), rsql("session_id; gaze_id; ~value", "from lv", LOC.lstrip())),
    "j7_atlas_region": (lambda s, d: valued(s, d).groupBy("session_id", F.col("region_id").cast("double").alias("region_id")).agg(rows().alias("n")), rsql("session_id; region_id::double as region_id; count(*) as n", "from lv group by session_id, region_id", LOC.lstrip())),
    "a35_most_viewed_voxels": (
        lambda s, d: rounded(a35(s, d)),
        rsql("vi as voxel_i; vj as voxel_j; vk as voxel_k; count(*) as n_views; ~sum(coalesce(dt, 0)) as total_time; ~avg(value) as mean_intensity", "from lv join (select session_id, gaze_id, dt from m) using (session_id, gaze_id) group by 1, 2, 3", LOC.lstrip()),
    ),
    "a36_slice_report": (
        lambda s, d: rounded(located(s, d).groupBy("plane", "slice_num").agg(rows().alias("n"), F.count_distinct(F.struct("voxel_i", "voxel_j", "voxel_k")).alias("n_voxels"), F.avg("mm_x").alias("mean_x"), F.avg("mm_y").alias("mean_y"), F.sqrt(F.var_samp("mm_x") + F.var_samp("mm_y")).alias("spread"))),
        rsql("plane; slice_num; count(*) as n; count(distinct (vi, vj, vk)) as n_voxels; ~avg(mx) as mean_x; ~avg(my) as mean_y; ~sqrt(var_samp(mx) + var_samp(my)) as spread", "from lc group by 1, 2", LOC.lstrip()),
    ),
    "a38_region_statistics": (
        lambda s, d: rounded(valued(s, d).filter("region_id > 0").groupBy(F.col("region_id").cast("long").alias("region_id")).agg(rows().alias("n"), (F.max("time_aligned") - F.min("time_aligned")).alias("duration"), F.avg("value").alias("mean_intensity"))),
        rsql("region_id::bigint as region_id; count(*) as n; ~max(time_aligned) - min(time_aligned) as duration; ~avg(value) as mean_intensity", "from lv where region_id > 0 group by 1", LOC.lstrip()),
    ),
    "a40_session_extent": (
        lambda s, d: rounded(located(s, d).groupBy("session_id").agg(rows().alias("n"), F.count_distinct(F.struct("voxel_i", "voxel_j", "voxel_k")).alias("n_voxels"), F.min("mm_x").alias("min_x"), F.max("mm_x").alias("max_x"), F.array_join(F.sort_array(F.collect_set("plane")), ",").alias("planes"), F.max("time_sec").alias("duration"))),
        rsql("session_id; count(*) as n; count(distinct (vi, vj, vk)) as n_voxels; ~min(mx) as min_x; ~max(mx) as max_x; string_agg(distinct plane, ',' order by plane) as planes; ~max(time_sec) as duration", "from lc group by 1", LOC.lstrip()),
    ),
    "a31_density": (
        lambda s, d: rounded(heatmap.density(gaze(s, d), ("session_id",), 8, 0.1)),
        rsql("session_id; cx.v::int as gx; cy.v::int as gy; ~sum(exp(-0.5::double * ((gaze_x - cx.v / 7e0) / 0.1::double) ** 2) / 0.25066282746310002::double * (exp(-0.5::double * ((gaze_y - cy.v / 7e0) / 0.1::double) ** 2) / 0.25066282746310002::double)) / count(*) as density", "from g, (select unnest(range(8)) as v) cx, (select unnest(range(8)) as v) cy group by 1, 2, 3"),
    ),
    "a53_cross_correlation": (lambda s, d: rounded(latency.cross_correlation(signals(s, d), 20)), rsql("session_id; lag::int as lag; n; ~r", "from cc", SIG.lstrip())),
    "a54_latency": (
        lambda s, d: rounded(latency.latency(signals(s, d), 20, 10.0).select("session_id", "lag", "latency_ms", "peak", "prominence", "sigma_ms")),
        rsql(
            "session_id; (-lag)::int as lag; ~-lag * 100e0 as latency_ms; ~a as peak; ~a / nullif(med, 0) as prominence; ~100e0 / (sqrt(n) * a) as sigma_ms", "from cb left join cm using (session_id)",
            SIG.lstrip() + ", ca as (select *, abs(r) as a from cc where r is not null), cb as (select * from ca qualify row_number() over (partition by session_id order by a desc, lag) = 1), cm as (select ca.session_id, quantile_cont(ca.a, 0.5) as med from ca join cb on ca.session_id = cb.session_id and ca.lag <> cb.lag group by 1)",
        ),
    ),
    "a61_roc": (
        lambda s, d: rounded(latency.roc(detections(s, d), "score", "label", ("snr",))),
        rsql("snr; ~sum(q * (tp - p / 2e0)) / (max(np) * max(nq)) as auc; ~arg_max(s, (round(tp / np - fp / nq, 12), -s)) as threshold; ~max(round(tp / np - fp / nq, 12)) as youden", "from rc group by 1", ROC.lstrip()),
    ),
    "a61_roc_curve": (
        lambda s, d: rounded(latency.roc_points(detections(s, d), "score", "label", ("snr",)).select("snr", "threshold", "tpr", "fpr")),
        rsql("snr; ~s as threshold; ~tp / np as tpr; ~fp / nq as fpr", "from rc", ROC.lstrip()),
    ),
    "a62_confusion": (
        lambda s, d: rounded(latency.confusion(detections(s, d), F.col("label") == 1, F.col("score") > 50, ("snr",))),
        rsql("snr; tp; fp; fn; tn; n; ~(tp + tn) / n as accuracy; ~tp / nullif(tp + fn, 0) as sensitivity; ~tn / nullif(tn + fp, 0) as specificity", "from (select snr, count(*) filter (where l and p) as tp, count(*) filter (where not l and p) as fp, count(*) filter (where l and not p) as fn, count(*) filter (where not l and not p) as tn, count(*) as n from (select k % 5 + 1 as snr, event_type = 'purchase' as l, floor(value) > 50 as p from b0) group by 1)"),
    ),
    "a48_welch_t": (
        lambda s, d: rounded(studies.welch_test(recordings.clicks(s, d), "value", F.col("event_type") == "click")),
        rsql(f"~t; ~df; ~{p_sql('t', 'df')} as p", "from (select (m1 - m2) / sqrt(e1 + e2) as t, (e1 + e2) ** 2 / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) as df from (select avg(value) filter (where c) as m1, avg(value) filter (where not c) as m2, var_samp(value) filter (where c) / count(*) filter (where c) as e1, var_samp(value) filter (where not c) / count(*) filter (where not c) as e2, count(*) filter (where c) as n1, count(*) filter (where not c) as n2 from (select *, event_type = 'click' as c from b0)))"),
    ),
}
