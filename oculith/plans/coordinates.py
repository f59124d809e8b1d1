"""Queries on single coordinates, classes, bins, grids and samples of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from oculith.functions.columns import equal_bin, quantile_bin, rounded, rows
from oculith.operators import geometry, kinematics, uncertainty
from oculith.operators.align import session_spans
from oculith.operators.geometry import Volume
from oculith.operators.ordered import over, quantiles, running
from oculith.plans.base import SCREEN, events, fixed, gaze, integrated, moving, on_screen, rsql, sql
from oculith.plans.geometry import LOC, VOLUME, located, valued
from oculith.plans.motion import NEAR
from oculith.plans.studies import LOG
from oculith.sources import files, recordings, trials

#: A volume that is turned in its first plane.
TURNED = Volume((16, 16, 25), (2.0, 2.0, 3.0), ((1.2, -1.6, 0.0, -16.0), (1.6, 1.2, 0.0, -16.0), (0.0, 0.0, 3.0, -36.0), (0.0, 0.0, 0.0, 1.0)))
IJK = ("voxel_i", "voxel_j", "voxel_k")
SLICES = (1, 4, 7, 10, 13, 16, 19, 22, 25)


def product(matrix: np.ndarray, x: str, y: str, z: str) -> list[str]:
    """SQL of a matrix times a point."""
    return [" + ".join(f"{float(v)!r}::double * {c}" for v, c in zip(row, (x, y, z, "1"))) for row in matrix[:3]]


def mapped(matrix, names, out):
    """A query that sends three columns of the located samples through a matrix."""

    def run(s, d):
        v = located(s, d)
        return rounded(v.select("session_id", "gaze_id", *[m.alias(o) for m, o in zip(geometry.transform(matrix, *[F.col(c).cast("double") for c in names]), out)]))

    return run


def fractions(s, d):
    """Centre of each sample's voxel as fractions, there from millimetres."""
    v = located(s, d)
    mm = geometry.transform(TURNED.frac2mm(), *[(F.col(c) + 0.5) / float(n) for c, n in zip(IJK, TURNED.dims)])
    back = geometry.transform(np.linalg.inv(TURNED.frac2mm()), *mm)
    return rounded(v.select("session_id", "gaze_id", *[b.alias(c) for b, c in zip(back, ("fx", "fy", "fz"))]))


def locate_point(s, d):
    i = integrated(s, d).withColumn("slice_num", geometry.slice_number("slice_index", "plane", VOLUME.dims))
    i = i.withColumns({"sx": (F.col("gaze_x") - 0.1) / F.lit(0.8), "sy": (F.col("gaze_y") - 0.1) / F.lit(0.8)})
    v = geometry.located(i, VOLUME, "sx", "sy")
    return rounded(v.select("session_id", "gaze_id", *[(F.col(c) + 1).alias(c) for c in IJK], "mm_x", "mm_y", "mm_z", "valid"))


def picked(s, d):
    points = integrated(s, d).filter("plane = 'AXIAL'").select("session_id", "gaze_id", F.col("gaze_x_adjusted").alias("x"), F.col("gaze_y_adjusted").alias("y"), geometry.slice_number("slice_index", "plane", VOLUME.dims).alias("slice_num"))
    v = recordings.voxels(s, VOLUME.dims).select(*[F.col(c[-1]).cast("int").alias(c) for c in IJK], F.col("value").alias("intensity"))
    return rounded(geometry.picked(points, VOLUME).join(v, list(IJK), "left").select("session_id", "gaze_id", *IJK, "world_x", "world_y", "world_z", "intensity"))


def flags(s, d):
    p = trials.process_log(s, d)
    error, rate = F.abs(F.col("estimated_latency_ms") - F.col("true_latency_ms")), F.col("n_gaze_matched") / F.col("n_gaze_original")
    return rounded(p.groupBy("session_id", (error < 50).alias("accurate"), (rate > 0.9).alias("assigned")).agg(rows().alias("n"), F.avg(error).alias("mean_error"), F.avg(F.col("n_gaze_original") / F.col("processing_time_sec")).alias("points_per_sec")))


def orientation(s, d):
    t = recordings.table(s, d, "events").select(F.expr("case event_id % 6 when 0 then 'RAS' when 1 then 'LPS' when 2 then 'LAS' when 3 then 'RPI' when 4 then 'ASL' end").alias("o"), (F.col("event_id") % 7 == 0).alias("oblique"), "value")
    return rounded(t.groupBy(geometry.orientation_class(F.col("o"), F.col("oblique")).alias("orientation_type")).agg(rows().alias("n"), F.avg("value").alias("mean_value")))


def metadata(s, d):
    """Samples of each session with what is known of the session; sessions without slice events have none."""
    own = session_spans(gaze(s, d), events(s, d)).select("session_id", "integration_mode", "n_events")
    n = gaze(s, d).groupBy("session_id").agg(rows().alias("n"))
    return n.join(own, "session_id", "left").select("session_id", "n", "integration_mode", "n_events")


def grid(s, d):
    """Samples of every session, plane and half of the display, nought where there are none."""
    i = integrated(s, d).select("session_id", "plane", (F.col("gaze_x") >= 0.5).cast("int").alias("half"))
    n = i.groupBy("session_id", "plane", "half").agg(rows().alias("n"))
    sessions, planes = gaze(s, d).select("session_id").distinct(), events(s, d).select("plane").distinct()
    full = sessions.crossJoin(planes).crossJoin(s.range(2).select(F.col("id").cast("int").alias("half")))  # a cell each
    return full.join(n, ["session_id", "plane", "half"], "left").select("session_id", "plane", "half", F.coalesce("n", F.lit(0)).alias("n"))


def speeds(s, d):
    return moving(s, d).filter("velocity_deg_s is not null").select("session_id", "gaze_id", F.col("velocity_deg_s").alias("v"))


def equal_bins(s, d):
    v = speeds(s, d)
    ends = v.groupBy("session_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return v.join(ends, "session_id").groupBy("session_id", equal_bin(F.col("v"), F.col("low"), F.col("high"), 10).alias("bin")).agg(rows().alias("n"))


def quantile_bins(s, d):
    v = speeds(s, d)
    breaks = quantiles(v, "v", (0.0, 0.25, 0.5, 0.75, 1.0), name="breaks")
    return v.join(breaks, "session_id").groupBy("session_id", quantile_bin(F.col("v"), F.col("breaks")).alias("bin")).agg(rows().alias("n"))


def increments(s, d):
    """Fixation samples so far, and how many more than five samples before."""
    f = running(fixed(s, d), "so_far", F.col("is_fixation").cast("int"))
    gained = lambda w: {"gained": F.col("so_far") - F.coalesce(F.lag("so_far", 5).over(w), F.lit(0))}
    return over(f, gained, before=5).select("session_id", "gaze_id", "so_far", "gained")


def confidence_class(s, d):
    v = uncertainty.confidence(uncertainty.nearest_transition(on_screen(s, d), kinematics.transitions(events(s, d))), SCREEN)
    return v.select("session_id", "gaze_id", "assignment_confidence", F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"))


MM = product(TURNED.matrix(), "vi", "vj", "vk")
BACK = product(TURNED.inverse(), "mx", "my", "mz")
FRAC = product(TURNED.frac2mm(), "fi", "fj", "fk")
PLANES = "case plane when 'AXIAL' then {a} when 'SAGITTAL' then {s} when 'CORONAL' then {c} end"
ANATOMY = f"""
 an0 as (select *, {PLANES.format(a="round_even(slice_index * 24, 0)", s="round_even(slice_index * 15, 0)", c="round_even(slice_index * 15, 0)")}::int as sl from i where within_bounds),
 an1 as (select *, round_even(gaze_x_adjusted * 15, 0) as px, {PLANES.format(a="round_even(gaze_y_adjusted * 15, 0)", s="round_even(gaze_y_adjusted * 24, 0)", c="round_even(gaze_y_adjusted * 24, 0)")} as py from an0),
 ax as (select *, {PLANES.format(a="px", s="sl", c="px")} as ai, {PLANES.format(a="py", s="px", c="sl")} as aj, {PLANES.format(a="sl", s="py", c="py")} as ak from an1)"""


def world(i: str, j: str, k: str) -> str:
    return f"~2 * (16 * {i} / 15e0 - 0.5::double) - 16 as world_x; ~2 * (16 * {j} / 15e0 - 0.5::double) - 16 as world_y; ~3 * (25 * {k} / 24e0 - 0.5::double) - 36 as world_z"


SHIFTED = LOC.replace("least(greatest(gaze_x, 0), 1)", "least(greatest((gaze_x - 0.1::double) / 0.8::double, 0), 1)").replace("least(greatest(gaze_y, 0), 1)", "least(greatest((gaze_y - 0.1::double) / 0.8::double, 0), 1)")
ORTHO = VOLUME.ortho()
QUERIES = {
    "f15_locate_point": (locate_point, rsql("session_id; gaze_id; vi + 1 as voxel_i; vj + 1 as voxel_j; vk + 1 as voxel_k; ~mx as mm_x; ~my as mm_y; ~mz as mm_z; vi between 0 and 15 and vj between 0 and 15 and vk between 0 and 24 as valid", "from lc", SHIFTED.lstrip())),
    "f17_gaze_to_anatomy": (
        lambda s, d: rounded(geometry.anatomy(integrated(s, d), VOLUME).select("session_id", "gaze_id", "slice_num", "voxel_x", "voxel_y", "voxel_z", "world_x", "world_y", "world_z")),
        rsql(f"session_id; gaze_id; sl + 1 as slice_num; ~px as voxel_x; ~py as voxel_y; ~sl as voxel_z; {world('px', 'py', 'sl')}", "from ax", ANATOMY.lstrip()),
    ),
    "f17_gaze_to_anatomy_axes": (
        lambda s, d: rounded(geometry.anatomy(integrated(s, d), VOLUME, "anatomical").select("session_id", "gaze_id", "slice_num", "voxel_x", "voxel_y", "voxel_z", "world_x", "world_y", "world_z")),
        rsql(f"session_id; gaze_id; sl + 1 as slice_num; ~ai as voxel_x; ~aj as voxel_y; ~ak as voxel_z; {world('ai', 'aj', 'ak')}", "from ax", ANATOMY.lstrip()),
    ),
    "f18_voxel_to_mm": (mapped(TURNED.matrix(), IJK, ("x", "y", "z")), rsql("session_id; gaze_id; " + "; ".join(f"~{e} as {n}" for e, n in zip(MM, "xyz")), "from lc", LOC.lstrip())),
    "f19_mm_to_voxel": (mapped(TURNED.inverse(), ("mm_x", "mm_y", "mm_z"), ("i", "j", "k")), rsql("session_id; gaze_id; " + "; ".join(f"~{e} as {n}" for e, n in zip(BACK, "ijk")), "from lc", LOC.lstrip())),
    "f20_fraction_to_mm": (
        lambda s, d: rounded(located(s, d).select("session_id", "gaze_id", *[m.alias(n) for m, n in zip(geometry.transform(TURNED.frac2mm(), *[F.col(c) / float(n - 1) for c, n in zip(IJK, TURNED.dims)]), "xyz")])),
        rsql("session_id; gaze_id; " + "; ".join(f"~{e} as {n}" for e, n in zip(product(TURNED.frac2mm(), "(vi / 15e0)", "(vj / 15e0)", "(vk / 24e0)"), "xyz")), "from lc", LOC.lstrip()),
    ),
    "f21_mm_to_fraction": (fractions, rsql("session_id; gaze_id; ~(vi + 0.5::double) / 16 as fx; ~(vj + 0.5::double) / 16 as fy; ~(vk + 0.5::double) / 25 as fz", "from lc", LOC.lstrip())),
    "f32_confidence_class": (confidence_class, rsql("session_id; gaze_id; case when d > 0.06::double then 'High (>99.7%)' when d > 0.04::double then 'Good (95-99.7%)' when d > 0.02::double then 'Moderate (68-95%)' else 'Ambiguous (<68%)' end as assignment_confidence; coalesce(d <= 0.06::double, false) as is_ambiguous", "from near", NEAR.lstrip())),
    "f35_flags": (flags, rsql("session_id; err < 50 as accurate; n1 / n0 > 0.9::double as assigned; count(*) as n; ~avg(err) as mean_error; ~avg(n0 / sec) as points_per_sec", "from lg group by 1, 2, 3", LOG.lstrip())),
    "f36_in_volume": (lambda s, d: located(s, d).groupBy("session_id", "valid").agg(rows().alias("n")), rsql("session_id; coalesce(vi between 0 and 15 and vj between 0 and 15 and vk between 0 and 24, false) as valid; count(*) as n", "from lc group by 1, 2", LOC.lstrip())),
    "f39_orientation_class": (
        orientation,
        "select case when event_id % 7 = 0 then 'Oblique' when event_id % 6 < 4 then case event_id % 6 when 0 then 'RAS' when 1 then 'LPS' when 2 then 'LAS' else 'RPI' end else 'Other' end as orientation_type, count(*) as n, round(avg(value) + 7.071e-10, 6) + 0e0 as mean_value from events group by 1",
    ),
    "f43_picked_points": (
        picked,
        rsql(
            "session_id; gaze_id; px::int as voxel_i; py::int as voxel_j; sl as voxel_k; " + "; ".join(f"~{e} as {n}" for e, n in zip(product(ORTHO, "(px / 16e0)", "(py / 16e0)", "(sl / 25e0)"), ("world_x", "world_y", "world_z"))) + "; ~((px * 7 + py * 13 + sl * 29)::bigint % 256)::double as intensity",
            "from (select *, round_even(gaze_x_adjusted * 15, 0) as px, round_even(gaze_y_adjusted * 15, 0) as py, round_even(slice_index * 24, 0)::int as sl from i where plane = 'AXIAL') where px between 0 and 15 and py between 0 and 15",
        ),
    ),
    "j12_metadata": (metadata, sql("select session_id, count(*) as n, integration_mode, n_events from g left join (select session_id, integration_mode, n_events from spans) m using (session_id) group by all")),
    "j13_grid": (
        grid,
        sql("select s.session_id, p.plane, h.half::int as half, count(i.gaze_id) as n from (select distinct session_id from g) s cross join (select distinct plane from z) p cross join (select unnest(range(2)) as half) h left join i on i.session_id = s.session_id and i.plane = p.plane and (i.gaze_x >= 0.5)::int = h.half group by 1, 2, 3"),
    ),
    "b1_equal_bins": (equal_bins, sql("select session_id, least(10, greatest(1, coalesce(ceil((v - low) * 10e0 / nullif(high - low, 0)), 1)))::int as bin, count(*) as n from (select session_id, velocity_deg_s as v, min(velocity_deg_s) over w as low, max(velocity_deg_s) over w as high from m where velocity_deg_s is not null window w as (partition by session_id)) group by 1, 2")),
    "b2_quantile_bins": (
        quantile_bins,
        sql("select session_id, case when q[1] < q[2] and q[2] < q[3] and q[3] < q[4] and q[4] < q[5] then 1 + (velocity_deg_s > q[2])::int + (velocity_deg_s > q[3])::int + (velocity_deg_s > q[4])::int end as bin, count(*) as n from m join (select session_id, quantile_cont(velocity_deg_s, [0, 0.25, 0.5, 0.75, 1]) as q from m where velocity_deg_s is not null group by 1) using (session_id) where velocity_deg_s is not null group by 1, 2"),
    ),
    "w16_fixation_increments": (
        increments,
        sql("select session_id, gaze_id, so_far, so_far - coalesce(lag(so_far, 5) over (partition by session_id order by time_sec, gaze_id), 0) as gained from (select *, (sum(is_fixation::int) over (partition by session_id order by time_sec, gaze_id rows unbounded preceding))::bigint as so_far from f)"),
    ),
    "k5_first_samples": (
        lambda s, d: rounded(integrated(s, d).filter("within_bounds").orderBy("time_aligned", "session_id", "gaze_id").limit(5).select("session_id", "gaze_id", "time_aligned")),
        rsql("session_id; gaze_id; ~time_aligned", "from (select * from i where within_bounds order by time_aligned, session_id, gaze_id limit 5)"),
    ),
    "k7_sample": (
        lambda s, d: files.sampled(integrated(s, d).filter("plane = 'AXIAL'").select("session_id", "gaze_id", "slice_index"), "session_id", "gaze_id", n=200),
        sql("select session_id, gaze_id, slice_index from i where plane = 'AXIAL' order by md5(session_id || '-' || gaze_id), session_id, gaze_id limit 200"),
    ),
    "s7_spread_slices": (
        lambda s, d: valued(s, d).join(F.broadcast(s.createDataFrame([(k,) for k in SLICES], "slice_num int")), "slice_num", "left_semi").filter("plane = 'AXIAL'").groupBy("slice_num").agg(rows().alias("n")),
        rsql("slice_num; count(*) as n", f"from lc where plane = 'AXIAL' and slice_num in {SLICES} group by 1", LOC.lstrip()),
    ),
    "u5_unnest": (
        lambda s, d: rounded(gaze(s, d).select("session_id", "gaze_id", F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("gaze_x").alias("at")), F.struct(F.lit("y").alias("axis"), F.col("gaze_y").alias("at")))).alias("e")).select("session_id", "gaze_id", "e.axis", "e.at")),
        rsql("session_id; gaze_id; e.axis as axis; ~e.at as at", "from (select session_id, gaze_id, unnest([{'axis': 'x', 'at': gaze_x}, {'axis': 'y', 'at': gaze_y}]) as e from g)"),
    ),
}
