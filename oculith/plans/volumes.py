"""Queries on volumes as data: each has its own size, spacing and affine, and every sample is looked at in its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from oculith.functions.columns import rounded, rows
from oculith.operators import geometry, matrices, studies
from oculith.plans.base import integrated, rsql
from oculith.plans.files import folder
from oculith.plans.geometry import p_sql
from oculith.plans.motion import corr
from oculith.sources import recordings
from oculith.sources import volumes as files
from oculith.sources.stored import kept, stored

#: The volumes of the recordings and their inverses, worked out entry by entry. A plane of a session is of one volume.
VOLUMES = """
 vo0 as (select n_nationkey::bigint as volume_id, n_nationkey % 5 as k, n_nationkey // 5 as o from nation),
 vo1 as (select *, 16 + 4 * k as nx, 20 - 2 * k as ny, 25 - 3 * o as nz, 0.5::double + k / 4e0 as px, 1 + o % 2 / 2e0 as py, case when volume_id = 24 then 0e0 else 1e0 + o end as pz,
  case when volume_id % 3 = 1 then 0.8::double else 1e0 end as c, case when volume_id % 3 = 1 then 0.6::double else 0e0 end as s, case when volume_id % 3 = 2 then 0.96::double else 1e0 end as d, case when volume_id % 3 = 2 then 0.28::double else 0e0 end as e,
  case when volume_id % 2 = 1 then -1e0 else 1e0 end as f, -8e0 - k as t0, 4e0 * o - 10 as t1, volume_id / 2e0 - 20 as t2, volume_id % 3 <> 0 as oblique from vo0),
 vo2 as (select *, c * px * f as a00, -s * d * py as a01, s * e * pz as a02, s * px * f as a10, c * d * py as a11, -c * e * pz as a12, 0e0 as a20, e * py as a21, d * pz as a22 from vo1),
 vo3 as (select *, px * f * py * pz as det, c / (px * f) as b00, s / (px * f) as b01, 0e0 as b02, -s * d / py as b10, c * d / py as b11, e / py as b12, s * e / nullif(pz, 0) as b20, -c * e / nullif(pz, 0) as b21, d / nullif(pz, 0) as b22 from vo2),
 vo as (select *, -(b00 * t0 + b01 * t1 + b02 * t2) as o0, -(b10 * t0 + b11 * t1 + b12 * t2) as o1, -(b20 * t0 + b21 * t1 + b22 * t2) as o2 from vo3)"""
AT = {"nx": "case plane when 'SAGITTAL' then ny else nx end - 1", "ny": "case plane when 'AXIAL' then ny else nz end - 1", "nz": "case plane when 'AXIAL' then nz when 'SAGITTAL' then nx else ny end - 1"}
TRIPS = VOLUMES + f""",
 rt0 as (select i.*, vo.* exclude (k), {AT['nx']} as lx, {AT['ny']} as ly, {AT['nz']} as lz from i join vo on vo.volume_id = i.session_id * 3 + case plane when 'AXIAL' then 0 when 'SAGITTAL' then 1 else 2 end),
 rt1 as (select *, least(greatest(gaze_x, 0), 1) * lx as x, least(greatest(gaze_y, 0), 1) * ly as y, round_even(slice_index * lz, 0) as z from rt0),
 rt2 as (select *, round_even(x, 0) as rx, round_even(y, 0) as ry, x - round_even(x, 0) as dx, y - round_even(y, 0) as dy from rt1),
 rt3 as (select *, case plane when 'SAGITTAL' then z else rx end as vi, case plane when 'AXIAL' then ry when 'SAGITTAL' then rx else z end as vj, case plane when 'AXIAL' then z else ry end as vk,
  case plane when 'SAGITTAL' then 0 else dx end as ei, case plane when 'AXIAL' then dy when 'SAGITTAL' then dx else 0 end as ej, case plane when 'AXIAL' then 0 else dy end as ek from rt2),
 rt as (select *, a00 * vi + a01 * vj + a02 * vk + t0 as wx, a10 * vi + a11 * vj + a12 * vk + t1 as wy, a20 * vi + a21 * vj + a22 * vk + t2 as wz, sqrt(dx * dx + dy * dy) as voxel_error,
  sqrt((a00 * ei + a01 * ej + a02 * ek) ** 2 + (a10 * ei + a11 * ej + a12 * ek) ** 2 + (a20 * ei + a21 * ej + a22 * ek) ** 2) as mm_error, sqrt((dx / lx) ** 2 + (dy / ly) ** 2) as screen_error from rt3)"""
#: Levels of the error summary, and the share of a screen that a pixel is.
LEVELS, PIXEL = (("volume", "volume_id"), ("plane", "plane"), ("oblique", "oblique"), ("overall", None)), 1 / 512


def volumes(s, d):
    """A row a volume, worked out once for the files at hand."""
    return kept(s, "volumes", [f"{d}/nation.parquet"], lambda: matrices.prepared(recordings.volumes(s, d)))


def trips(s, d):
    """Round trips of every sample through the volume that its session shows on that plane."""
    place = F.expr("case plane when 'AXIAL' then 0 when 'SAGITTAL' then 1 else 2 end")
    i = integrated(s, d).withColumn("volume_id", F.col("session_id") * 3 + place)
    return geometry.round_trips(i.join(volumes(s, d).filter("fault is null"), "volume_id"))


def f23(s, d):
    """Determinant, fault, inverse and how far matrix times inverse is from the identity, of every volume."""
    unit = matrices.identity()
    off = lambda m: F.array_max(F.transform(F.arrays_zip(F.flatten(m).alias("a"), F.flatten(unit).alias("b")), lambda p: F.abs(p["a"] - p["b"])))
    v = volumes(s, d).withColumn("whole", matrices.product(F.col("affine"), F.col("inverse")))
    own = F.col("inverse")
    return rounded(v.select("volume_id", matrices.determinant(F.col("affine")).alias("determinant"), "fault", *[own[r][c].alias(f"b{r}{c}") for r in range(3) for c in range(3)], *[own[r][3].alias(f"o{r}") for r in range(3)], off(F.col("whole")).alias("off"), matrices.transpose(F.col("affine"))[1][0].alias("a01")))


def f22(s, d):
    """Ends of the unrotated volume, and millimetres to fractions and back at its middle."""
    v = volumes(s, d)
    middle = matrices.applied(F.col("frac2mm"), F.lit(0.5), F.lit(0.5), F.lit(0.5))
    v = v.withColumns(dict(zip(("mx", "my", "mz"), middle)))
    back = matrices.applied(F.col("mm2frac"), F.col("mx"), F.col("my"), F.col("mz"))
    return rounded(v.select("volume_id", *[F.col(end)[r].alias(f"{end}_{a}") for end in ("low", "high") for r, a in enumerate("xyz")], "mx", "my", "mz", *[b.alias(f"f{a}") for b, a in zip(back, "xyz")]))


def a49(s, d):
    """Round-trip errors by volume, by plane, by orientation and over all: one row for each value of each level."""
    t = trips(s, d).filter("voxel_error is not null").select("volume_id", "plane", "oblique", "voxel_error", "mm_error", "screen_error")
    t = stored(t, "trips")  # read by every pass of the quantiles, and dear to work out
    of = F.array(*[F.struct(F.lit(level).alias("level"), (F.col(c).cast("string") if c else F.lit("all")).alias("of")) for level, c in LEVELS])
    each = t.select("voxel_error", "mm_error", "screen_error", F.explode(of).alias("l")).select("l.level", "l.of", "voxel_error", "mm_error", "screen_error")
    out = studies.error_summary(each, "voxel_error", ("level", "of"), {"pct_sub_voxel": 0.5})
    more = each.groupBy("level", "of").agg(F.avg("mm_error").alias("mean_mm"), F.max("mm_error").alias("max_mm"), F.avg("screen_error").alias("mean_screen"), F.max("screen_error").alias("max_screen"), (100.0 * F.avg((F.col("screen_error") < PIXEL).cast("double"))).alias("pct_sub_pixel"))
    return rounded(out.join(more, ["level", "of"]))


def a50(s, d):
    """Does the mean error in millimetres of a volume depend on its anisotropy?"""
    ratio = F.array_max("pixdim") / F.array_min("pixdim")
    t = trips(s, d).groupBy("volume_id", ratio.alias("x")).agg(F.avg("mm_error").alias("e"))
    return rounded(studies.correlation_test(t, "x", "e"))


def volume_files(s, d):
    """How often each voxel of each volume was looked at, as volume files."""
    path, t = folder(s, "volumes"), trips(s, d)
    counts = t.groupBy("volume_id", *[F.col(f"voxel_{a}").alias(a) for a in "ijk"]).agg(rows().cast("double").alias("value"))
    files.write_volumes(counts, volumes(s, d).filter("fault is null"), path).count()
    return path


def volume_of(path):
    return F.regexp_extract(path, r"volume-(\d+)\.nii", 1).cast("long").alias("volume_id")


def s5(s, d):
    """Volumes as their files have them, with what their voxels hold; ranges of 8 KB make several tasks of a file."""
    path = volume_files(s, d)
    heads = files.volumes(s, path).select(volume_of("path"), *[F.col("dims")[r].alias(f"n{a}") for r, a in enumerate("xyz")], F.round(F.col("affine")[0][0], 3).alias("a00"), F.round(F.col("affine")[1][2], 3).alias("a12"), F.col("error").isNull().alias("readable"))
    held = files.voxels(s, path, 8192).groupBy(volume_of("path")).agg(rows().alias("n"), F.count_if(F.col("value") > 0).alias("n_seen"), F.sum("value").alias("total"), F.max("value").alias("most"), F.sum(F.col("value") * (F.col("i") + 100 * F.col("j") + 10000 * F.col("k"))).alias("places"))
    return heads.join(held, "volume_id")


def s6(s, d):
    """Slices of the volume files that somebody looked at."""
    v = files.slices(s, volume_files(s, d), 8192).select(volume_of("path"), "k", "width", "height", F.aggregate("content", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("content").alias("most"))
    return v.filter("total > 0")


QUERIES = {
    "s5_volume_files": (
        s5,
        rsql(
            "volume_id; nx::int as nx; ny::int as ny; nz::int as nz; round(a00, 3) + 0e0 as a00; round(a12, 3) + 0e0 as a12; true as readable; (nx * ny * nz)::bigint as n; coalesce(n_seen, 0) as n_seen; coalesce(total, 0)::double as total; coalesce(most, 0)::double as most; coalesce(places, 0)::double as places",
            "from vo left join (select volume_id, count(*) as n_seen, sum(n) as total, max(n) as most, sum(n * (vi + 100 * vj + 10000 * vk)) as places from (select volume_id, vi, vj, vk, count(*) as n from rt group by all) group by 1) using (volume_id) where pz > 0", TRIPS.lstrip(),
        ),
    ),
    "s6_volume_slices": (s6, rsql("volume_id; vk::int as k; any_value(nx)::int as width; any_value(ny)::int as height; sum(n)::double as total; max(n)::double as most", "from (select volume_id, vi, vj, vk, any_value(nx) as nx, any_value(ny) as ny, count(*) as n from rt group by 1, 2, 3, 4) group by volume_id, vk", TRIPS.lstrip())),
    "f23_matrix_algebra": (f23, rsql("volume_id; ~det as determinant; case when abs(det) < 1e-10 then 'singular' end as fault; " + "; ".join(f"~case when pz > 0 then {n} end as {n}" for n in (*[f"b{r}{c}" for r in range(3) for c in range(3)], "o0", "o1", "o2")) + "; ~case when pz > 0 then 0e0 end as off; ~a01", "from vo", VOLUMES.lstrip())),
    "f22_extents": (
        f22,
        rsql(
            "volume_id; " + "; ".join(f"~case when pz > 0 then (-o{r} - 0.5::double) * p{a} end as low_{a}" for r, a in enumerate("xyz")) + "; " + "; ".join(f"~case when pz > 0 then (n{a} - o{r} - 0.5::double) * p{a} end as high_{a}" for r, a in enumerate("xyz")) + "; "
            + "; ".join(f"~case when pz > 0 then a{r}0 * (nx / 2e0 - 0.5::double) + a{r}1 * (ny / 2e0 - 0.5::double) + a{r}2 * (nz / 2e0 - 0.5::double) + t{r} end as m{a}" for r, a in enumerate("xyz")) + "; " + "; ".join(f"~case when pz > 0 then 0.5::double end as f{a}" for a in "xyz"),
            "from vo", VOLUMES.lstrip(),
        ),
    ),
    "f17_anatomy_by_volume": (
        lambda s, d: rounded(trips(s, d).select("session_id", "gaze_id", "volume_id", "slice_num", "voxel_i", "voxel_j", "voxel_k", "world_x", "world_y", "world_z")),
        rsql("session_id; gaze_id; volume_id; z::int + 1 as slice_num; vi::int as voxel_i; vj::int as voxel_j; vk::int as voxel_k; ~wx as world_x; ~wy as world_y; ~wz as world_z", "from rt", TRIPS.lstrip()),
    ),
    "f26_round_trip_by_volume": (
        lambda s, d: rounded(trips(s, d).select("session_id", "gaze_id", "volume_id", "voxel_error", "mm_error", "screen_error")),
        rsql("session_id; gaze_id; volume_id; ~voxel_error; ~mm_error; ~screen_error", "from rt", TRIPS.lstrip()),
    ),
    "f36_volume_use": (
        lambda s, d: rounded(trips(s, d).groupBy("volume_id").agg(rows().alias("n"), F.count_distinct(F.struct("voxel_i", "voxel_j", "voxel_k")).alias("n_voxels"), F.min("world_z").alias("low_z"), F.max("world_z").alias("high_z"))),
        rsql("volume_id; count(*) as n; count(distinct (vi, vj, vk)) as n_voxels; ~min(wz) as low_z; ~max(wz) as high_z", "from rt group by 1", TRIPS.lstrip()),
    ),
    "a49_error_summary": (
        a49,
        rsql(
            "l.level as level; l.of as of; count(*) as n; ~avg(voxel_error) as mean; ~stddev_samp(voxel_error) as sd; ~quantile_cont(voxel_error, 0.5) as median; ~quantile_cont(voxel_error, 0.95) as p95; ~max(voxel_error) as max; ~100e0 * avg((voxel_error < 0.5)::int) as pct_sub_voxel;"
            f" ~avg(mm_error) as mean_mm; ~max(mm_error) as max_mm; ~avg(screen_error) as mean_screen; ~max(screen_error) as max_screen; ~100e0 * avg((screen_error < {PIXEL!r}::double)::int) as pct_sub_pixel",
            "from (select *, unnest([{'level': 'volume', 'of': volume_id::varchar}, {'level': 'plane', 'of': plane}, {'level': 'oblique', 'of': oblique::varchar}, {'level': 'overall', 'of': 'all'}]) as l from rt) group by 1, 2", TRIPS.lstrip(),
        ),
    ),
    "a50_error_dependence": (
        a50,
        rsql(f"n; ~r; ~t; ~n - 2e0 as df; ~{p_sql('t', '(n - 2)')} as p", f"from (select n, case when v > 1e-10 then r end as r, case when v > 1e-10 then r * sqrt(n - 2) / nullif(sqrt(1 - r * r), 0) end as t from (select count(*) as n, {corr('x', 'y')} as r, least(var_samp(x), var_samp(y)) as v from (select greatest(px, py, pz) / least(px, py, pz) as x, log10(case when avg(mm_error) > 0 then avg(mm_error) end) as y from rt group by volume_id, px, py, pz) where y is not null))", TRIPS.lstrip()),
    ),
}
