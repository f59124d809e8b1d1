"""Frames that the registered queries share, and the same as common table expressions for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oculith.functions.columns import NUDGE
from oculith.operators import align, kinematics
from oculith.operators.kinematics import Screen
from oculith.sources import recordings
from oculith.sources.stored import kept

#: Bounds of the image on the display, and the screen of the queries (the derived recordings have about 8 samples a second).
BOUNDS = {"left": 0.2, "right": 0.8, "top": 0.2, "bottom": 0.8}
SCREEN = Screen(min_samples=3)
DIMS = (512, 512, 25)
INTEGRATED = ("session_id", "gaze_id", "time_sec", "time_aligned", "gaze_x", "gaze_y", "z_event_id", "z_time_sec", "plane", "slice_index", "image_id", "time_start", "time_end", "integration_mode", "coverage_ratio")


def shared(s: SparkSession, d: str, name: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """A table from `events` that many queries read: worked out once for the files at hand."""
    return kept(s, name, [f"{d}/events.parquet"], build, **parameters)


def gaze(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "gaze", lambda: align.gaze_clock(recordings.gaze(s, d)))


def events(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "slice-events", lambda: align.event_clock(recordings.slice_events(s, d)))


def spans(s: SparkSession, d: str) -> DataFrame:
    """One row per session, small."""
    return shared(s, d, "spans", lambda: align.session_spans(gaze(s, d), events(s, d)))


def integrated(s: SparkSession, d: str, method: str = "asof") -> DataFrame:
    """Every sample with the slice on screen."""
    aligned = lambda: align.align(gaze(s, d), events(s, d), method=method, spans=spans(s, d)).select(*INTEGRATED)
    return align.within_image(shared(s, d, "integrated", aligned, method=method), **BOUNDS)


def on_screen(s: SparkSession, d: str) -> DataFrame:
    return integrated(s, d).select("session_id", "gaze_id", "time_sec", "time_aligned", "gaze_x", "gaze_y", "plane", "slice_index", "within_bounds")


def moving(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "moving", lambda: kinematics.velocity(gaze(s, d), SCREEN), screen=SCREEN)


def fixed(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "fixed", lambda: kinematics.fixations_deg(moving(s, d), SCREEN), screen=SCREEN)


def fixed_norm(s: SparkSession, d: str) -> DataFrame:
    return shared(s, d, "fixed-norm", lambda: kinematics.fixations_norm(gaze(s, d)))


W, H = SCREEN.width_deg, SCREEN.height_deg

PRELUDE = f"""
b0 as (select event_id, user_id % 8 as session_id, event_type, value,
  (epoch_us(ts) - (select min(epoch_us(ts)) from events)) // 21600 as t_us, cast(json_extract_string(props, '$.k') as bigint) as k from events),
b as (select *, min(case when event_type = 'view' then event_id end) over (partition by session_id) as first_view from b0),
gaze as (select session_id, event_id as src_id, t_us as device_time_stamp, t_us + t_us // 50000 as system_time_stamp,
  15/1e2 + ((t_us // 1500000 * 37 + session_id * 11) % 71) / 1e2 + ((event_id * 13) % 21 - 10) / 5e3 as x,
  15/1e2 + ((t_us // 1500000 * 53 + session_id * 7) % 71) / 1e2 + ((event_id * 29) % 21 - 10) / 5e3 as y
  from b where event_type <> 'view'),
ev as (select session_id, event_id as src_id, t_us / 1e3 as client_timestamp,
  case event_id % 3 when 0 then 'AXIAL' when 1 then 'SAGITTAL' else 'CORONAL' end as plane, (k % 25) / 24e0 as slice_index, 'img0' as image_id
  from b where event_type = 'view' and (session_id < 6 or (session_id = 6 and t_us < 60000000) or (session_id = 7 and event_id = first_view))),
g as (select *, (device_time_stamp - min(device_time_stamp) over (partition by session_id)) / 1e6 as time_sec,
  row_number() over (partition by session_id order by device_time_stamp, src_id) as gaze_id, x as gaze_x, y as gaze_y from gaze),
z as (select *, (client_timestamp - min(client_timestamp) over (partition by session_id)) / 1e3 as z_time_sec,
  row_number() over (partition by session_id order by client_timestamp, src_id) as z_event_id from ev),
sp0 as (select session_id, count(*) as n_gaze, max(time_sec) as gaze_duration from g group by 1),
sp1 as (select session_id, count(*) as n_events, max(z_time_sec) as z_duration from z group by 1),
sp2 as (select *, case when n_events = 1 then 'single_event' when z_duration / nullif(gaze_duration, 0) < 0.95 then 'sparse_coverage' else 'normal' end as integration_mode
  from sp0 join sp1 using (session_id)),
spans as (select *, case when n_events > 1 then z_duration / nullif(gaze_duration, 0) end as coverage_ratio,
  case when integration_mode = 'normal' then z_duration - gaze_duration else 0e0 end as latency from sp2),
zi0 as (select z.*, integration_mode, coverage_ratio,
  case when integration_mode = 'single_event' then 0e0 else z_time_sec end as time_start,
  case when integration_mode = 'single_event' then gaze_duration else coalesce(lead(z_time_sec) over (partition by session_id order by z_time_sec, z_event_id),
    case when integration_mode = 'sparse_coverage' then gaze_duration + latency + 1 else z_duration + 1 end) end as time_end
  from z join spans using (session_id)),
zi as (select * from zi0 where integration_mode = 'single_event' or time_start < time_end),
ga as (select g.*, time_sec + latency as time_aligned from g join spans using (session_id)),
it as (select ga.session_id, gaze_id, time_sec, time_aligned, gaze_x, gaze_y, z_event_id, z_time_sec, plane, slice_index, image_id, time_start, time_end, integration_mode, coverage_ratio,
  (gaze_x - 0.2::double) / 0.6000000000000001::double as gaze_x_adjusted, (gaze_y - 0.2::double) / 0.6000000000000001::double as gaze_y_adjusted
  from ga asof join zi on ga.session_id = zi.session_id and ga.time_aligned >= zi.time_start
  where time_aligned < time_end or integration_mode = 'single_event'),
i as (select *, gaze_x_adjusted between 0 and 1 and gaze_y_adjusted between 0 and 1 as within_bounds from it),
m0 as (select *, time_sec - lag(time_sec) over w as dt, gaze_x - lag(gaze_x) over w as dx, gaze_y - lag(gaze_y) over w as dy
  from g window w as (partition by session_id order by time_sec, gaze_id)),
m1 as (select *, sqrt(dx * dx + dy * dy) as displacement, sqrt(dx * {W!r}::double * (dx * {W!r}::double) + dy * {H!r}::double * (dy * {H!r}::double)) as displacement_deg from m0),
m as (select *, displacement / nullif(dt, 0) as velocity_norm, displacement_deg / nullif(dt, 0) as velocity_deg_s from m1),
f0 as (select *, coalesce(velocity_deg_s < 30, false) as slow from m),
f1 as (select *, (slow <> lag(slow, 1, false) over (partition by session_id order by time_sec, gaze_id))::int as change from f0),
f2 as (select *, sum(change) over (partition by session_id order by time_sec, gaze_id rows unbounded preceding)::bigint as fixation_group from f1),
f3 as (select *, count(*) filter (where slow) over (partition by session_id, fixation_group) as n_samples from f2),
f as (select *, slow and n_samples >= 3 as is_fixation from f3),
n0 as (select *, sqrt(coalesce(dx, 0) * coalesce(dx, 0) + coalesce(dy, 0) * coalesce(dy, 0)) / greatest(coalesce(dt, 0), 0.000001::double) as velocity from m0),
n1 as (select *, velocity < 0.5 as nslow from n0),
n2 as (select *, (nslow and not lag(nslow, 1, false) over (partition by session_id order by time_sec, gaze_id))::int as rise from n1),
n3 as (select *, case when nslow then sum(rise) over (partition by session_id order by time_sec, gaze_id rows unbounded preceding)::bigint end as island from n2),
n4 as (select *, max(time_sec) over (partition by session_id, island) - min(time_sec) over (partition by session_id, island) as span from n3),
fn as (select *, nslow and span >= 0.05::double as is_fixation_n, case when nslow and span >= 0.05::double then island end as fixation_id, case when nslow and span >= 0.05::double then span end as fixation_duration from n4),
tr as (select session_id, z_time_sec as transition_time, lag(slice_index) over w as slice_before, slice_index as slice_after, z_event_id as transition_id
  from z window w as (partition by session_id order by z_time_sec, z_event_id) qualify slice_before <> slice_after)
"""


def sql(select: str, more: str = "") -> str:
    """A full statement from a final select; `more` holds further table expressions."""
    return f"with {PRELUDE.strip()}{',' + more if more else ''}\n{select}"


def rsql(columns: str, source: str, more: str = "") -> str:
    """A statement whose columns all are rounded alike: `expression as name`, with ~ before those that are doubles."""
    out = []
    for item in columns.replace("\n", " ").split(";"):
        item = item.strip()
        if item.startswith("~"):
            expression, _, name = item[1:].rpartition(" as ")
            expression, name = (expression, name) if expression else (name, name.split(".")[-1])
            item = f"round({expression} + {NUDGE * 1e-6!r}::double, 6) + 0e0 as {name.strip()}"
        out.append(item)
    return sql(f"select {', '.join(out)} {source}", more)
