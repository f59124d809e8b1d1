"""Queries on streams: recordings replayed."""

from __future__ import annotations

from pyspark.sql import functions as F

from oculith.plans.base import events, gaze, sql
from oculith.plans.files import folder
from oculith.streaming import live

#: Delay of gaze behind the screen, and the day on which replayed recordings begin.
LATENCY_MS, EPOCH_US = 250, 1_577_836_800_000_000


def x1(s, d):
    """Slices on screen for the recordings, played as a stream with a fixed latency."""
    at = lambda c: F.timestamp_micros(F.lit(EPOCH_US) + F.rint(F.col(c) * 1e6).cast("long")).alias("at")
    g = gaze(s, d).select("session_id", at("time_sec"), "gaze_id")
    z = events(s, d).select("session_id", at("z_time_sec"), "z_event_id", "plane", "slice_index")
    return live.replayed(s, live.stream_of(g, z, LATENCY_MS), folder(s, "live")).withColumn("slice_index", F.round("slice_index", 6))


QUERIES = {
    "x1_live_assignment": (
        x1,
        sql(
            "select g.session_id, g.gaze_id, z.z_event_id, z.plane, round(z.slice_index, 6) as slice_index from g0 g asof join z0 z on g.session_id = z.session_id and g.us >= z.us",
            f"g0 as (select session_id, gaze_id, round(time_sec * 1e6)::bigint + {LATENCY_MS * 1000} as us from g), z0 as (select *, round(z_time_sec * 1e6)::bigint as us from z qualify row_number() over (partition by session_id, round(z_time_sec * 1e6)::bigint order by z_event_id desc) = 1)",
        ),
    ),
}
