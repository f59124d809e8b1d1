"""Queries on recordings and results as files: each writes what Spark derives from the tables, and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oculith.functions.columns import rounded, rows
from oculith.plans.base import integrated, rsql
from oculith.plans.geometry import LOC, valued
from oculith.sources import files, recordings
from oculith.sources.stored import keep, shared_folder

GAZE = ("device_time_stamp", "system_time_stamp", "gaze_point_on_display_area_x", "gaze_point_on_display_area_y")
EVENTS = ("client_timestamp", "plane", "index", "image_id")


def folder(s, name: str) -> str:
    """A new folder in the shared one, removed at the end."""
    path = f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    keep(s, path)
    return path


def gaze_files(s, d) -> str:
    """The recordings as one folder a session; session 0 is written a second time below a folder of results."""
    path, g = folder(s, "gaze-files"), recordings.gaze(s, d)
    g.select(F.concat(F.lit("s"), "session_id").alias("session"), *GAZE).write.partitionBy("session").option("header", True).csv(path)
    g.filter("session_id = 0").select(F.lit("old_results").alias("session"), *GAZE).write.mode("append").partitionBy("session").option("header", True).csv(path)
    return path


def s1(s, d):
    g = files.gaze(s, gaze_files(s, d), "*.csv")
    return rounded(g.groupBy("session_id").agg(rows().alias("n"), F.sum("device_time_stamp").alias("stamps"), F.avg("gaze_point_on_display_area_x").alias("mean_x"), F.avg("gaze_point_on_display_area_y").alias("mean_y")))


def s2(s, d):
    """Slice events, a folder a session with a file or more a plane; planes that nobody opened have no file."""
    path, z = folder(s, "event-files"), recordings.slice_events(s, d)
    z.select(F.concat(F.lit("s"), "session_id").alias("session"), *EVENTS).repartition("session", "plane").write.partitionBy("session").option("header", True).csv(path)
    back = files.slice_events(s, path, "*.csv")
    return rounded(back.groupBy("session_id", "plane").agg(rows().alias("n"), F.avg("index").alias("mean_index"), F.max("client_timestamp").alias("last")))


def s3(s, d):
    """Sessions found, and what they lack: here the slice events of sessions that looked at no sagittal slice."""
    g = files.gaze(s, gaze_files(s, d), "*.csv").select("session_id").distinct()
    z = recordings.slice_events(s, d).filter("plane = 'SAGITTAL'").select(F.concat(F.lit("session=s"), "session_id").alias("session_id")).distinct()
    return g.join(files.missing_sessions(g, z), "session_id", "left").select("session_id", F.coalesce("error", F.lit("complete")).alias("state"))


def s9(s, d):
    path = folder(s, "result")
    i = integrated(s, d).filter("within_bounds").groupBy("session_id", "plane").agg(rows().alias("n"), F.avg("gaze_x").alias("mean_x"))
    files.write_csv(i, path)
    return rounded(s.read.schema("session_id long, plane string, n long, mean_x double").option("header", True).csv(path))


def s10(s, d):
    path = folder(s, "points")
    points = valued(s, d).filter("valid").select("mm_x", "mm_y", "mm_z", F.col("value").alias("intensity"))
    files.write_points(points, path)
    back = s.read.schema("x double, y double, z double, intensity double").option("sep", " ").csv(path)
    return rounded(back.groupBy("intensity").agg(rows().alias("n"), F.avg("x").alias("mean_x"), F.min("y").alias("low_y"), F.max("z").alias("high_z")))


#: Which columns a session's file has, in its order: every third session's are turned round, session 4 has none of the
#: system's time, session 5 has no header.
LAYOUTS = (GAZE, tuple(reversed(GAZE)), GAZE, GAZE, (GAZE[0], *GAZE[2:]), GAZE, GAZE, tuple(reversed(GAZE)))


def faulty_files(s, d) -> str:
    """Gaze files with planted faults: unreadable positions, lines cut after two values, lines with a value too many."""
    path, g = folder(s, "faulty-files"), recordings.gaze(s, d)
    kind = F.expr("case when src_id % 17 = 0 then 'value' when src_id % 19 = 0 then 'short' when src_id % 23 = 0 then 'long' end")
    x = F.when(kind == "value", F.lit("n/a?")).otherwise(F.col(GAZE[2]).cast("string"))
    g = g.withColumn("kind", kind).withColumn(GAZE[2], x)
    of = F.coalesce(*[F.when(F.col("session_id") == k, F.array(*[F.col(c).cast("string") for c in own])) for k, own in enumerate(LAYOUTS)])
    cut = F.when(F.col("kind") == "short", F.slice(of, 1, 2)).when(F.col("kind") == "long", F.concat(of, F.array(F.lit("0")))).otherwise(of)
    lines = g.select("session_id", F.col("src_id").alias("at"), F.array_join(cut, ",").alias("value"))
    heads = s.createDataFrame([(k, -1, ",".join(own)) for k, own in enumerate(LAYOUTS) if k != 5], "session_id long, at long, value string")
    lines.unionByName(heads).repartition("session_id").sortWithinPartitions("session_id", "at").select(F.concat(F.lit("s"), "session_id").alias("session"), "value").write.partitionBy("session").text(path)
    return path


def s13(s, d):
    """Rows that each session's file gives, and its faults by reason and column."""
    rows_, faults = files.audited(s, faulty_files(s, d), "*.txt", files.GAZE)
    good = rows_.groupBy("session_id").agg(rows().alias("n"), F.avg(GAZE[3]).alias("mean_y")).withColumns({"reason": F.lit("row"), "column": F.lit("")})
    bad = faults.groupBy("session_id", "reason", F.coalesce("column", F.lit("")).alias("column")).agg(rows().alias("n"), F.lit(None).cast("double").alias("mean_y"))
    return rounded(good.unionByName(bad).select("session_id", "reason", "column", "n", "mean_y"))


QUERIES = {
    "s13_file_audit": (
        s13,
        rsql(
            "'session=s' || session_id as session_id; reason; col as column; count(*) as n; ~case when reason = 'row' then avg(y) end as mean_y",
            "from fa where reason <> 'lost' group by fa.session_id, reason, col union all select 'session=s4', 'missing column', 'system_time_stamp', 1, null union all select 'session=s5', 'no header', '', 1, null",
            "fb as (select session_id, y, src_id % 17 = 0 as v, src_id % 17 <> 0 and src_id % 19 = 0 as sh, src_id % 17 <> 0 and src_id % 19 <> 0 and src_id % 23 = 0 as lo from gaze where session_id <> 5), fa as (select session_id, y, unnest(case when sh then ['short line'] when lo then ['long line'] when v then ['row', 'unreadable value'] else ['row'] end) as reason, '' as col from fb where not v union all select session_id, y, unnest(['row', 'unreadable value']), unnest(['', 'gaze_point_on_display_area_x']) from fb where v)",
        ),
    ),
    "s1_gaze_files": (s1, rsql("'session=s' || session_id as session_id; count(*) as n; sum(device_time_stamp)::bigint as stamps; ~avg(x) as mean_x; ~avg(y) as mean_y", "from gaze group by gaze.session_id")),
    "s2_event_files": (s2, rsql("'session=s' || session_id as session_id; plane; count(*) as n; ~avg(slice_index) as mean_index; ~max(client_timestamp) as last", "from ev group by ev.session_id, plane")),
    "s3_sessions": (s3, rsql("'session=s' || session_id as session_id; case when session_id in (select session_id from ev where plane = 'SAGITTAL') then 'complete' else 'no slice events' end as state", "from (select distinct session_id from gaze)")),
    "s9_csv_result": (s9, rsql("session_id; plane; count(*) as n; ~avg(gaze_x) as mean_x", "from i where within_bounds group by 1, 2")),
    "s10_point_cloud": (s10, rsql("~value as intensity; count(*) as n; ~avg(mx) as mean_x; ~min(my) as low_y; ~max(mz) as high_z", "from lv where value is not null group by value", LOC.lstrip())),
}
