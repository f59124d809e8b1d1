"""One clock for gaze and slice events, and the interval join of every gaze sample to the slice on screen.

All modes are one plan keyed by session: a session's number of events and its coverage only change constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oculith.functions.columns import require_columns
from oculith.operators.ordered import SECONDS, cell_of, numbered, over

SESSION = ("session_id",)


def gaze_clock(gaze: DataFrame, source_order: str = "src_id") -> DataFrame:
    """Seconds since the session's first sample, ids in time order, short names; other columns are carried."""
    require_columns(gaze, "session_id", "device_time_stamp", "gaze_point_on_display_area_x", "gaze_point_on_display_area_y")
    t = F.col("device_time_stamp")
    df = numbered(gaze, SESSION, (t, source_order), cell_of(t, SECONDS * 1e6), "gaze_id", least=("__origin", t))
    df = df.withColumn("time_sec", (t - F.col("__origin")) / F.lit(1e6)).drop("__origin")
    return df.withColumnsRenamed({"gaze_point_on_display_area_x": "gaze_x", "gaze_point_on_display_area_y": "gaze_y"})


def event_clock(events: DataFrame, source_order: str = "src_id") -> DataFrame:
    """Seconds since the session's first event, ids in time order."""
    require_columns(events, "session_id", "client_timestamp", "plane", "index")
    t = F.col("client_timestamp")
    df = numbered(events, SESSION, (t, source_order), cell_of(t, SECONDS * 1e3), "z_event_id", least=("__origin", t))
    return df.withColumn("z_time_sec", (t - F.col("__origin")) / F.lit(1e3)).drop("__origin").withColumnRenamed("index", "slice_index")


def session_spans(gaze: DataFrame, events: DataFrame, coverage_threshold: float = 0.95, latency: float | None = None) -> DataFrame:
    """One row per session with both: counts, durations, coverage, integration mode and latency."""
    g = gaze.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_gaze"), F.max("time_sec").alias("gaze_duration"))
    z = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("z_time_sec").alias("z_duration"))
    ratio = F.try_divide("z_duration", "gaze_duration")
    mode = F.when(F.col("n_events") == 1, "single_event").when(ratio < coverage_threshold, "sparse_coverage").otherwise("normal")
    own = F.lit(0.0) if latency is None else F.lit(float(latency))
    normal = (F.col("z_duration") - F.col("gaze_duration")) if latency is None else own
    return (
        g.join(z, "session_id")
        .withColumn("integration_mode", mode)
        .withColumn("coverage_ratio", F.when(F.col("n_events") > 1, ratio))
        .withColumn("latency", F.when(F.col("integration_mode") == "normal", normal).when(F.col("integration_mode") == "sparse_coverage", own).otherwise(0.0))
    )


def intervals(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Slice events with time_start and time_end; events that end when they start are left out."""
    mode = F.col("integration_mode")
    last = F.when(mode == "sparse_coverage", F.col("gaze_duration") + F.col("latency") + 1).otherwise(F.col("z_duration") + 1)
    out = over(events, lambda w: {"__following": F.lead("z_time_sec").over(w)}, after=1, row="z_event_id").join(spans.select("session_id", "integration_mode", "coverage_ratio", "latency", "gaze_duration", "z_duration"), "session_id")
    out = out.withColumn("time_start", F.when(mode == "single_event", F.lit(0.0)).otherwise(F.col("z_time_sec")))
    out = out.withColumn("time_end", F.when(mode == "single_event", F.col("gaze_duration")).otherwise(F.coalesce("__following", last))).drop("__following")
    return out.filter((mode == "single_event") | (F.col("time_start") < F.col("time_end")))


PAYLOAD = ("z_event_id", "z_time_sec", "plane", "slice_index", "image_id", "time_start", "time_end", "integration_mode", "coverage_ratio")


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, payload: tuple[str, ...], tie: str, bucket: float = 30.0, forward: bool = False, reach: tuple[Column, Column] | None = None) -> DataFrame:
    """Left rows with struct `hit` of the last right row at or before (forward: first at or after) in the same session.

    Both sides are dealt by (session, time bucket), so that a long session spreads over tasks. What other buckets leave
    behind comes from one row per bucket; or, where a right row holds for a known `reach` (from, to) only, the row is
    dealt to every bucket that it reaches, and rows that reach none are left out. Then both sides are read once. Ties
    of time go to the largest `tie` (forward: the smallest).
    """
    hit = F.struct(F.col(right_time).alias("at"), F.col(tie).alias("tie"), *payload)
    cells = F.array(cell_of(right_time, bucket))
    if reach:
        first, last = (cell_of(x, bucket) for x in reach)
        cells = F.when(first <= last, F.sequence(first, last))
    rows = left.select("session_id", cell_of(left_time, bucket).alias("cell"), F.col(left_time).alias("at"), F.lit(0 if forward else 1).alias("side"), F.lit(None).cast("long").alias("tie"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("hit"))
    marks = right.select("session_id", F.explode(cells).alias("cell"), F.col(right_time).alias("at"), F.lit(1 if forward else 0).alias("side"), F.col(tie).cast("long").alias("tie"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), hit.alias("hit"))
    both = rows.unionByName(marks).repartition("session_id", "cell")  # else a union of sides dealt by session stays so
    up = (lambda c: F.col(c).desc()) if forward else F.col
    own = F.last("hit", ignorenulls=True).over(Window.partitionBy("session_id", "cell").orderBy(up("at"), up("side"), up("tie")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("own", own).filter("row is not null")
    if reach:
        return found.select("row.*", F.col("own").alias("hit"))
    pick = F.min("hit") if forward else F.max("hit")
    ends = both.groupBy("session_id", "cell").agg(pick.alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("session_id").orderBy(up("cell")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("session_id", "cell", before.alias("before"))
    return found.join(ends, ["session_id", "cell"]).select("row.*", F.coalesce("own", "before").alias("hit"))


def overlapping(samples: DataFrame, intervals: DataFrame, time: str, start: str, end: str, reach: tuple[Column, Column] | None = None, bucket: float = 30.0) -> DataFrame:
    """Every sample with every interval of its session that holds it (start <= time < end); intervals may overlap.

    An interval lies in cells of time about as wide as itself: those of `bucket` seconds times a power of four. It is dealt
    to the cells that it reaches, or those of `reach` (from, to), the part of it where samples can lie; a sample is dealt
    to one cell of each width that intervals have. So what meets by (session, cell) grows with what is held, however many
    intervals there are a second, and a long session is many tasks'. The narrowest tenth share one width. Columns that
    both sides have, but for the session's, must not be. Intervals without a start or end hold nothing.
    """
    low, high = reach or (F.col(start), F.col(end))
    own = intervals.withColumns({"__low": low, "__high": high}).filter((F.col(start) < F.col(end)) & (F.col("__low") <= F.col("__high")))
    widest = F.ceil(F.log2((F.col("__high") - F.col("__low")) / F.lit(bucket)) / 2).cast("int")
    own = own.withColumn("__width", F.coalesce(F.greatest(widest, F.lit(-10)), F.lit(-10)))
    least = own.agg(F.percentile_approx("__width", 0.1)).scalar()
    own = own.withColumn("__width", F.greatest("__width", least))
    widths = own.agg(F.collect_set("__width")).scalar()
    cell = lambda t: F.floor(t / (F.lit(float(bucket)) * F.pow(F.lit(4.0), F.col("__width")))).cast("long")
    dealt = own.withColumn("__cell", F.explode(F.sequence(cell(F.col("__low")), cell(F.col("__high"))))).drop("__low", "__high")
    both = samples.withColumn("__width", F.explode(widths)).withColumn("__cell", cell(F.col(time))).join(dealt, ["session_id", "__width", "__cell"])
    return both.filter((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("__width", "__cell")


def held(samples: DataFrame, intervals: DataFrame, time: str, start: str, end: str, number: str, bucket: float = 30.0) -> DataFrame:
    """Samples that some interval of their session holds (start <= time < end), with n, first and last: how many do, and
    the smallest and largest `number` among them. No pair is made.

    Numbers must rise with starts and with ends (no interval lies inside another one): those that hold a sample then are
    those that have started without those that have ended. Samples, starts and ends are dealt by (session, time bucket);
    other buckets leave one row behind.
    """
    z = intervals.filter(F.col(start) < F.col(end)).select("session_id", F.col(number).cast("long").alias("k"), F.col(start).cast("double").alias("low"), F.col(end).cast("double").alias("high"))
    marks = z.select("session_id", F.inline(F.array(F.struct(F.col("low").alias("at"), F.lit(1).alias("step"), "k"), F.struct(F.col("high").alias("at"), F.lit(-1).alias("step"), "k"))))
    rows = samples.filter(F.col(time).isNotNull()).select("session_id", F.col(time).cast("double").alias("at"), F.lit(0).alias("step"), F.lit(None).cast("long").alias("k"), F.struct(*samples.columns).alias("row"))
    both = rows.unionByName(marks.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    both = both.withColumn("cell", cell_of("at", bucket)).repartition("session_id", "cell")
    begun, ended = F.when(F.col("step") == 1, F.col("k")), F.when(F.col("step") == -1, F.col("k"))
    ends = both.groupBy("session_id", "cell").agg(F.sum("step").alias("n"), F.max(begun).alias("begun"), F.min(ended).alias("ended"))
    cells = Window.partitionBy("session_id")
    past, ahead = cells.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1), cells.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("session_id", "cell", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("__n"), F.max("begun").over(past).alias("__begun"), F.min("ended").over(ahead).alias("__ended"))
    side, own = F.col("row").isNotNull(), Window.partitionBy("session_id", "cell")
    upto = own.orderBy("at", side).rowsBetween(Window.unboundedPreceding, 0)  # starts and ends at a sample's time count
    after = own.orderBy(F.desc("at"), F.desc(side)).rowsBetween(Window.unboundedPreceding, 0)  # ends at its time don't
    found = both.withColumns({"n": F.sum("step").over(upto), "begun": F.max(begun).over(upto), "ended": F.min(ended).over(after)}).filter("row is not null")
    found = found.join(ends, ["session_id", "cell"]).withColumn("n", F.col("n") + F.col("__n")).filter("n > 0")
    return found.select("row.*", "n", F.least("ended", "__ended").alias("first"), F.greatest("begun", "__begun").alias("last"))


def nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, name: str, bucket: float = 30.0) -> DataFrame:
    """Left rows with the distance to the nearest right row of the session, null where there is none.

    Dealt as in as_of(); both directions are searched in one dealing. Each is a running frame in its own order, as a frame
    that ends with the cell would be read again from every row.
    """
    rows = left.select("session_id", cell_of(left_time, bucket).alias("cell"), F.col(left_time).alias("at"), F.struct(*left.columns).alias("row"), F.lit(None).cast("double").alias("mark"))
    t = F.col(right_time).cast("double")
    both = rows.unionByName(right.select("session_id", cell_of(t, bucket).alias("cell"), t.alias("at"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), t.alias("mark"))).repartition("session_id", "cell")
    cells, own = Window.partitionBy("session_id").orderBy("cell"), Window.partitionBy("session_id", "cell")
    reached = lambda at: F.last("mark", ignorenulls=True).over(own.orderBy(at, F.col("mark").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    ends = both.groupBy("session_id", "cell").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    before = F.last("high", ignorenulls=True).over(cells.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("low", ignorenulls=True).over(Window.partitionBy("session_id").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("session_id", "cell", before.alias("before"), after.alias("after"))
    found = both.withColumns({"back": reached(F.col("at")), "forth": reached(F.desc("at"))}).filter("row is not null").join(ends, ["session_id", "cell"])
    distance = F.least(F.col("at") - F.coalesce("back", "before"), F.coalesce("forth", "after") - F.col("at"))
    return found.select("row.*", distance.alias(name))


def align(gaze: DataFrame, events: DataFrame, coverage_threshold: float = 0.95, latency: float | None = None, method: str = "asof", fallback: bool = False, spans: DataFrame | None = None) -> DataFrame:
    """Every clocked gaze sample with the slice on screen; samples outside all intervals are dropped.

    method "asof" finds the last interval that has begun; "range" finds all intervals that hold a sample, for events whose
    intervals may overlap. With `fallback`, a session where nothing matched gets the event numbered one past the last that has begun (mode `*_alt`). `spans`, one
    row a session from session_spans(), can be given where it is there already.
    """
    spans = session_spans(gaze, events, coverage_threshold, latency) if spans is None else spans
    z = intervals(events, spans)
    g = gaze.join(spans.select("session_id", "latency"), "session_id").withColumn("time_aligned", F.col("time_sec") + F.col("latency")).drop("latency")
    inside = (F.col("time_aligned") < F.col("time_end")) | (F.col("integration_mode") == "single_event")
    end = F.when(F.col("integration_mode") == "single_event", F.col("gaze_duration")).otherwise(F.col("time_end"))
    reach = F.greatest("time_start", "latency"), F.least(end, F.col("gaze_duration") + F.col("latency"))  # no sample lies outside
    if method == "range":
        single = F.when(F.col("integration_mode") == "single_event", F.lit(float("inf"))).otherwise(F.col("time_end"))
        held = z.withColumns({"__end": single, "__low": reach[0], "__high": reach[1]}).select("session_id", "__end", "__low", "__high", *PAYLOAD)
        out = overlapping(g, held, "time_aligned", "time_start", "__end", (F.col("__low"), F.col("__high"))).drop("__end", "__low", "__high")
    else:
        out = as_of(g, z, "time_aligned", "time_start", PAYLOAD, "z_event_id", reach=reach).select(*g.columns, *[F.col(f"hit.{c}").alias(c) for c in PAYLOAD]).filter(inside)
    if not fallback:
        return out
    missed = g.join(out.select("session_id").distinct(), "session_id", "left_anti")
    # Events are numbered by time, so the last one begun says how many have.
    begun = as_of(missed, events, "time_aligned", "z_time_sec", (), "z_event_id").join(spans.select("session_id", "n_events"), "session_id")
    begun = begun.withColumn("z_event_id", F.least(F.coalesce("hit.tie", F.lit(0)) + 1, F.col("n_events"))).drop("hit", "n_events")
    alt = begun.join(z.select("session_id", *PAYLOAD), ["session_id", "z_event_id"])
    return out.unionByName(alt.withColumn("integration_mode", F.concat("integration_mode", F.lit("_alt"))))


def within_image(df: DataFrame, left: float = 0.0, right: float = 1.0, top: float = 0.0, bottom: float = 1.0) -> DataFrame:
    """gaze_x_adjusted, gaze_y_adjusted and within_bounds, for an image inside the display."""
    x, y = (F.col("gaze_x") - left) / F.lit(right - left), (F.col("gaze_y") - top) / F.lit(bottom - top)
    return df.withColumns({"gaze_x_adjusted": x, "gaze_y_adjusted": y}).withColumn("within_bounds", F.col("gaze_x_adjusted").between(0, 1) & F.col("gaze_y_adjusted").between(0, 1))


def integration_report(spans: DataFrame, integrated: DataFrame) -> DataFrame:
    """One row per session: counts, durations, mode, latency, matched and unmatched samples."""
    matched = integrated.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_matched"))
    n = F.coalesce("n_matched", F.lit(0))
    return spans.join(matched, "session_id", "left").select(
        "session_id", "n_gaze", "n_events", "gaze_duration", "z_duration", "integration_mode", "coverage_ratio", "latency",
        n.alias("n_matched"), (F.col("n_gaze") - n).alias("n_unmatched"), (100.0 * n / F.col("n_gaze")).alias("pct_matched"),
    )
