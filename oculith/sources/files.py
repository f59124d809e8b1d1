"""Recordings as files: one folder a session, a gaze file and one file of slice events a plane; and result sinks.

A whole study is one read; the session is the name of the file's folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAZE = "device_time_stamp long, system_time_stamp long, gaze_point_on_display_area_x double, gaze_point_on_display_area_y double"
EVENTS = "client_timestamp double, plane string, index double, image_id string"


def session_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _read(spark: SparkSession, path: str, glob: str, schema: str, skip: str) -> DataFrame:
    """src_id is a hash of file and values: the same on every read; only identical rows share one."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("enforceSchema", False).csv(path)
    source = F.col("_metadata.file_path")
    return df.select(session_of(source).alias("session_id"), F.xxhash64(source, *df.columns).alias("src_id"), "*").filter(~F.col("session_id").contains(skip))


def gaze(spark: SparkSession, path: str, glob: str = "*gaze*.csv", schema: str = GAZE, skip: str = "results") -> DataFrame:
    """Gaze samples of every session below the path; folders whose name holds `skip` are left out."""
    return _read(spark, path, glob, schema, skip)


def slice_events(spark: SparkSession, path: str, glob: str = "*slice_events*.csv", schema: str = EVENTS, skip: str = "results") -> DataFrame:
    """Slice events of every session, all planes together; a plane without a file has no rows."""
    return _read(spark, path, glob, schema, skip)


def missing_sessions(gaze: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, error of the sessions that have only one of the two."""
    g, z = gaze.select("session_id").distinct(), events.select("session_id").distinct()
    return g.join(z, "session_id", "left_anti").withColumn("error", F.lit("no slice events")).unionByName(z.join(g, "session_id", "left_anti").withColumn("error", F.lit("no gaze")))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_points(df: DataFrame, path: str, columns: tuple[str, ...] = ("mm_x", "mm_y", "mm_z", "intensity")) -> None:
    """Point cloud as text: values with blanks between, no header, rows with nulls left out."""
    df.select(*columns).dropna().write.mode("overwrite").option("sep", " ").csv(path)


def sampled(df: DataFrame, *keys: str, n: int = 10_000) -> DataFrame:
    """n rows by the order of a hash of the keys: the same rows on every run."""
    return df.orderBy(F.md5(F.concat_ws("-", *keys)), *keys).limit(n)


#: Commas outside quotes; a value with a line's end in it isn't supported.
COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def audited(spark: SparkSession, path: str, glob: str, schema: str, skip: str = "results") -> tuple[DataFrame, DataFrame]:
    """Rows and faults of CSV files, each read by its own header: columns may stand in any order, lack or be more than asked.

    Rows: session_id, src_id, the schema's columns; values that can't be read are null. Faults: session_id, file, reason,
    column (where it's one), line (its text): `no header` and `missing column` once a file, `short line`, `long line`, and
    `unreadable value` once a value. Lines of files without a header, and short and long ones, give no row; empty lines
    and repeated headers are passed over; null marks NA and NULL are nulls, not faults. Nothing is dropped without a fault.
    """
    kinds = dict(part.split() for part in schema.split(", "))
    names = list(kinds)
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    file = F.col("_metadata.file_path")
    fields = F.transform(F.split(F.regexp_replace("value", "[\\r\ufeff]", ""), COMMA), lambda v: F.trim(F.regexp_replace(F.trim(v), '^"|"$', "")))
    lines = text.select(file.alias("file"), "value", fields.alias("fields")).withColumn("session_id", session_of(F.col("file"))).filter(~F.col("session_id").contains(skip) & (F.trim("value") != ""))
    # A header names at least half of the columns; data can't, as it holds numbers there.
    named = F.size(F.array_intersect("fields", F.array(*map(F.lit, names)))) * 2 >= len(names)
    headers = lines.withColumn("named", named).groupBy("session_id", "file").agg(F.min(F.when(F.col("named"), F.col("fields"))).alias("header"))
    data = lines.filter(~named).join(headers.select("file", "header"), "file")
    short, long = F.size("fields") < F.size("header"), F.size("fields") > F.size("header")
    raw = lambda c: F.get("fields", F.array_position("header", c).cast("int") - 1)
    given = {c: F.when(F.array_contains("header", c) & ~raw(c).isin("", "NA", "NULL"), raw(c)) for c in names}
    data = data.withColumn("whole", F.col("header").isNotNull() & ~short & ~long)
    rows = data.filter("whole").select("session_id", F.xxhash64("file", "value").alias("src_id"), *[given[c].try_cast(kinds[c]).alias(c) for c in names])
    fault = lambda reason, column=None: F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column"))
    by_line = F.array_compact(F.array(F.when(short, fault("short line")), F.when(long, fault("long line")), *[F.when(F.col("whole") & given[c].isNotNull() & given[c].try_cast(kinds[c]).isNull(), fault("unreadable value", c)) for c in names]))
    by_file = F.when(F.col("header").isNull(), F.array(fault("no header"))).otherwise(F.array_compact(F.array(*[F.when(~F.array_contains("header", c), fault("missing column", c)) for c in names])))
    faults = data.filter("header is not null").select("session_id", "file", F.inline(by_line), F.col("value").alias("line"))
    return rows, headers.select("session_id", "file", F.inline(by_file)).withColumn("line", F.lit(None).cast("string")).unionByName(faults)
