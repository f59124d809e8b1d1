"""Slices on screen for live gaze: the slice of each session is kept as state, so no sample waits for its slice to go.

Gaze and slice events come as one stream. Rows wait in the session's state until the watermark has passed them, as an
earlier one may still come; then they are taken in order of time: an event changes the slice on screen, a sample is sent
with it. A sample so waits as long as rows may be late, however long its slice stays. A timer clears sessions in which
nothing has come for `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from oculith.sources.stored import files_of, set_times

ROWS = "session_id long, at timestamp, id long, shown boolean, plane string, slice_index double"
FOUND = "session_id long, gaze_id long, z_event_id long, plane string, slice_index double"
COLUMNS = ["session_id", "gaze_id", "z_event_id", "plane", "slice_index"]
WAITING = pa.schema([("at", pa.int64()), ("gaze", pa.bool_()), ("id", pa.int64()), ("plane", pa.string()), ("slice_index", pa.float64())])
#: Of a state store's provider; the one in memory holds no timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_of(gaze: DataFrame, events: DataFrame, latency_ms: int = 0) -> DataFrame:
    """Gaze (session_id, at, gaze_id) and slice events (session_id, at, z_event_id, plane, slice_index) as rows of one
    stream. The latency is added to the time of gaze."""
    late = F.col("at") + F.make_dt_interval(secs=F.lit(latency_ms / 1000.0))
    g = gaze.select("session_id", late.alias("at"), F.col("gaze_id").alias("id"), F.lit(False).alias("shown"), F.lit(None).cast("string").alias("plane"), F.lit(None).cast("double").alias("slice_index"))
    return g.unionByName(events.select("session_id", "at", F.col("z_event_id").alias("id"), F.lit(True).alias("shown"), "plane", "slice_index"))


def packed(rows: pd.DataFrame) -> bytes:
    """Rows as one value of a state, in Arrow's format."""
    batch = pa.RecordBatch.from_pandas(rows, WAITING, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, WAITING) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(values: list[bytes]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(v).read_all() for v in values]
    return pa.concat_tables(tables or [WAITING.empty_table()]).to_pandas()


class OnScreen(StatefulProcessor):
    """State of a session: the slice on screen, rows that wait (packed, many a value), and the time of the last row taken."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "id long, plane string, slice_index double")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            at = part["at"].astype("datetime64[us]").astype("int64")
            own = pd.DataFrame({"at": at, "gaze": ~part["shown"].astype(bool), "id": part["id"].astype("int64"), "plane": part["plane"], "slice_index": part["slice_index"].astype("float64")})
            self.waiting.appendValue((packed(own),))
        yield self._taken(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield self._taken(key, timerValues)

    def _taken(self, key: tuple, timerValues: object) -> pd.DataFrame:
        """Takes the waiting rows that the watermark has passed, and sets the one timer of the session."""
        passed = timerValues.getCurrentWatermarkInMs()
        rows = unpacked([bytes(v) for (v,) in self.waiting.get()]).sort_values(["at", "gaze", "id"], kind="stable", ignore_index=True)  # events before gaze of the same time
        n = int(np.searchsorted(rows["at"].to_numpy(), passed * 1000, side="right"))
        due, rest = rows.iloc[:n], rows.iloc[n:]
        last = (self.last.get() or (None,))[0]
        out = self._shown(key, due, last) if n else pd.DataFrame(columns=COLUMNS)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if n:
            last = int(due["at"].iloc[-1])
            self.last.update((last,))
            if len(rest):
                self.waiting.put([(packed(rest),)])
            else:
                self.waiting.clear()
        end = (last or 0) // 1000 + self.idle
        if len(rest):
            self.handle.registerTimer(max(int(rest["at"].iloc[0]) // 1000 + 1, passed + 1))
        elif passed >= end:
            self.current.clear()
            self.last.clear()
        else:
            self.handle.registerTimer(end)
        return out

    def _shown(self, key: tuple, due: pd.DataFrame, last: int | None) -> pd.DataFrame:
        """Samples among rows in order of time, with the last event before them since the session was last idle; keeps
        what is on screen after them."""
        at, gaze, now = due["at"].to_numpy(), due["gaze"].to_numpy(bool), self.current.get()
        idle = np.diff(at, prepend=at[0] if last is None else last) > self.idle * 1000
        place = np.arange(len(due))
        event, begun = np.maximum.accumulate(np.where(gaze, -1, place)), np.maximum.accumulate(np.where(idle, place, -1))
        event[event < begun] = -2  # idle since: nothing is on screen; -1 is what was before these rows
        first = pd.DataFrame([now or (0, None, None)], columns=["id", "plane", "slice_index"]).astype({"id": "int64", "plane": object, "slice_index": "float64"})
        shown = pd.concat([first, due[["id", "plane", "slice_index"]]], ignore_index=True)
        sent = gaze & ((event >= 0) | ((event == -1) & (now is not None)))
        hit = shown.iloc[event[sent] + 1]
        if event[-1] >= 0:
            number, plane, index = shown.iloc[event[-1] + 1]
            self.current.update((int(number), None if pd.isna(plane) else str(plane), None if pd.isna(index) else float(index)))
        elif event[-1] == -2:
            self.current.clear()
        return pd.DataFrame({"session_id": key[0], "gaze_id": due["id"].to_numpy()[sent], "z_event_id": hit["id"].to_numpy(), "plane": hit["plane"].to_numpy(), "slice_index": hit["slice_index"].to_numpy()}, columns=COLUMNS)


def assign(rows: DataFrame, late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """session_id, gaze_id, z_event_id, plane, slice_index of every sample with a slice on screen, from a stream of ROWS.

    Events of the same time: the last by id is on screen. Samples before a session's first event, and after `idle_ms`
    without any row, have none and aren't sent. Rows behind the watermark (`late`) are dropped; rows with a null session or
    time are left out. The session needs PROVIDER as its state store's provider: see providing().
    """
    known = rows.dropna(subset=["session_id", "at", "id"]).withWatermark("at", late)
    return known.groupBy("session_id").transformWithStateInPandas(OnScreen(idle_ms), FOUND, "Append", "EventTime")


@contextmanager
def providing(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def replayed(spark: SparkSession, rows: DataFrame, folder: str, parts: int = 4, late: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """What assign() sends for recorded rows, played as a stream of `parts` batches in order of time; it is written below
    the folder. A row of no session, long after all others, ends the stream."""
    ends = rows.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("session_id"), (F.col("at") + F.expr("interval 1 day")).alias("at"), F.lit(0).cast("long").alias("id"), F.lit(True).alias("shown"), F.lit(None).cast("string").alias("plane"), F.lit(None).cast("double").alias("slice_index"))
    spark.createDataFrame([], ROWS).unionByName(rows).repartitionByRange(parts, "at").write.parquet(f"{folder}/in")
    recorded = [path for path, *_ in files_of(spark, f"{folder}/in")]
    ends.dropna(subset=["at"]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    last = [path for path, *_ in files_of(spark, f"{folder}/in") if path not in recorded]
    set_times(spark, [p for p in [*recorded, *last] if p.endswith(".parquet")])  # a stream of files goes by their times
    played = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with providing(spark):
        query = assign(played, late, idle_ms).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(FOUND).parquet(f"{folder}/out")
