"""Live assignment against a plain walk over the rows, with late, early, tied and missing ones."""

import datetime as dt

import pandas as pd

from oculith.streaming import live

START = dt.datetime(2020, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def rows(spark, *own):
    return spark.createDataFrame([(s, None if t is None else at(t), i, shown, plane, x) for s, t, i, shown, plane, x in own], live.ROWS)


def got(df):
    return sorted((r["session_id"], r["gaze_id"], r["z_event_id"]) for r in df.collect())


def test_samples_before_between_and_at_the_time_of_events(spark, tmp_path):
    events = [(1, 10.0, 1, True, "AXIAL", 0.1), (1, 20.0, 2, True, "AXIAL", 0.2), (1, 20.0, 3, True, "CORONAL", 0.3), (2, 15.0, 1, True, "AXIAL", 0.5), (3, 5.0, 1, True, "AXIAL", 0.5)]
    gaze = [(1, t, i, False, None, None) for i, t in enumerate((9.999, 10.0, 19.999, 20.0, 400.0))] + [(2, 14.0, 0, False, None, None), (2, 16.0, 1, False, None, None), (4, 1.0, 0, False, None, None), (None, 1.0, 0, False, None, None), (1, None, 9, False, None, None)]
    out = live.replayed(spark, rows(spark, *events, *gaze), f"file://{tmp_path}", 3)
    assert got(out) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (2, 1, 1)]


def test_nothing_to_play(spark, tmp_path):
    assert live.replayed(spark, rows(spark), f"file://{tmp_path}").count() == 0


def test_rows_out_of_order_are_put_in_order_and_late_ones_dropped(spark, tmp_path):
    """Batches as given: an event that comes after its samples still counts while the watermark allows it."""
    batches = [[(1, 0.0, 1, True, "AXIAL", 0.1), (1, 30.0, 1, False, None, None)], [(1, 25.0, 2, True, "AXIAL", 0.2), (1, 40.0, 2, False, None, None), (1, 60.0, 3, False, None, None)], [(1, 3.0, 4, False, None, None), (1, 2.0, 3, True, "AXIAL", 0.3), (1, 61.0, 5, False, None, None)], [(9, 5000.0, 0, True, "AXIAL", 0.0)], [(9, 9000.0, 0, True, "AXIAL", 0.0)]]
    found = []
    with live.providing(spark):
        for k, own in enumerate(batches):  # the state lasts from one run of the stream to the next
            rows(spark, *own).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            query = live.assign(spark.readStream.schema(live.ROWS).parquet(f"file://{tmp_path}/in"), "10 seconds").writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            found.append(got(spark.read.schema(live.FOUND).parquet(f"file://{tmp_path}/out")))
    assert found[1] == [(1, 1, 2), (1, 2, 2)]  # 60 s lies ahead of the watermark
    assert found[-1] == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (1, 5, 2)]


def test_an_idle_session_ends(spark, tmp_path):
    own = [(1, 0.0, 1, True, "AXIAL", 0.1), (1, 5.0, 1, False, None, None), (2, 500.0, 1, True, "AXIAL", 0.1), (2, 900.0, 5, False, None, None), (1, 1000.0, 2, False, None, None)]
    assert got(live.replayed(spark, rows(spark, *own), f"file://{tmp_path}/a", 5, idle_ms=100_000)) == [(1, 1, 1)]
    assert got(live.replayed(spark, rows(spark, *own), f"file://{tmp_path}/b", 5)) == [(1, 1, 1), (1, 2, 1), (2, 5, 1)]


class State:
    """A state of one key, in memory, that counts how often it is called."""

    def __init__(self):
        self.values, self.calls = [], 0

    def appendValue(self, value):
        self.calls += 1
        self.values.append(value)

    def put(self, values):
        self.calls += 1
        self.values = list(values)

    def update(self, value):
        self.value = value

    def get(self):
        self.calls += 1
        return iter(self.values)

    def clear(self):
        self.values = []


class Single(State):
    value = None

    def get(self):
        return self.value

    def clear(self):
        self.value = None


class Handle:
    def getValueState(self, *_):
        return Single()

    def getListState(self, *_):
        return State()

    def listTimers(self):
        return []

    def registerTimer(self, at):
        self.timer = at


class Passed:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_are_kept_many_at_a_time():
    step = live.OnScreen(3_600_000)
    step.init(Handle())
    own = pd.DataFrame({"at": pd.to_datetime(range(5000), unit="ms"), "shown": [i % 10 == 0 for i in range(5000)], "id": range(5000), "plane": None, "slice_index": 0.5})
    (first,) = step.handleInputRows((1,), iter([own[2500:], own[:2500]]), Passed(999))
    (rest,) = step.handleExpiredTimer((1,), Passed(9000), None)
    assert [(r.gaze_id, r.z_event_id) for part in (first, rest) for r in part.itertuples()] == [(i, i - i % 10) for i in range(5000) if i % 10]
    assert len(first) == 900 and step.waiting.calls < 10
