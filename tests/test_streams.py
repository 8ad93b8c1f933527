"""Trips of a stream whose files come shuffled, with a restart in between, against those of all points at once."""

import random

import pandas as pd
from pyspark.sql import functions as F

from roamgrid.operators import road, trips
from roamgrid.sources.points import from_events
from roamgrid.streaming import live
from tests.compare import DATA

END = "select -1L event_id, -1L taxi_id, timestamp_ntz'2030-01-01 00:00:00' ts, 116.5D lon, 39.5D lat"


def test_trips_after_shuffled_files_and_a_restart(spark, tmp_path):
    """Points up to two hours late; the second half of the files comes after a restart."""
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    points = from_events(spark, f"{DATA}/sf0.001")
    rng = random.Random(1)
    rows = sorted(points.select("event_id", "taxi_id", "ts", "lon", "lat").collect(), key=lambda r: r.ts.timestamp() + rng.random() * 7_000)
    parts = [rows[k : k + 170] for k in range(0, len(rows), 170)]

    def feed(some):
        for part in some:
            rng.shuffle(part)
            spark.createDataFrame(part, live.POINTS).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = live.trips(live.points(spark, source, 1, "3 hours"))
        live.drain(stream, out, state)
        return spark.read.schema(stream.schema).parquet(out)

    feed(parts[:3])
    first = drain().count()
    feed(parts[3:])
    spark.sql(END).write.mode("append").parquet(source)
    got = drain()
    want = trips.summary(points)
    key = ["taxi_id", "start_ts", "end_ts", "points"]
    assert 0 < first < got.count()
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    ends = ["taxi_id", "start_grid", "end_grid", "period"]
    assert sorted(map(tuple, got.select(*ends).collect())) == sorted(map(tuple, trips.endpoints(points).select(*ends).collect()))
    moves = ["u", "v", "period", "seconds", "first_id"]
    told = got.select(F.explode("moves").alias("m")).select("m.*")
    assert sorted(map(tuple, told.select(*moves).collect())) == sorted(map(tuple, road.travel_samples(points).select(*moves).collect()))


def test_points_later_than_the_watermark_are_left_out(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    at = lambda i, t: f"select {i}L event_id, 1L taxi_id, timestamp_ntz'2008-02-02 {t}' ts, 116.5D lon, 39.5D lat"

    def more(*rows):
        spark.sql(" union all ".join(rows)).coalesce(1).write.mode("append").parquet(source)
        stream = live.trips(live.points(spark, source, 1))
        live.drain(stream, out, state)
        return sorted((r.start_ts.strftime("%H:%M"), r.end_ts.strftime("%H:%M"), r.points) for r in spark.read.schema(stream.schema).parquet(out).collect())

    assert more(at(1, "08:00:00"), at(2, "08:05:00"), at(3, "08:11:00")) == []
    assert more(at(4, "08:09:00")) == []  # in time: it joins the others to one trip
    assert more(at(5, "12:00:00")) == [("08:00", "08:11", 4)]
    assert more(at(6, "08:12:00"), at(7, "12:04:00")) == [("08:00", "08:11", 4)]  # too late
    assert more(at(8, "20:00:00"), at(9, "23:00:00")) == [("08:00", "08:11", 4), ("12:00", "12:04", 2)]


def test_one_timer_waits_for_a_vehicle(monkeypatch):
    """However many points and trips come together; those left when it expires get the next one."""
    class Points(list):
        get = list.copy
        appendValue = list.append
        put = lambda self, values: self.__setitem__(slice(None), values)

    class Handle:
        timers = []
        registerTimer = timers.append
        getListState = lambda self, *_: Points()

    class Now:
        getCurrentWatermarkInMs = lambda self: 2_000_000

    state = live.TripState()
    state.init(Handle())
    minute = 60_000_000
    at = [m * minute for trip in (0, 20, 40) for m in (trip, trip + 3, trip + 5)]
    rows = pd.DataFrame({"event_id": range(9), "at": at, "gid": 5, "node": [live.UNKNOWN, *range(8)], "period": 2})
    list(state.handleInputRows((1,), iter([rows.iloc[::-1]]), Now()))
    assert Handle.timers == [600_001]
    told = pd.concat(state.handleExpiredTimer((1,), Now(), None))
    assert told["start_us"].tolist() == [0, 20 * minute] and told["points"].tolist() == [3, 3]
    assert [m["u"] for m in told["moves"][0]] == [0] and Handle.timers[1:] == [3_000_001]
