import datetime as dt

import pytest
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, Rect, normalized_ratio, period_from_param
from roamgrid.functions.grid import cell_range, grid_bounds, grid_id, in_cells, period_of, rect_cells
from roamgrid.operators import trips
from roamgrid.sources import cache, points

DAY = dt.datetime(2008, 2, 2)
POINTS = "event_id long, taxi_id long, ts timestamp_ntz, lon double, lat double"


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("time,period", [("06:59:59", 2), ("07:00:00", 0), ("08:59:59", 0), ("09:00:00", 2), ("17:00:00", 1), ("18:59:59", 1), ("19:00:00", 2), (None, 2)])
def test_periods(spark, time, period):
    ts = F.lit(None).cast("timestamp_ntz") if time is None else F.lit(f"2008-02-02 {time}").cast("timestamp_ntz")
    assert spark.range(1).select(period_of(ts)).head()[0] == period


def test_grid_ids_at_the_edges(spark):
    rows = [(116.0, 39.4), (117.0, 39.5), (116.5, 40.1), (116.999999, 40.099999), (0.0, 0.0), (None, 39.5)]
    got = [r[0] for r in spark.createDataFrame(rows, "lon double, lat double").select(grid_id(F.col("lon"), F.col("lat"))).collect()]
    assert got == [0, -1, -1, 9999, -1, -1]


def test_corners_need_not_map_back(spark):
    ids = spark.range(10_000).select(F.col("id").cast("int").alias("gid"))
    back = ids.withColumn("b", grid_bounds(F.col("gid"))).withColumn("again", grid_id(F.col("b.x_min"), F.col("b.y_min")))
    assert back.where("gid <> again").count() == 7140
    assert spark.range(1).select(grid_bounds(F.lit(-1))).head()[0] is None


def test_rectangles_are_clamped(spark):
    assert cell_range(Rect(115.0, 39.0, 115.5, 39.2)) == (0, 0, 0, 0)
    assert [r[0] for r in rect_cells(spark, Rect(115.0, 39.0, 115.5, 39.2)).collect()] == [0]
    r = Rect(116.30, 39.60, 116.45, 39.75)
    assert rect_cells(spark, r).count() == spark.range(10_000).where(in_cells(F.col("id"), r)).count() == 17 * 23


def test_parameters():
    assert [period_from_param(v) for v in ("all", "morning", 2, None, "x")] == [None, 0, 2, None, None]
    assert [normalized_ratio(v) for v in (0.05, 0.15 + 1e-12, 0.2, None)] == [0.05, 0.15, 0.10, 0.10]
    assert BOUNDS.meets(Rect(117.0, 39.0, 118.0, 41.0)) and not BOUNDS.meets(Rect(117.1, 39.0, 118.0, 41.0))
    assert BOUNDS.padded() == BOUNDS


def test_a_gap_of_300_seconds_joins(spark):
    times = {1: [0, 300, 600.5, 901.5], 2: [0], 3: [0, 0]}
    rows = [(i, v, at(s), 116.5, 39.5) for v, ss in times.items() for i, s in enumerate(ss)]
    got = trips.split(spark.createDataFrame(rows, POINTS)).groupBy("taxi_id", "trip_id").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(1, 0, 2), (3, 0, 2)}


def test_no_points(spark):
    empty = spark.createDataFrame([], POINTS)
    assert trips.endpoints(empty).count() == trips.summary(empty).count() == points.stride_sample(empty, 7).count() == 0


def test_stride_goes_on_over_vehicles(spark):
    rows = [(v * 10 + i, v, at(i), 116.5, 39.5) for v in range(3) for i in range(10)]
    got = sorted(r[0] for r in points.stride_sample(spark.createDataFrame(rows, POINTS), 7).select("event_id").collect())
    want, seen = [], 0
    for v in range(3):
        want += [v * 10 + i for i in range(10) if i >= seen % 7 and (i - seen % 7) % 7 == 0]
        seen += 10
    assert got == want == [0, 7, 13, 26]


def test_files_of_vehicles(spark, tmp_path):
    (tmp_path / "1.txt").write_text("1,2008-02-02 15:36:08,116.51172,39.92123\n1,bad time,116.5,39.9\n1,2008-02-02 15:46:08,x,39.93883\n")
    (tmp_path / "2.txt").write_text("")
    (tmp_path / "notes.txt").write_text("3,2008-02-02 15:36:08,116.5,39.9\n")
    got = {(r.file_vehicle_id, r.ts, r.lon, r._bad is None) for r in points.from_files(spark, f"{tmp_path}/*.txt").collect()}
    assert (1, dt.datetime(2008, 2, 2, 15, 36, 8), 116.51172, True) in got
    assert (1, None, 116.5, False) in got and (1, dt.datetime(2008, 2, 2, 15, 46, 8), None, False) in got
    assert {g[0] for g in got} == {1, None}
    assert points.size_estimate(points.from_files(spark, f"{tmp_path}/*.txt")).head()[0] >= 2


def test_cache_follows_its_settings(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(len(made)).toDF("x")

    for settings, rows in (({"a": 1}, 1), ({"a": 1}, 1), ({"a": 2}, 2)):
        assert cache.cached(spark, f"{tmp_path}/t", settings, build).count() == rows
