"""The matrix kept up to date against a full one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from roamgrid.operators import od, upkeep

POINT = "event_id long, taxi_id long, at string, lon double, lat double"


def table(spark, rows):
    return spark.createDataFrame(rows, POINT).withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("at")


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for name in ("trips", "matrix") for d, _, names in os.walk(f"{folder}/{name}") for f in names if f.startswith("part-")}


def row(i, taxi, seconds, x=None):
    day, s = divmod(seconds, 86_400)
    return i, taxi, f"2008-02-{2 + day:02d} {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", 116.2 + (x if x is not None else (seconds // 100) % 7) * 0.05, 39.5 + taxi * 0.01


@pytest.mark.parametrize("unit", ["HOUR", "DAY"])
def test_equals_a_full_matrix_after_changes(spark, tmp_path, unit):
    """Points come, go and move, so that trips are made, joined, cut and shortened across parts' borders."""
    rng = random.Random(3)
    folder = f"{tmp_path}/{unit}"
    rows, at = [], 0
    for taxi in range(4):
        s = rng.randrange(3_000)
        while s < 2 * 86_400:
            rows.append(row(len(rows), taxi, s))
            s += rng.choice([60, 200, 300, 301, 2_000, 40_000])
    for step in range(4):
        points = table(spark, rows)
        upkeep.refresh(points, folder, unit)
        full = {(r.start_grid, r.end_grid, r.period): r["count"] for r in od.matrix(points).collect()}
        assert {(r.start_grid, r.end_grid, r.period): r["count"] for r in upkeep.matrix(spark, folder).collect()} == full and full
        low = rng.randrange(2 * 86_400)
        near = [i for i, r in enumerate(rows) if row(0, 0, low)[2] <= r[2] <= row(0, 0, low + 4_000)[2]]
        gone = set(rng.sample(near, len(near) // 2))
        rows = [r for i, r in enumerate(rows) if i not in gone] + [row(10_000 + 100 * step + j, rng.randrange(4), low + rng.randrange(4_000), 3) for j in range(5)]


def test_other_parts_are_left_alone(spark, tmp_path):
    rows = [row(10 * h + k, 1, 3_600 * h + 600 + 100 * k, k) for h in range(6) for k in range(4)]
    folder = str(tmp_path)
    assert len(upkeep.refresh(table(spark, rows), folder, "HOUR")) == 6
    before = files(folder)
    assert upkeep.refresh(table(spark, rows), folder, "HOUR") == [] and files(folder) == before
    rows[8] = row(80, 1, 3_600 * 2 + 600, 6)
    assert upkeep.refresh(table(spark, rows), folder, "HOUR") == ["2008-02-02-02"]
    after = files(folder)
    kept = {f for f in before if "part=2008-02-02-02" not in f}
    assert all(after[f] == before[f] for f in kept) and len(after) == len(before)
    # an hour without points any more
    assert upkeep.refresh(table(spark, [r for r in rows if " 04:" not in r[2]]), folder, "HOUR") == ["2008-02-02-04"]
    assert not [f for f in files(folder) if "part=2008-02-02-04" in f]
    assert upkeep.matrix(spark, folder, "2008-02-02-04", "2008-02-02-05").collect() == []
    assert upkeep.matrix(spark, folder).agg(F.sum("count")).head()[0] == 5


def test_odd_points_and_none(spark, tmp_path):
    folder = str(tmp_path)
    assert upkeep.refresh(table(spark, []), folder) == [] and upkeep.matrix(spark, folder).collect() == []
    rows = [row(1, 1, 0, 0), row(2, 1, 100, 1), (3, 1, None, 116.5, 39.5), (4, None, "2008-02-02 00:00:00", 116.5, 39.5), (5, 1, "2008-02-02 00:03:00", None, None)]
    upkeep.refresh(table(spark, rows), folder)
    assert sorted(map(tuple, upkeep.matrix(spark, folder).collect())) == sorted(map(tuple, od.matrix(table(spark, rows)).select("start_grid", "end_grid", "period", "count").collect()))
