"""Columns of the grid, of periods and of geometry, all built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, EARTH_RADIUS, GRID_SIZE, PERIODS, Rect


def steps(size: int = GRID_SIZE, box: Rect = BOUNDS) -> tuple[float, float]:
    """Width and height of a cell in degrees."""
    return (box.x_max - box.x_min) / size, (box.y_max - box.y_min) / size


def period_of(ts: Column) -> Column:
    """0 from 7 to 9, 1 from 17 to 19 o'clock, 2 otherwise and for null."""
    hour = F.hour(ts)
    return F.when(hour.isin(7, 8), 0).when(hour.isin(17, 18), 1).otherwise(2)


def period_name(period: Column) -> Column:
    """The label of a period; ``unknown`` for other numbers and null."""
    names = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])
    return F.coalesce(F.element_at(names, period), F.lit("unknown"))


def in_rect(lon: Column, lat: Column, r: Rect) -> Column:
    """Inside or on the edge."""
    return lon.between(r.x_min, r.x_max) & lat.between(r.y_min, r.y_max)


def in_box(lon: Column, lat: Column, r: Rect) -> Column:
    """Inside, the lower edges included and the upper ones not."""
    return (lon >= r.x_min) & (lon < r.x_max) & (lat >= r.y_min) & (lat < r.y_max)


def cell_x(lon: Column, size: int = GRID_SIZE, box: Rect = BOUNDS) -> Column:
    return F.least(F.floor((lon - F.lit(box.x_min)) / F.lit(steps(size, box)[0])), F.lit(size - 1)).cast("int")


def cell_y(lat: Column, size: int = GRID_SIZE, box: Rect = BOUNDS) -> Column:
    return F.least(F.floor((lat - F.lit(box.y_min)) / F.lit(steps(size, box)[1])), F.lit(size - 1)).cast("int")


def grid_id(lon: Column, lat: Column, size: int = GRID_SIZE) -> Column:
    """``y * size + x``, or -1 outside the bounds and for null."""
    return F.when(in_box(lon, lat, BOUNDS), cell_y(lat, size) * size + cell_x(lon, size)).otherwise(-1)


def grid_bounds(gid: Column, size: int = GRID_SIZE) -> Column:
    """The cell's corners as a struct; null for numbers that are no cell."""
    dx, dy = steps(size)
    x, y = gid % size, F.floor(gid / size)
    box = F.struct(
        (F.lit(BOUNDS.x_min) + x * dx).alias("x_min"), (F.lit(BOUNDS.y_min) + y * dy).alias("y_min"), (F.lit(BOUNDS.x_min) + (x + 1) * dx).alias("x_max"), (F.lit(BOUNDS.y_min) + (y + 1) * dy).alias("y_max")
    )
    return F.when((gid >= 0) & (gid < size * size), box)


def center_lon(gid: Column, size: int = GRID_SIZE) -> Column:
    dx, x = steps(size)[0], gid % size
    return ((F.lit(BOUNDS.x_min) + x * dx) + (F.lit(BOUNDS.x_min) + (x + 1) * dx)) / 2


def center_lat(gid: Column, size: int = GRID_SIZE) -> Column:
    dy, y = steps(size)[1], F.floor(gid / size)
    return ((F.lit(BOUNDS.y_min) + y * dy) + (F.lit(BOUNDS.y_min) + (y + 1) * dy)) / 2


def cell_range(r: Rect, size: int = GRID_SIZE) -> tuple[int, int, int, int]:
    """First and last cell column and row that a rectangle touches, clamped to the grid."""
    dx, dy = steps(size)
    clamp = lambda v: max(0, min(size - 1, v))
    return (
        clamp(math.floor((r.x_min - BOUNDS.x_min) / dx)),
        clamp(math.floor((r.x_max - BOUNDS.x_min) / dx)),
        clamp(math.floor((r.y_min - BOUNDS.y_min) / dy)),
        clamp(math.floor((r.y_max - BOUNDS.y_min) / dy)),
    )


def in_cells(gid: Column, r: Rect, size: int = GRID_SIZE) -> Column:
    """Whether a cell is among those that a rectangle touches."""
    x0, x1, y0, y1 = cell_range(r, size)
    return (gid >= 0) & (gid % size).between(x0, x1) & F.floor(gid / size).between(y0, y1)


def rect_cells(spark: SparkSession, r: Rect, size: int = GRID_SIZE) -> DataFrame:
    """``gid`` of every cell that a rectangle touches."""
    x0, x1, y0, y1 = cell_range(r, size)
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))
    return rows.select("y", F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x")).select((F.col("y") * size + F.col("x")).alias("gid"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(p1) * F.cos(p2) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def direction_part(dx: Column, dy: Column, parts: int) -> Column:
    """Which of ``parts`` equal sectors a direction falls in, from due west on."""
    turn = (F.atan2(dy, dx) + math.pi) / (2 * math.pi)
    return (F.floor(turn * parts) % parts).cast("int")


def intensity_color(v: Column) -> Column:
    """Red, green, blue and alpha of a density's intensity, as doubles."""
    def ramp(first, last, low, width):
        return F.lit(float(first)) + (last - first) * ((v - low) / width)

    whole = lambda c: F.floor(c).cast("double")
    bands = [
        (0.15, F.lit(0.0), whole(ramp(50, 100, 0.0, 0.15)), ramp(150, 255, 0.0, 0.15)),
        (0.35, F.lit(0.0), whole(ramp(100, 255, 0.15, 0.20)), whole(ramp(255, 155, 0.15, 0.20))),
        (0.55, whole(ramp(0, 200, 0.35, 0.20)), F.lit(255.0), whole(ramp(255, 55, 0.35, 0.20))),
        (0.75, ramp(200, 255, 0.55, 0.20), ramp(255, 200, 0.55, 0.20), F.lit(0.0)),
    ]
    out = F.array(F.lit(255.0), whole(ramp(200, 50, 0.75, 0.25)), F.lit(0.0), F.lit(200.0))
    for below, r, g, b in reversed(bands):
        out = F.when(v < below, F.array(r, g, b, F.lit(200.0))).otherwise(out)
    return out
