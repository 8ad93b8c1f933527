"""Counting in rectangles, and the cells of tables of rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, GRID_SIZE, REGION_NEAREST, Rect
from roamgrid.functions.grid import center_lat, center_lon, in_rect, period_of, steps
from roamgrid.operators.polyline import let


def search(points: DataFrame, rect: Rect, start: str | None = None, end: str | None = None) -> DataFrame:
    """Points in a closed rectangle and, if given, from ``start`` until before ``end``."""
    found = points.where(in_rect(F.col("lon"), F.col("lat"), rect))
    if start is not None:
        found = found.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return found if end is None else found.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def region_count(points: DataFrame, rect: Rect, mode: str = "points", start: str | None = None, end: str | None = None) -> DataFrame:
    """``count`` of points, or of vehicles with ``mode="taxis"``."""
    found = search(points, rect, start, end)
    return found.agg((F.count_distinct("taxi_id") if mode == "taxis" else F.count("*")).alias("count"))


def region_count_by_period(points: DataFrame, rect: Rect) -> DataFrame:
    """``period``, ``points`` and ``taxis`` in a rectangle."""
    return search(points, rect).groupBy(period_of(F.col("ts")).alias("period")).agg(F.count("*").alias("points"), F.count_distinct("taxi_id").alias("taxis"))


def _cells_along(low: Column, high: Column, begin: float, step: float, size: int) -> Column:
    """Numbers of the columns or rows of cells that a side touches, clamped to the grid."""
    number = lambda c: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.floor((c - begin) / F.lit(step)))).cast("int")
    return F.sequence(number(low), number(high))


def rect_cells(rects: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """``rect`` and ``gid`` of every cell that each rectangle (x_min, y_min, x_max, y_max) touches."""
    dx, dy = steps(size)
    rows = rects.withColumn("y", F.explode(_cells_along(F.col("y_min"), F.col("y_max"), BOUNDS.y_min, dy, size)))
    cells = rows.withColumn("x", F.explode(_cells_along(F.col("x_min"), F.col("x_max"), BOUNDS.x_min, dx, size)))
    return cells.select("rect", (F.col("y") * size + F.col("x")).alias("gid"))


def _border(own: str, other: str, size: int) -> Column:
    """The border of the cells whose centre is in the closed rectangle ``own``, a struct of its edges.

    Of more than four cells the side that faces away from ``other`` along the larger offset of the centres is
    left out, if some remain; of null it isn't.  The grid bounds the array.
    """
    dx, dy = steps(size)
    middle = lambda i, low, step: ((low + i * step) + (low + (i + 1) * step)) / 2

    def held(low, high, begin, step):
        return F.filter(_cells_along(low, high, begin, step, size), lambda i: middle(i, F.lit(begin), step).between(low, high))

    side = lambda e: F.col(f"{own}.{e}")
    columns, rows = held(side("x_min"), side("x_max"), BOUNDS.x_min, dx), held(side("y_min"), side("y_max"), BOUNDS.y_min, dy)
    return let(columns, lambda xs: let(rows, lambda ys: _facing(xs, ys, own, other, size)))


def _facing(xs: Column, ys: Column, own: str, other: str, size: int) -> Column:
    """The border of the cells in columns ``xs`` and rows ``ys``, without the side that faces away."""
    edge = lambda r, e: F.col(f"{r}.{e}")
    first, last = (lambda a: F.element_at(a, 1)), (lambda a: F.element_at(a, -1))
    cell = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    sides = [F.transform(ys, lambda y: cell(first(xs), y)), F.transform(ys, lambda y: cell(last(xs), y)), F.transform(xs, lambda x: cell(x, first(ys))), F.transform(xs, lambda x: cell(x, last(ys)))]
    around = F.when((F.size(xs) > 0) & (F.size(ys) > 0), F.array_distinct(F.concat(*sides))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    across = (edge(other, "x_min") + edge(other, "x_max")) / 2 - (edge(own, "x_min") + edge(own, "x_max")) / 2
    up = (edge(other, "y_min") + edge(other, "y_max")) / 2 - (edge(own, "y_min") + edge(own, "y_max")) / 2
    far_x, far_y = F.when(across > 0, first(xs)).otherwise(last(xs)), F.when(up > 0, first(ys)).otherwise(last(ys))

    def kept(cells):
        near = F.when(F.abs(across) > F.abs(up), F.filter(cells, lambda c: c["x"] != far_x)).otherwise(F.filter(cells, lambda c: c["y"] != far_y))
        return let(near, lambda near: F.when((F.size(cells) > 4) & F.col(f"{other}.x_min").isNotNull() & (F.size(near) > 0), near).otherwise(cells))

    return F.sort_array(F.transform(let(around, kept), lambda c: c["y"] * size + c["x"]))


def with_borders(pairs: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """``pairs`` (structs ``a`` and ``b`` of edges) with ``border_a`` and ``border_b``, cells that face the other one."""
    return pairs.withColumn("border_a", _border("a", "b", size)).withColumn("border_b", _border("b", "a", size))


def border_neighbours(pairs: DataFrame, k: int = REGION_NEAREST, size: int = GRID_SIZE) -> DataFrame:
    """``pair``, ``gid``, ``other``, ``rank``: for each border cell of A the k nearest border cells of B by degrees.

    Ties go to the smaller cell.  Each cell looks at the border of its own pair only, which the grid bounds.
    """
    # outer ones, as for inner ones a border and its neighbours would be worked out once more for a filter on their size
    cells = with_borders(pairs, size).select("pair", F.explode_outer("border_a").alias("gid"), "border_b").where("gid is not null")
    lon, lat = center_lon(F.col("gid"), size), center_lat(F.col("gid"), size)
    degrees = lambda o: F.sqrt((center_lon(o, size) - lon) * (center_lon(o, size) - lon) + (center_lat(o, size) - lat) * (center_lat(o, size) - lat))
    near = F.slice(F.sort_array(F.transform("border_b", lambda o: F.struct(degrees(o).alias("degrees"), o.alias("other")))), 1, k)
    return cells.select("pair", "gid", F.posexplode_outer(near).alias("at", "n")).where("at is not null").select("pair", "gid", "n.other", (F.col("at") + 1).alias("rank"))
