"""Gridded density of points by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, DEFAULT_EXPAND_RATIO, DENSITY_SIZE, Rect
from roamgrid.functions.grid import cell_x, cell_y, in_box, period_of

ALL_DAY = -1


def density(points: DataFrame, ratios: tuple[float, ...] = (DEFAULT_EXPAND_RATIO,), size: int = DENSITY_SIZE) -> DataFrame:
    """``ratio``, ``period``, ``gx``, ``gy``, ``n``: points in each cell of the expanded bounds.

    All ratios come from one scan: a point gives a cell to each box that it is in.
    """
    boxes = [(r, BOUNDS.expanded(r)) for r in ratios]
    lon, lat = F.col("lon"), F.col("lat")
    cells = [F.when(in_box(lon, lat, b), F.struct(F.lit(r).alias("ratio"), cell_x(lon, size, b).alias("gx"), cell_y(lat, size, b).alias("gy"))) for r, b in boxes]
    widest = Rect(*(f(b[i] for _, b in boxes) for i, f in enumerate((min, min, max, max))))
    placed = points.where(in_box(lon, lat, widest)).select(period_of(F.col("ts")).alias("period"), F.explode(F.array_compact(F.array(*cells))).alias("c"))
    return placed.groupBy("c.ratio", "period", "c.gx", "c.gy").agg(F.count("*").alias("n"))


def with_all_day(cells: DataFrame) -> DataFrame:
    """The cells of ``density`` and those of the whole day, as period -1."""
    day = cells.groupBy("ratio", "gx", "gy").agg(F.sum("n").alias("n"))
    return cells.unionByName(day.withColumn("period", F.lit(ALL_DAY)))


def totals(cells: DataFrame) -> DataFrame:
    """``ratio``, ``period`` (-1: whole day) and ``total_points``, by one grouping-sets aggregation."""
    cube = cells.groupingSets([["ratio", "period"], ["ratio"]], "ratio", "period").agg(F.sum("n").alias("total_points"))
    return cube.select("ratio", F.coalesce("period", F.lit(ALL_DAY)).alias("period"), "total_points")


def intensity(cells: DataFrame) -> DataFrame:
    """Adds ``intensity``: the logarithm of a cell's count to that of its ratio and period's largest."""
    most = F.max("n").over(Window.partitionBy("ratio", "period"))
    return cells.withColumn("intensity", F.log1p("n") / F.log1p(most))
