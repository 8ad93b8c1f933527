"""One-row summaries of the data and of what is built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS
from roamgrid.functions.grid import in_box
from roamgrid.operators import paths, road


def system_stats(points: DataFrame) -> DataFrame:
    """``vehicle_count``, ``total_points``, ``points_in_bounds``, ``graph_nodes``, ``graph_edges``, ``graph_samples``, ``path_trips``."""
    inside = in_box(F.col("lon"), F.col("lat"), BOUNDS).cast("long")
    one = points.agg(F.count_distinct("taxi_id").alias("vehicle_count"), F.count("*").alias("total_points"), F.coalesce(F.sum(inside), F.lit(0)).alias("points_in_bounds"))
    graph = road.graph_stats(points).select(F.col("nodes").alias("graph_nodes"), F.col("edges").alias("graph_edges"), F.col("samples").alias("graph_samples"))
    return one.crossJoin(graph).crossJoin(paths.sequences(points).agg(F.count("*").alias("path_trips")))


def bounds_of(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lon").alias("x_min"), F.min("lat").alias("y_min"), F.max("lon").alias("x_max"), F.max("lat").alias("y_max"))
