"""Trips: runs of a vehicle's points without a long gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from roamgrid.config import TRIP_GAP_US
from roamgrid.functions.grid import grid_id, period_of


def in_time() -> WindowSpec:
    """A vehicle's points in order of time, those of one time in file order."""
    return Window.partitionBy("taxi_id").orderBy("ts", "event_id")


def split(points: DataFrame, least: int = 2) -> DataFrame:
    """Points with ``trip_id`` (a number in the vehicle) and ``n``, the points of the trip.

    A trip ends before a gap of over 300 seconds; trips of fewer than ``least`` points are dropped.
    Points of one time keep their file order.  One shuffle by vehicle serves all windows.
    """
    order = in_time()
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(order) > TRIP_GAP_US
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    trips = points.withColumn("new", F.when(gap, 1).otherwise(0)).withColumn("trip_id", F.sum("new").over(upto)).drop("new")
    return trips.withColumn("n", F.count("*").over(Window.partitionBy("taxi_id", "trip_id"))).where(F.col("n") >= least)


def summary(points: DataFrame) -> DataFrame:
    """One row for each trip: points, first and last time, seconds."""
    trips = split(points).groupBy("taxi_id", "trip_id").agg(F.count("*").alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    seconds = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1_000_000
    return trips.withColumn("seconds", seconds)


def endpoints(points: DataFrame) -> DataFrame:
    """First and last cell of each trip and the period of its start.

    Only the two ends are carried through the aggregation, not the trip's points.
    """
    at = F.struct("ts", "event_id")
    here = split(points).withColumn("gid", grid_id(F.col("lon"), F.col("lat")))
    ends = here.groupBy("taxi_id", "trip_id").agg(F.min_by("gid", at).alias("start_grid"), F.max_by("gid", at).alias("end_grid"), F.min("ts").alias("start_ts"))
    return ends.select("taxi_id", "trip_id", "start_grid", "end_grid", period_of(F.col("start_ts")).alias("period"))
