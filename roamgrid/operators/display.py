"""Recorded trips that show a path, or a way between two regions, on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.config import Rect
from roamgrid.functions.grid import in_cells, in_rect
from roamgrid.operators import paths
from roamgrid.plans.storage import written

#: What a line shown for a path is, best first.
EXEMPLAR, TRIP, REGION, GRID = "exemplar", "trip", "region", "grid"


def trip_table(points: DataFrame) -> DataFrame:
    """``taxi_id``, ``trip_id``, ``coords``, ``path`` (null for too short ones), ``p`` and ``q``, its ends, of each trip; written.

    What all that shows trips is made from, so that points are cut into trips once.
    """
    place, at = F.struct("lon", "lat"), F.struct("ts", "event_id")
    cut = written(paths.long_trips(points), "long_trips")
    ends = cut.groupBy("taxi_id", "trip_id").agg(F.min_by(place, at).alias("p"), F.max_by(place, at).alias("q"))
    lines = paths.display_coords(points, cut=cut).join(paths.sequences(points, cut=cut), ["taxi_id", "trip_id"], "left")
    return written(lines.join(ends, ["taxi_id", "trip_id"]), "trips")


def recorded_lines(trips: DataFrame) -> DataFrame:
    """``taxi_id``, ``trip_id``, ``path`` and ``coords`` of each trip of a ``trip_table`` that has a path and a line."""
    return trips.where(F.col("path").isNotNull() & (F.size("coords") >= 2)).select("taxi_id", "trip_id", "path", "coords")


def crossing_trips(trips: DataFrame, a: Rect, b: Rect) -> DataFrame:
    """``taxi_id``, ``trip_id`` of the trips from A to B, and whether they are so ``by_cells`` and ``by_points``.

    By cells: the first and the last cell of its path touch the regions.  By points: its first and last
    point lie in them, edges included.
    """
    by_cells = F.coalesce(in_cells(F.element_at("path", 1), a) & in_cells(F.element_at("path", -1), b), F.lit(False))
    by_points = in_rect(F.col("p.lon"), F.col("p.lat"), a) & in_rect(F.col("q.lon"), F.col("q.lat"), b)
    return trips.select("taxi_id", "trip_id", by_cells.alias("by_cells"), by_points.alias("by_points")).where("by_cells OR by_points")


def region_trip(trips: DataFrame, a: Rect, b: Rect) -> DataFrame:
    """One row: ``taxi_id``, ``trip_id`` and ``coords`` of the trip from A to B with the longest line, nulls if none.

    Of equal ones the first vehicle's first trip.
    """
    lines = trips.join(crossing_trips(trips, a, b).select("taxi_id", "trip_id"), ["taxi_id", "trip_id"])
    rank = F.struct((-F.size("coords")).alias("n"), "taxi_id", "trip_id")
    return lines.agg(F.min_by(F.struct("taxi_id", "trip_id", "coords"), rank).alias("m")).select("m.*")


def recorded_trips(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """For each asked ``path`` the recorded trip that shows it: ``taxi_id``, ``trip_id``, ``coords``, ``exact``.

    The first vehicle's first trip along exactly this path, else the one of the longest line from its
    first to its last cell.  Paths without either have no row.
    """
    # one trip for each path, and one for each pair of ends, before any path is looked up
    ends = [F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last")]
    trip, number = F.struct("taxi_id", "trip_id", "coords"), F.struct("taxi_id", "trip_id")
    along = lines.groupBy("path").agg(F.min_by(trip, number).alias("along"))
    between = lines.groupBy(*ends).agg(F.min_by(trip, F.struct((-F.size("coords")).alias("n"), "taxi_id", "trip_id")).alias("between"))
    wanted = asked.select("path").distinct().select("path", *ends)
    found = wanted.join(along, "path", "left").join(between, ["first", "last"], "left").withColumn("m", F.coalesce("along", "between"))
    return found.where("m IS NOT NULL").select("path", "m.*", F.col("along").isNotNull().alias("exact"))


def with_lines(asked: DataFrame, known: DataFrame, lines: DataFrame, region: DataFrame | None = None) -> DataFrame:
    """``asked`` paths with the ``coords`` to draw and what they are (``shown``).

    The path's exemplar (``known``), else a recorded trip (of ``lines``), else the trip between the
    regions (one row of ``region_trip``), else the cells' centres.
    """
    out = asked.join(known.select("path", F.col("coords").alias("of_path")), "path", "left")
    out = out.join(recorded_trips(asked, lines).select("path", F.col("coords").alias("of_trip")), "path", "left")
    out = out.crossJoin(F.broadcast(region.select(F.col("coords").alias("of_region")))) if region is not None else out.withColumn("of_region", F.lit(None).cast("array<array<double>>"))
    steps = [("of_path", EXEMPLAR), ("of_trip", TRIP), ("of_region", REGION)]
    shown = F.coalesce(*[F.when(F.size(c) >= 2, F.lit(name)) for c, name in steps], F.lit(GRID))
    coords = F.coalesce(*[F.when(F.size(c) >= 2, F.col(c)) for c, _ in steps], paths.path_coords(F.col("path")))
    return out.withColumn("shown", shown).withColumn("coords", coords).drop("of_path", "of_trip", "of_region")


def hint(hits: Column, total: Column) -> Column:
    """A note for the reader where not all lines are recorded ones; null if nothing is to say."""
    some = F.format_string("%d paths have no recorded trip and are drawn along the grid", total - hits)
    return F.when((total > 0) & (hits == 0), "no recorded trip was found; lines follow the grid or the roads").when((total > 0) & (hits < total), some)
