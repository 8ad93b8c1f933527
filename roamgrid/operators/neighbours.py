"""The nearest of many places, for many places at once.

The places to find are kept in cells of halved squares, three halvings to a level.  All places that ask go down
the levels together.  Of a cell's members at least the extent is known, which bounds their distance from below
and from above; of the cells of a place those stay that may hold one of its k nearest.  No place meets all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.config import EARTH_RADIUS
from roamgrid.functions.grid import haversine
from roamgrid.operators.cells import BROADCAST_CELLS, ROOT_WIDTH, with_cell
from roamgrid.plans.storage import written

#: Levels that are looked at: cells of 32, 4 and 1/2 degrees, a sixteenth and a 128th.
LEVELS = (3, 6, 9, 12, 15)
#: Bounds are taken this much wider, in metres and as a share, for what rounding changes.
SLACK_METERS, SLACK = 0.001, 1e-9


def _gap(c: str, low: str, high: str) -> Column:
    return F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(high), F.lit(0.0))


def _least_meters() -> Column:
    """No member of the cell is nearer: its parallel, and its meridian, are so far."""
    along = F.least(F.radians(_gap("lon", "x0", "x1")), F.lit(3.141592653589793 / 2))
    across = F.asin(F.least(F.lit(1.0), F.cos(F.radians("lat")) * F.sin(along)))
    return EARTH_RADIUS * F.greatest(F.radians(_gap("lat", "y0", "y1")), across) * (1 - SLACK) - SLACK_METERS


def _most_meters() -> Column:
    """No member of the cell is further: along the meridian, then along a parallel."""
    far = lambda c, low, high: F.greatest(F.abs(F.col(low) - F.col(c)), F.abs(F.col(high) - F.col(c)))
    return EARTH_RADIUS * (F.radians(far("lat", "y0", "y1")) + F.radians(far("lon", "x0", "x1"))) * (1 + SLACK) + SLACK_METERS


def nearest(places: DataFrame, among: DataFrame, k: int = 1) -> DataFrame:
    """``place``, ``node``, ``meters``, ``rank`` of the k nearest nodes of each place, ties to the smaller node.

    ``places``: place (unique), lon, lat; ``among``: node (unique), lon, lat.  Places of the same coordinates are
    looked up as one.  Rows without coordinates take no part; of fewer than k nodes all are found.
    Longitudes may differ by more than half a turn: nodes are also met from the other side.
    """
    spots = places.where("lon is not null and lat is not null").select("lon", "lat").distinct()
    turned = among.select("node", (F.col("lon") + F.when(F.col("lon") < 0, 360.0).otherwise(-360.0)).alias("lon"), "lat").where(F.abs("lon") < ROOT_WIDTH)
    held = written(with_cell(among.select("node", "lon", "lat").unionByName(turned), LEVELS[-1]), "held")
    up = lambda c, level: F.shiftright(c, LEVELS[-1] - level)
    open_, keys = spots, []
    for i, level in enumerate(LEVELS):
        extent = [F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.count("*").alias("n")]
        above = [up("cx", LEVELS[i - 1]).alias("px"), up("cy", LEVELS[i - 1]).alias("py")] if i else [F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py")]
        cells = written(held.groupBy(up("cx", level).alias("ux"), up("cy", level).alias("uy"), *above).agg(*extent), "cells")
        if not i:  # up to 256 cells of 32 degrees
            open_ = open_.withColumn("px", F.lit(0).cast("long")).withColumn("py", F.lit(0).cast("long"))
        few = cells.count() <= BROADCAST_CELLS
        met = open_.join(F.broadcast(cells) if few else cells, ["px", "py"]).withColumn("least", _least_meters()).withColumn("most", _most_meters())
        # so near are k nodes for certain; a node and its turned copy are two
        spot = Window.partitionBy("lon", "lat")
        running = F.sum("n").over(spot.orderBy("most", "ux", "uy").rowsBetween(Window.unboundedPreceding, 0))
        sure = F.min(F.when(F.col("running") >= 2 * k, F.col("most"))).over(spot)
        met = met.withColumn("running", running).withColumn("sure", F.coalesce(sure, F.lit(float("inf")))).where(F.col("least") <= F.col("sure"))
        open_ = met.select("lon", "lat", F.col("ux").alias("px"), F.col("uy").alias("py"))
    members = held.select(F.col("cx").alias("px"), F.col("cy").alias("py"), "node", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    few = members.count() <= BROADCAST_CELLS
    pairs = open_.join(F.broadcast(members) if few else members, ["px", "py"])
    origin = among.select("node", F.col("lon").alias("own_lon"))
    pairs = pairs.select("lon", "lat", "node", "lat2").distinct().join(F.broadcast(origin) if few else origin, "node")
    meters = haversine(F.col("lon"), F.col("lat"), F.col("own_lon"), F.col("lat2"))
    rank = F.row_number().over(Window.partitionBy("lon", "lat").orderBy("meters", "node"))
    best = pairs.withColumn("meters", meters).withColumn("rank", rank).where(F.col("rank") <= k)
    return places.select("place", "lon", "lat").join(best, ["lon", "lat"]).select("place", "node", "meters", "rank")
