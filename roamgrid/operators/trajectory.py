"""Vehicles' trajectories for display, thinned and, if wanted, put on the road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.config import SNAP_KEYFRAME, SNAP_SEGMENTS, TRAJECTORY_POINTS, TRAJECTORY_STRIDE, TRAJECTORY_VEHICLES
from roamgrid.operators.polyline import simplify
from roamgrid.operators.routing import fastest_routes, nearest_node, route_coords
from roamgrid.operators.trips import in_time


def of_vehicle(points: DataFrame, taxi_id: int) -> DataFrame:
    """A vehicle's points with ``seq`` in order of time."""
    return points.where(F.col("taxi_id") == taxi_id).withColumn("seq", F.row_number().over(in_time()) - 1)


def first_vehicles(points: DataFrame, most: int = TRAJECTORY_VEHICLES) -> DataFrame:
    """Points of the ``most`` vehicles, one at least, with the lowest ids."""
    ids = points.select("taxi_id").distinct().orderBy("taxi_id").limit(max(1, most))
    return points.join(F.broadcast(ids) if most <= 10_000 else ids, "taxi_id", "left_semi")


def strided(points: DataFrame, stride: int = TRAJECTORY_STRIDE) -> DataFrame:
    """Every ``stride``-th point of each vehicle in order of time, with its number ``rn``."""
    return points.withColumn("rn", F.row_number().over(in_time()) - 1).where(F.col("rn") % max(1, stride) == 0)


def capped(points: DataFrame, stride: int = TRAJECTORY_STRIDE, most: int = TRAJECTORY_POINTS) -> DataFrame:
    """``strided``, and of vehicles with more than ``most`` points every (n // most)-th, ``most`` in all."""
    some = strided(points, stride).withColumn("total", F.count("*").over(Window.partitionBy("taxi_id")))
    some = some.withColumn("k", F.row_number().over(in_time()) - 1).withColumn("every", F.greatest(F.lit(1), F.floor(F.col("total") / most)))
    kept = (F.col("total") <= most) | ((F.col("k") % F.col("every") == 0) & (F.floor(F.col("k") / F.col("every")) < most))
    return some.where(kept).drop("k", "every", "total")


def lines(points: DataFrame) -> DataFrame:
    """``taxi_id`` and ``coords`` of each vehicle with two points or more."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"]))
    return points.groupBy("taxi_id").agg(line.alias("coords")).where(F.size("coords") >= 2)


def subsample_chain(chain, most: int):
    """Keeps a chain's ends and about ``most`` of its inner members."""
    inner = F.size(chain) - 2
    step = F.greatest(F.lit(1), F.floor(inner / max(1, most - 1)))
    return F.when(F.size(chain) <= most + 1, chain).otherwise(F.filter(chain, lambda x, i: (i == 0) | (i == F.size(chain) - 1) | ((i - 1) % step == 0)))


def snap_to_road(vehicle_lines: DataFrame, edges: DataFrame, node_table: DataFrame, keyframe: int = SNAP_KEYFRAME, most: int = SNAP_SEGMENTS, period: int = 2) -> DataFrame:
    """``taxi_id``, ``coords``, ``snapped``: lines led over the road graph between key places.

    Every ``keyframe``-th place and the last is taken to its nearest node; routes between these, without
    collinear places, follow each other and share their joints.  A hop that can't be made gives its
    first node's place.  Lines with fewer than two places to draw stay as they are.
    """
    n = F.size("coords")
    keys = F.posexplode(F.filter("coords", lambda p, i: (i % keyframe == 0) | (i == n - 1)))
    places = vehicle_lines.select("taxi_id", keys.alias("at", "p")).select(F.struct("taxi_id", "at").alias("place"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
    found = nearest_node(places, node_table).select("place.taxi_id", "place.at", "node")
    chain = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])
    chains = found.groupBy("taxi_id").agg(chain.alias("all"))
    chains = chains.withColumn("chain", F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))))
    chains = chains.withColumn("chain", subsample_chain(F.col("chain"), most)).where(F.size("chain") >= 2)
    hops = chains.select("taxi_id", F.posexplode(F.expr("transform(sequence(0, size(chain) - 2), i -> named_struct('start', chain[i], 'end', chain[i + 1]))")).alias("hop", "h"))
    hops = hops.select("taxi_id", "hop", "h.start", "h.end", F.lit(period).alias("period"))
    routes = route_coords(fastest_routes(edges, hops), node_table).withColumn("part", simplify(F.col("coords")))
    firsts = node_table.select(F.col("node").alias("start"), F.array(F.array("lon", "lat")).alias("only"))
    legs = hops.join(routes.select("start", "end", "period", "part"), ["start", "end", "period"], "left").join(firsts, "start", "left")
    joint = F.when(F.col("hop") == 0, F.col("part")).otherwise(F.slice("part", 2, F.greatest(F.size("part"), F.lit(1))))
    legs = legs.withColumn("leg", F.coalesce(joint, "only"))
    merged = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hop", "leg"))), lambda x: x["leg"]))
    snapped = legs.groupBy("taxi_id").agg(merged.alias("road")).where(F.size("road") >= 2)
    out = vehicle_lines.join(snapped, "taxi_id", "left")
    return out.select("taxi_id", F.coalesce("road", "coords").alias("coords"), F.col("road").isNotNull().alias("snapped"))
