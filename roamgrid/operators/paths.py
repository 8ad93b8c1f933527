"""Frequent paths: cell sequences of trips and how many vehicles begin a trip with them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.config import EXEMPLAR_POINTS, PATH_DEPTH_BETWEEN, VALID_BOX, Rect
from roamgrid.functions.grid import center_lat, center_lon, grid_id, haversine, in_cells, in_rect
from roamgrid.operators import trips
from roamgrid.plans.storage import written

VEHICLE_POINTS, TRIP_POINTS, PATH_CELLS = 5, 3, 2


def long_trips(points: DataFrame) -> DataFrame:
    """Points of trips long enough, of vehicles with enough points, with their cell."""
    enough = F.count("*").over(Window.partitionBy("taxi_id"))
    kept = points.withColumn("of_vehicle", enough).where(F.col("of_vehicle") >= VEHICLE_POINTS).drop("of_vehicle")
    return trips.split(kept, TRIP_POINTS).withColumn("gid", grid_id(F.col("lon"), F.col("lat")))


def sequences(points: DataFrame, dated: bool = False, cut: DataFrame | None = None) -> DataFrame:
    """``taxi_id``, ``trip_id``, ``path``: cells inside the bounds without consecutive repeats, two at least.

    With ``dated`` also ``start_ts``, the time in the first of these cells.  ``cut``: ``long_trips`` that were written.
    """
    order = Window.partitionBy("taxi_id", "trip_id").orderBy("ts", "event_id")
    inside = (long_trips(points) if cut is None else cut).where("gid <> -1").withColumn("before", F.lag("gid").over(order))
    runs = inside.where("before is null or before <> gid")
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "gid"))), lambda x: x["gid"]).alias("path")
    made = runs.groupBy("taxi_id", "trip_id").agg(path, *([F.min("ts").alias("start_ts")] if dated else []))
    return made.where(F.size("path") >= PATH_CELLS)


def complete_prefixes(paths: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``taxi_id``, ``path`` and ``more`` for the prefixes of every sequence that may be complete, and the complete ones.

    Only prefixes of lengths that some complete sequence with the same first two cells has are made;
    the others can't be complete.  ``paths`` is read twice, so pass it written or cached.
    """
    start = [F.col("path")[0].alias("c0"), F.col("path")[1].alias("c1")]
    complete = paths.select(*start, F.size("path").alias("length"), "path").distinct()
    lengths = complete.groupBy("c0", "c1").agg(F.collect_set("length").alias("lengths"))
    whole = paths.select("taxi_id", "path", *more, *start).join(lengths, ["c0", "c1"])
    wanted = F.filter("lengths", lambda n: n <= F.size("path"))
    prefixes = whole.select("taxi_id", "path", *more, F.explode(wanted).alias("length")).select("taxi_id", F.slice("path", 1, F.col("length")).alias("path"), *more)
    return prefixes, complete.select("path")


def prefix_frequency(paths: DataFrame) -> DataFrame:
    """``path``, ``vehicles``, ``trips`` for every complete sequence: how many begin a trip with it."""
    prefixes, complete = complete_prefixes(paths)
    counts = prefixes.groupBy("path", "taxi_id").agg(F.count("*").alias("trips")).groupBy("path").agg(F.count("*").alias("vehicles"), F.sum("trips").alias("trips"))
    return counts.join(complete, "path", "left_semi")


def vehicle_bitmaps(paths: DataFrame, unit: str = "DAY") -> DataFrame:
    """``path``, ``part``, ``bucket``, ``vehicles``: for each complete sequence and part of time the vehicles that
    begin a trip with it, as bitmaps of 32,768 numbers each.

    ``paths``: dated sequences, written.  Bitmaps of parts are merged by their bits, so counts over any range of
    parts are exact and no trip is read again.  A bitmap takes 4 KB before compression, whatever it holds.
    """
    prefixes, complete = complete_prefixes(paths, "start_ts")
    part = F.date_trunc(unit, F.col("start_ts")).cast("timestamp_ntz").alias("part")
    held = prefixes.join(complete, "path", "left_semi").select("path", part, F.bitmap_bucket_number("taxi_id").alias("bucket"), F.bitmap_bit_position("taxi_id").alias("position")).distinct()
    return held.groupBy("path", "part", "bucket").agg(F.bitmap_construct_agg("position").alias("vehicles"))


def vehicles_between(bitmaps: DataFrame, start: str, end: str) -> DataFrame:
    """``path`` and ``vehicles``, how many different ones in the parts from ``start`` until before ``end``."""
    inside = bitmaps.where((F.col("part") >= F.lit(start).cast("timestamp_ntz")) & (F.col("part") < F.lit(end).cast("timestamp_ntz")))
    merged = inside.groupBy("path", "bucket").agg(F.bitmap_or_agg("vehicles").alias("vehicles"))
    return merged.groupBy("path").agg(F.sum(F.bitmap_count("vehicles")).alias("vehicles"))


def path_distance(path: Column) -> Column:
    """Metres along the centres of a path's cells; 0 for fewer than two."""
    legs = F.zip_with(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: haversine(center_lon(a), center_lat(a), center_lon(b), center_lat(b)))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def path_coords(path: Column) -> Column:
    """Centres of a path's cells; numbers that are no cell are skipped."""
    return F.transform(F.filter(path, lambda g: g.between(0, 9999)), lambda g: F.array(center_lon(g), center_lat(g)))


def top_k(frequencies: DataFrame, k: int = 10, min_distance: float = 0.0, min_length: int = 2, long_paths: bool | None = None) -> DataFrame:
    """The k most frequent paths of at least a distance and a length.

    Without a distance long paths are favoured: the count is weighted by the length.  Ties: the
    larger count, the larger distance, then the path in order.
    """
    favour = min_distance <= 0 if long_paths is None else long_paths
    length = F.size("path")
    rows = frequencies.where(length >= min_length).withColumn("distance", path_distance(F.col("path"))).where(F.col("distance") >= min_distance)
    bonus = 1 + F.least(F.lit(1.25), F.log1p(F.greatest(F.lit(0), length - min_length)) * 0.18)
    rows = rows.withColumn("path_len", length).withColumn("score", F.col("vehicles") * bonus if favour else F.col("vehicles").cast("double"))
    return rows.orderBy(F.desc("score"), F.desc("vehicles"), F.desc("distance"), "path").limit(k)


def top_k_grown(paths: DataFrame, k: int = 10, min_distance: float = 0.0, min_length: int = PATH_CELLS, long_paths: bool | None = None) -> tuple[DataFrame, int]:
    """The rows of ``top_k`` over all complete sequences, by growing prefixes cell by cell, and how many prefixes were made.

    No extension of a prefix has more vehicles than it, and the weight of a length has a bound; so once k complete
    sequences are known, sequences whose prefix can't reach the k-th score go before longer prefixes are made.
    The k rows and the k-th score are all that the driver sees.
    """
    favour = min_distance <= 0 if long_paths is None else long_paths
    alive = written(paths.select("taxi_id", "path"), "alive")
    longest = alive.agg(F.max(F.size("path"))).head()[0] or 0
    weight = 1 + min(1.25, 0.18 * math.log1p(max(0, longest - min_length))) if favour else 1.0
    found, made = None, 0
    for length in range(PATH_CELLS, longest + 1):
        prefix = F.slice("path", 1, length).alias("prefix")
        made += alive.count()
        own = alive.groupBy(prefix, "taxi_id").agg(F.count("*").alias("trips"), F.max(F.size("path") == length).alias("complete"))
        sums = written(own.groupBy("prefix").agg(F.count("*").alias("vehicles"), F.sum("trips").alias("trips"), F.max("complete").alias("complete")), "prefixes")
        rows = sums.where("complete").select(F.col("prefix").alias("path"), "vehicles", "trips")
        rows = rows if found is None else rows.unionByName(found.select("path", "vehicles", "trips"))
        found = written(top_k(rows, k, min_distance, min_length, long_paths), "best")
        scores = [r.score for r in found.select("score").collect()]  # k rows at most
        least = min(scores) * (1 - 1e-9) if len(scores) == k else 0.0
        kept = sums.where(F.col("vehicles") * weight >= least).select("prefix")
        alive = written(alive.where(F.size("path") > length).withColumn("prefix", prefix).join(kept, "prefix", "left_semi").drop("prefix"), "alive")
        if alive.isEmpty():
            break
    return (top_k(prefix_frequency(paths), k) if found is None else found), made


def top_k_between(frequencies: DataFrame, a: Rect, b: Rect, k: int = 10, min_distance: float = 0.0) -> DataFrame:
    """The k most frequent paths of up to fifteen cells that begin in A and end in B."""
    ends = in_cells(F.col("path")[0], a) & in_cells(F.element_at("path", -1), b)
    return top_k(frequencies.where(ends & F.size("path").between(2, PATH_DEPTH_BETWEEN)), k, min_distance, 2, False)


def with_prefix(frequencies: DataFrame, prefix: list[int]) -> DataFrame:
    """Paths that begin with the given cells."""
    return frequencies.where(F.slice("path", 1, len(prefix)) == F.array(*map(F.lit, prefix)))


def tree_stats(paths: DataFrame) -> DataFrame:
    """``nodes`` (with the root), ``max_depth`` and ``complete`` sequences of the prefix tree."""
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("p")).distinct()
    nodes = prefixes.agg(F.count("*").alias("n"), F.max(F.size("p")).alias("d"))
    ends = paths.select("path").distinct().agg(F.count("*").alias("complete"))
    return nodes.crossJoin(ends).select((F.col("n") + 1).alias("nodes"), F.coalesce("d", F.lit(0)).cast("int").alias("max_depth"), "complete")


def display_coords(points: DataFrame, most: int = EXEMPLAR_POINTS, cut: DataFrame | None = None) -> DataFrame:
    """``taxi_id``, ``trip_id``, ``coords``: a trip's line on the map.

    Points outside the plausible box are left out, the first of each run in one cell stays, and long
    lines are thinned.  With too few points left the trip's or the plausible points' ends are taken.
    """
    at = F.array_sort(F.collect_list(F.struct("ts", "event_id", "gid", "lon", "lat")))
    rows = (long_trips(points) if cut is None else cut).groupBy("taxi_id", "trip_id").agg(at.alias("all"))
    place = lambda x: F.array(x["lon"], x["lat"])
    rows = rows.withColumn("valid", F.filter("all", lambda x: in_rect(x["lon"], x["lat"], VALID_BOX)))
    rows = rows.withColumn("inside", F.filter("valid", lambda x: x["gid"] != -1))
    runs = F.filter("inside", lambda x, i: (i == 0) | (F.get("inside", i - 1)["gid"] != x["gid"]))
    rows = rows.withColumn("runs", F.transform(runs, place))
    step = F.greatest(F.lit(1), F.floor(F.size("runs") / most))
    last = place(F.element_at("valid", -1))
    thin = F.filter("runs", lambda x, i: i % step == 0)
    thin = F.when(F.size("runs") > most, F.when(F.element_at(thin, -1) != last, F.concat(thin, F.array(last))).otherwise(thin)).otherwise(F.col("runs"))
    ends = lambda c: F.array(place(F.element_at(c, 1)), place(F.element_at(c, -1)))
    coords = F.when(F.size("valid") < 2, ends("all")).when(F.size("runs") < 2, ends("valid")).otherwise(thin)
    return rows.select("taxi_id", "trip_id", coords.alias("coords"))


def exemplars(lines: DataFrame) -> DataFrame:
    """``path`` and ``coords`` of its longest line; of equal ones the first vehicle's first trip.

    ``lines``: taxi_id, trip_id, path and coords of trips, those without a path left out.
    """
    lines = lines.where("path IS NOT NULL")
    rank = F.struct(F.size("coords").alias("n"), (-F.col("taxi_id")).alias("v"), (-F.col("trip_id")).alias("t"))
    return lines.groupBy("path").agg(F.max_by("coords", rank).alias("coords"))


def vehicles_of(frequencies: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` paths with their ``vehicles``, 0 for a path that no trip begins with."""
    return asked.join(frequencies.select("path", "vehicles"), "path", "left").withColumn("vehicles", F.coalesce("vehicles", F.lit(0)))
