"""Cells of halved squares: split only where points are many, and boxes answered from them.

A cell of level ``l`` is ``2 ** (8 - l)`` degrees wide, so whether a point lies in it is exact: dividing by a power
of two rounds nothing.  A cell's parent has half its numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, Rect
from roamgrid.plans.storage import written

#: Level of the finest cells, about 1.5 metres wide; level 0 has four cells around longitude and latitude 0.
DEEPEST = 24
ROOT_WIDTH = 256.0
#: Points of a cell that is not split, by default, and rows of a table that is broadcast.
CAPACITY, BROADCAST_CELLS = 10, 100_000
#: Boxes that meet a part of the vehicles in one task, boxes that are looked up at a time, and bytes of bits in a task.
PART_BOXES, BOX_BLOCK, MOST_BITS = 250_000, 1_000, 64_000_000


def width(level: Column) -> Column:
    return F.lit(ROOT_WIDTH) / F.pow(F.lit(2.0), level.cast("double"))


def with_cell(points: DataFrame, level: int = DEEPEST) -> DataFrame:
    """``points`` with ``cx`` and ``cy`` of a level's cells; points without finite coordinates are left out."""
    number = lambda c: F.floor(F.col(c) / F.lit(ROOT_WIDTH / 2**level)).cast("long")
    known = [F.col(c).isNotNull() & (F.abs(c) < ROOT_WIDTH) for c in ("lon", "lat")]
    return points.where(known[0] & known[1]).withColumn("cx", number("lon")).withColumn("cy", number("lat"))


def with_cell_of(points: DataFrame, box: Rect = BOUNDS, depth: int = 16) -> DataFrame:
    """Points of a half-open box with ``cx`` and ``cy``, ``2 ** depth`` cells to a side of the box."""
    n = 2**depth
    inside = points.where((F.col("lon") >= box.x_min) & (F.col("lon") < box.x_max) & (F.col("lat") >= box.y_min) & (F.col("lat") < box.y_max))
    part = lambda c, low, high: F.least(F.floor((F.col(c) - low) / F.lit((high - low) / n)), F.lit(n - 1)).cast("long")
    return inside.withColumn("cx", part("lon", box.x_min, box.x_max)).withColumn("cy", part("lat", box.y_min, box.y_max))


def adaptive(points: DataFrame, capacity: int = CAPACITY, depth: int = DEEPEST) -> DataFrame:
    """``level``, ``cx``, ``cy``, ``n``, ``leaf``: cells of the levels 0 to ``depth``, split while they hold more than ``capacity``.

    ``points`` have cx and cy of the deepest level.  Points of one finest cell are counted first, so what is
    counted for every level are cells; a cell stands if the one above it holds too many.  No cells for no points.
    """
    finest = points.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    every = finest.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "cx", "cy", "n")
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    sums = written(every.groupBy("level", up("cx").alias("cx"), up("cy").alias("cy")).agg(F.sum("n").alias("n")), "cell_sums")
    split = sums.where((F.col("n") > capacity) & (F.col("level") < depth)).select((F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    below = sums.withColumn("px", F.shiftright("cx", 1)).withColumn("py", F.shiftright("cy", 1)).join(split, ["level", "px", "py"], "left_semi")
    standing = sums.where("level = 0").unionByName(below.select("level", "cx", "cy", "n"))
    return standing.withColumn("leaf", (F.col("n") <= capacity) | (F.col("level") == depth))


def tree_stats(cells: DataFrame) -> DataFrame:
    """One row: ``nodes``, ``leaves`` (with empty ones), ``points``, ``depth`` of a tree with four cells below each split one."""
    sums = cells.agg(F.count_if(~F.col("leaf")).alias("s"), F.sum(F.when(F.col("leaf"), F.col("n"))).alias("p"), F.max("level").alias("d"))
    return sums.select((4 * F.col("s") + 1).alias("nodes"), (3 * F.col("s") + 1).alias("leaves"), F.coalesce("p", F.lit(0)).alias("points"), F.coalesce("d", F.lit(0)).alias("depth"))


def count_boxes(points: DataFrame, boxes: DataFrame, vehicles: int = 4_096) -> DataFrame:
    """``box``, ``points`` and ``taxis``: rows and vehicles in each of many closed boxes.

    ``boxes``: box (unique), x_min, y_min, x_max, y_max.  Boxes of the same edges are one, and points alike in
    place and vehicle are one row with their number.  Vehicles are dealt into parts of about ``vehicles``, boxes
    into parts of ``PART_BOXES``; a part of each meets in one task, where vehicles are bits, so what leaves it is
    one row for each box, and no pair of a box and a vehicle is ever a row.  A vehicle is in one part only, so
    the parts' counts add up.  Boxes with null or crossed edges, and tables without points, count nothing: 0 and 0.
    """
    alike = with_cell(points).groupBy("lon", "lat", "taxi_id").agg(F.count("*").alias("n"))
    alike = written(alike, "alike")
    edges = ["x_min", "y_min", "x_max", "y_max"]
    # as in a comparison, what is no number lies above all
    known = boxes.select("box", *(F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))).alias(c) for c in edges)).where("x_min <= x_max and y_min <= y_max")
    asked = written(known.select(edges).distinct().select(F.monotonically_increasing_id().alias("number"), *edges), "asked_boxes")
    held = alike.groupBy("taxi_id").agg(F.count("*").alias("rows")).agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).head()
    places = alike.select("lon", "lat").distinct().count()
    while vehicles > 1 and min(places, vehicles * held[1] / max(1, held[0])) * vehicles / 4 > MOST_BITS:
        vehicles //= 2
    parts, spans = max(1, -(-held[0] // vehicles)), max(1, -(-asked.count() // PART_BOXES))
    there = alike.withColumn("part", F.pmod(F.xxhash64("taxi_id"), F.lit(parts)).cast("int")).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    every = asked.withColumn("span", F.pmod(F.xxhash64("number"), F.lit(spans)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    counted = every.groupBy("part", "span").cogroup(there.groupBy("part", "span")).applyInArrow(_in_boxes, "number long, points long, taxis long")
    answers = counted.groupBy("number").agg(F.sum("points").alias("points"), F.sum("taxis").alias("taxis")).join(asked, "number")
    found = known.join(answers, edges).select("box", "points", "taxis")
    return boxes.select("box").join(found, "box", "left").select("box", F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("taxis", F.lit(0)).alias("taxis"))


def _in_boxes(boxes: pa.Table, points: pa.Table) -> pa.Table:
    """Points and vehicles of one part in the boxes of another.

    Places are halved by longitude and latitude in turn down to single ones; every half has its extent, its
    points and its vehicles as bits.  A box takes those halves whole that lie in it, and looks into those it cuts.
    """
    edges = np.stack([boxes.column(c).to_numpy() for c in ("x_min", "y_min", "x_max", "y_max")], 1).reshape(-1, 4)
    total, taxis = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64)
    if points.num_rows and len(edges):
        levels = _halves(points)
        for at in range(0, len(edges), BOX_BLOCK):
            total[at : at + BOX_BLOCK], taxis[at : at + BOX_BLOCK] = _counted(edges[at : at + BOX_BLOCK], levels)
    return pa.table({"number": boxes.column("number"), "points": total, "taxis": taxis})


def _halves(points: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Extents (least and largest longitude and latitude), points and vehicles' bits of the halves of each level, the whole first."""
    at = np.stack([points.column("lon").to_numpy(), points.column("lat").to_numpy()], 1)
    places, place = np.unique(at, axis=0, return_inverse=True)
    place = place.reshape(-1)
    depth = max(0, int(len(places) - 1).bit_length())
    order = np.arange(len(places))
    halves = np.zeros(len(places), np.int64)
    for level in range(depth):  # each half by rank in its own order, as even as can be
        order = order[np.lexsort((places[order, level % 2], halves[order]))]
        begins = np.searchsorted(halves[order], halves[order])
        sizes = np.bincount(halves, minlength=2**level)[halves[order]]
        halves[order] = 2 * halves[order] + (np.arange(len(order)) - begins >= (sizes + 1) // 2)
    known = np.asarray(points.column("taxi_id").is_valid())
    names, vehicle = np.unique(points.column("taxi_id").fill_null(0).to_numpy(), return_inverse=True)
    extent = np.full((2**depth, 4), [np.inf, np.inf, -np.inf, -np.inf])
    extent[halves] = places[:, [0, 1, 0, 1]]
    n = np.zeros(2**depth, np.int64)
    np.add.at(n, halves[place], points.column("n").to_numpy())
    bits = np.zeros((2**depth, -(-len(names) // 64)), np.uint64)
    np.bitwise_or.at(bits, (halves[place[known]], vehicle[known] // 64), np.uint64(1) << (vehicle[known] % 64).astype(np.uint64))
    levels = [(extent, n, bits)]
    for _ in range(depth):
        e, n, bits = levels[-1]
        e = np.concatenate([np.minimum(e[::2, :2], e[1::2, :2]), np.maximum(e[::2, 2:], e[1::2, 2:])], 1)
        levels.append((e, n[::2] + n[1::2], bits[::2] | bits[1::2]))
    return levels[::-1]


def _counted(edges: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """Points and vehicles in each of some boxes."""
    total, seen = np.zeros(len(edges), np.int64), np.zeros((len(edges), levels[0][2].shape[1]), np.uint64)
    box, half = np.arange(len(edges)), np.zeros(len(edges), np.int64)
    for extent, n, bits in levels:
        x0, y0, x1, y1 = extent[half].T
        a0, b0, a1, b1 = edges[box].T
        inside = (a0 <= x0) & (x1 <= a1) & (b0 <= y0) & (y1 <= b1) & (x0 <= x1)
        cut = (x0 <= a1) & (a0 <= x1) & (y0 <= b1) & (b0 <= y1) & ~inside
        own, whole = box[inside], half[inside]
        np.add.at(total, own, n[whole])
        turn = np.arange(len(own)) - np.searchsorted(own, own)  # boxes ascend: the k-th half of each is taken at once
        for some in np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1]) if len(own) else ():
            seen[own[some]] |= bits[whole[some]]
        box, half = np.repeat(box[cut], 2), np.stack([2 * half[cut], 2 * half[cut] + 1], 1).reshape(-1)
    return total, np.bitwise_count(seen).sum(1, dtype=np.int64)


def trip_boxes(trips: DataFrame) -> DataFrame:
    """``taxi_id``, ``trip_id``, ``box`` and the edges of the box around each trip's points."""
    box = trips.groupBy("taxi_id", "trip_id").agg(F.min("lon").alias("x_min"), F.min("lat").alias("y_min"), F.max("lon").alias("x_max"), F.max("lat").alias("y_max"))
    return box.withColumn("box", F.concat_ws("/", "taxi_id", "trip_id"))
