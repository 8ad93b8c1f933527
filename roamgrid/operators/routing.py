"""Fastest routes over the road graph."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, COMPARE_NEAREST, GRID_SIZE, NODE_BUCKET, REGION_NEAREST, Rect
from roamgrid.functions.grid import cell_range, center_lat, center_lon, grid_id, haversine, in_rect, steps
from roamgrid.operators import neighbours
from roamgrid.plans.storage import delete_path, new_path, written

#: Edges up to this number are broadcast: what a grid of 500 cells a side can have, in three periods.
BROADCAST_EDGES = 8 * 500 * 500 * 3


class Roads:
    """Adjacency of the nodes in each period."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, period: np.ndarray, seconds: np.ndarray):
        self.names = np.unique(np.concatenate([src, dst]))
        self.of_period = {}
        for p in np.unique(period):
            k = period == p
            s, d, w = np.searchsorted(self.names, src[k]), np.searchsorted(self.names, dst[k]), seconds[k]
            order = np.argsort(s, kind="stable")
            self.of_period[int(p)] = np.searchsorted(s[order], np.arange(len(self.names) + 1)), d[order], w[order]

    def fastest(self, start: int, ends: set[int], period: int) -> dict[int, tuple[float, list[int]]]:
        """Seconds and nodes of the fastest route to each of ``ends`` that can be reached."""
        at = np.searchsorted(self.names, [start, *ends])
        known = {int(n): int(i) for n, i in zip([start, *ends], at) if i < len(self.names) and self.names[i] == n}
        if start not in known:
            return {}
        wanted = {known[e] for e in ends if e in known}
        graph = self.of_period.get(period) or self.of_period.get(2)
        if graph is None:
            return {}
        begins, heads, weights = graph
        best, before, done, found = {known[start]: 0.0}, {}, set(), {}
        queue = [(0.0, known[start])]
        while queue and len(found) < len(wanted):
            seconds, node = heapq.heappop(queue)
            if node in done:
                continue
            done.add(node)
            if node in wanted:
                route = [node]
                while route[-1] in before:
                    route.append(before[route[-1]])
                found[int(self.names[node])] = seconds, [int(self.names[i]) for i in reversed(route)]
            legs = slice(begins[node], begins[node + 1])
            for nxt, leg in zip(heads[legs].tolist(), weights[legs].tolist()):
                t = seconds + leg
                known_time = best.get(nxt, math.inf)
                if t < known_time:
                    best[nxt], before[nxt] = t, node
                    heapq.heappush(queue, (t, nxt))
                elif t == known_time and nxt in before and node < before[nxt]:
                    before[nxt] = node
        return found


def fastest_routes(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``start``, ``end``, ``period``, ``seconds``, ``route`` for each request that can be met.

    ``edges``: src, dst, period, seconds; ``requests``: start, end, period.  Requests of one start and
    period share one search.  Of equal times the smaller node before each counts.  The grid bounds the graph, so it is
    broadcast after its size was checked; a larger one is refused, for which ``relaxed`` is made.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("period").cast("int"), F.col("seconds").cast("double"))
    table = edges.limit(BROADCAST_EDGES + 1).toArrow()
    if table.num_rows > BROADCAST_EDGES:
        raise ValueError("too many edges to broadcast; use relaxed()")
    roads = spark.sparkContext.broadcast(Roads(*(table.column(i).to_numpy() for i in range(4))))

    def run(batches):
        for b in batches:
            rows = []
            for start, period, ends in zip(*(b.column(i).to_pylist() for i in range(3))):
                for end, (seconds, route) in roads.value.fastest(start, set(ends), period).items():
                    rows.append({"start": start, "end": end, "period": period, "seconds": seconds, "route": route})
            kind = pa.schema([("start", pa.int64()), ("end", pa.int64()), ("period", pa.int32()), ("seconds", pa.float64()), ("route", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(rows, kind)

    asked = requests.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("period").cast("int").alias("period")).distinct()
    searches = asked.groupBy("start", "period").agg(F.collect_set("end").alias("ends"))
    return searches.mapInArrow(run, "start long, end long, period int, seconds double, route array<long>")


def relaxed(edges: DataFrame, sources: DataFrame, hops: int = 4) -> DataFrame:
    """``start``, ``node``, ``period``, ``seconds`` of all nodes that the sources reach, for graphs of any size.

    ``sources``: start, period.  A step extends the distances that the last one lowered; after some
    steps the distances are written to the shared folder.
    """
    spark = edges.sparkSession
    legs = edges.select(F.col("src").alias("node"), "dst", "period", F.col("seconds").alias("leg"))
    best = sources.select("start", "period", F.col("start").alias("node"), F.lit(0.0).alias("seconds"), F.lit(True).alias("fresh"))
    old = None
    while True:
        path = new_path(spark, "distances")
        best.write.parquet(path)
        best = spark.read.parquet(path)
        if old:
            delete_path(spark, old)
        old = path
        if best.where("fresh").isEmpty():
            return best.drop("fresh")
        for _ in range(hops):
            onward = best.where("fresh").join(legs, ["node", "period"])
            onward = onward.select("start", "period", F.col("dst").alias("node"), (F.col("seconds") + F.col("leg")).alias("seconds"), F.lit(True).alias("fresh"))
            # of equal times the known one stays, so that nothing is fresh twice
            every = best.withColumn("fresh", F.lit(False)).unionByName(onward)
            best = every.groupBy("start", "period", "node").agg(F.min(F.struct("seconds", "fresh")).alias("m")).select("start", "period", "node", "m.seconds", "m.fresh")


def predecessors(edges: DataFrame, best: DataFrame) -> DataFrame:
    """``start``, ``period``, ``node``, ``before``: the smallest node that a fastest route comes from, for all nodes but starts.

    ``best``: least times as ``relaxed`` gives them, of which each is the sum that its edge made.
    """
    legs = edges.select(F.col("src").alias("before"), F.col("dst").alias("node"), "period", F.col("seconds").alias("leg"))
    onward = best.select("start", "period", F.col("node").alias("before"), F.col("seconds").alias("so_far")).join(legs, ["before", "period"])
    onward = onward.where("node <> start").select("start", "period", "node", "before", (F.col("so_far") + F.col("leg")).alias("seconds"))
    return onward.join(best.select("start", "period", "node", "seconds"), ["start", "period", "node", "seconds"]).groupBy("start", "period", "node").agg(F.min("before").alias("before"))


def routes(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``start``, ``end``, ``period``, ``seconds``, ``route`` for each request that can be met, for graphs of any size.

    Least times by ``relaxed``, then routes by pointer doubling: tables of the node 1, 2, 4 ... steps before are
    made by joins, and from the end a route is filled in from the longest step to the shortest, so a route of n
    nodes takes log n joins.  All tables are in the shared folder; no edge comes to the driver.  The same routes
    as ``fastest_routes``; a period without edges counts as the off-peak one.
    """
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("period").cast("int").alias("period"), F.col("seconds").cast("double").alias("seconds"))
    there = edges.select("period").distinct().withColumn("used", F.col("period"))
    asked = requests.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("period").cast("int").alias("period")).distinct()
    asked = written(asked.join(there, "period", "left").withColumn("used", F.coalesce("used", F.lit(2))), "asked")
    known = edges.select(F.col("src").alias("start")).unionByName(edges.select(F.col("dst").alias("start"))).distinct()
    sources = asked.select("start", F.col("used").alias("period")).distinct().join(known, "start", "left_semi")
    best = relaxed(edges, sources)
    met = asked.join(best.select("start", F.col("period").alias("used"), F.col("node").alias("end"), "seconds"), ["start", "used", "end"])
    jumps = [written(predecessors(edges, best), "before")]
    while True:
        far = jumps[-1].select("start", "period", F.col("node").alias("before"), F.col("before").alias("further"))
        longer = written(jumps[-1].join(far, ["start", "period", "before"]).select("start", "period", "node", F.col("further").alias("before")), "before")
        if longer.isEmpty():
            break
        jumps.append(longer)
    places = met.select("start", "used", "end").distinct().select("start", "used", "end", F.col("end").alias("node"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        jump = jumps[k].withColumnRenamed("period", "used")
        onward = places.join(jump, ["start", "used", "node"]).select("start", "used", "end", F.col("before").alias("node"), (F.col("back") + 2**k).alias("back"))
        places = written(places.unionByName(onward), "places")
    route = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "node"))), lambda x: x["node"])
    return met.join(places.groupBy("start", "used", "end").agg(route.alias("route")), ["start", "used", "end"]).select("start", "end", "period", "seconds", "route")


def nearest_node(places: DataFrame, node_table: DataFrame) -> DataFrame:
    """``places`` (with a unique ``place``, lon, lat) and their nearest ``node`` and ``meters``.

    Nodes in the 5 x 5 buckets of a hundredth of a degree around a place are compared; places with none there
    are led to the nearest of all nodes (``neighbours.nearest``).  Ties go to the smaller node.  Each bucket
    gathers its nodes once, and places of the same coordinates are looked up as one; places without
    coordinates are left out.
    """
    bucket = lambda c: F.floor(c / NODE_BUCKET)
    around = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(-2, 3) for y in range(-2, 3)]
    held = node_table.select("node", F.col("lon").alias("node_lon"), F.col("lat").alias("node_lat"), bucket(F.col("lon")).alias("nx"), bucket(F.col("lat")).alias("ny"))
    spots = places.where("lon is not null and lat is not null").select("lon", "lat").distinct()
    spots = spots.withColumn("bx", bucket(F.col("lon"))).withColumn("by", bucket(F.col("lat")))
    reach = spots.select("bx", "by").distinct().withColumn("o", F.explode(F.array(*around)))
    reach = reach.select("bx", "by", (F.col("bx") + F.col("o.x")).alias("nx"), (F.col("by") + F.col("o.y")).alias("ny")).join(held, ["nx", "ny"])
    metres = haversine(F.col("lon"), F.col("lat"), F.col("node_lon"), F.col("node_lat")).alias("meters")
    near = spots.join(reach, ["bx", "by"]).select("lon", "lat", "node", metres).groupBy("lon", "lat").agg(F.min(F.struct("meters", "node")).alias("m"))
    near = written(near.select("lon", "lat", "m.node", "m.meters"), "near")
    far = spots.join(near, ["lon", "lat"], "left_anti").select(F.struct("lon", "lat").alias("place"), "lon", "lat")
    if not far.isEmpty():
        near = near.unionByName(neighbours.nearest(far, node_table).select("place.lon", "place.lat", "node", "meters"))
    return places.join(near, ["lon", "lat"]).select(*places.columns, "node", "meters")


def nearest_node_in(node_table: DataFrame, rect: Rect, lon: float, lat: float) -> DataFrame:
    """``node`` and ``meters``: the node of a closed rectangle nearest to a place, if it holds any."""
    inside = node_table.where(in_rect(F.col("lon"), F.col("lat"), rect))
    return inside.select("node", haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")).alias("meters")).orderBy("meters", "node").limit(1)


def border(rect: Rect, away_from: Rect | None = None, size: int = GRID_SIZE) -> list[int]:
    """The border of the cells whose centre is in the closed rectangle.

    With ``away_from`` the side that faces away from that rectangle along the larger offset of the
    centres is left out, if there are more than four cells and some remain.
    """
    x0, x1, y0, y1 = cell_range(rect, size)
    dx, dy = steps(size)
    middle = lambda low, step, i: ((low + i * step) + (low + (i + 1) * step)) / 2
    xs = [x for x in range(x0, x1 + 1) if rect.x_min <= middle(BOUNDS.x_min, dx, x) <= rect.x_max]
    ys = [y for y in range(y0, y1 + 1) if rect.y_min <= middle(BOUNDS.y_min, dy, y) <= rect.y_max]
    if not xs or not ys:
        return []
    edge = {(x, y) for x in (xs[0], xs[-1]) for y in ys} | {(x, y) for x in xs for y in (ys[0], ys[-1])}
    if away_from is not None and len(edge) > 4:
        across, up = (o - c for o, c in zip(away_from.center, rect.center))
        if abs(across) > abs(up):
            far, at = (xs[0] if across > 0 else xs[-1]), 0
        else:
            far, at = (ys[0] if up > 0 else ys[-1]), 1
        edge = {c for c in edge if c[at] != far} or edge
    return sorted(y * size + x for x, y in edge)


def edge_cells(spark, rect: Rect, away_from: Rect | None = None, size: int = GRID_SIZE) -> DataFrame:
    """``gid``, ``lon`` and ``lat`` of the cells of ``border``, of which the grid bounds the number."""
    cells = spark.createDataFrame([(g,) for g in border(rect, away_from, size)], "gid long")
    return cells.select("gid", center_lon(F.col("gid"), size).alias("lon"), center_lat(F.col("gid"), size).alias("lat"))


def nearest_centers(of: DataFrame, among: DataFrame, k: int) -> DataFrame:
    """``gid``, ``other``, ``degrees``, ``rank``: for each cell the k nearest of another set of cells.

    Both sets are cells of a region, which the grid bounds.  Ties go to the smaller cell.
    """
    pairs = of.crossJoin(F.broadcast(among.select(F.col("gid").alias("other"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))))
    degrees = F.sqrt((F.col("lon2") - F.col("lon")) * (F.col("lon2") - F.col("lon")) + (F.col("lat2") - F.col("lat")) * (F.col("lat2") - F.col("lat")))
    rank = F.row_number().over(Window.partitionBy("gid").orderBy("degrees", "other"))
    return pairs.withColumn("degrees", degrees).withColumn("rank", rank).where(F.col("rank") <= k).select("gid", "other", "degrees", "rank")


def _candidates(spark, a: Rect, b: Rect, k: int, node_table: DataFrame, size: int) -> DataFrame:
    """``start_grid``, ``end_grid``, ``start``, ``end``: the pairs of cells that are tried and their nodes."""
    first, second = edge_cells(spark, a, b, size), edge_cells(spark, b, a, size)
    n1, n2 = len(border(a, b, size)), len(border(b, a, size))
    k = min(k, max(n1, n2))
    if n1 <= n2:
        pairs = nearest_centers(first, second, k).select(F.col("gid").alias("start_grid"), F.col("other").alias("end_grid"))
    else:
        pairs = nearest_centers(second, first, k).select(F.col("other").alias("start_grid"), F.col("gid").alias("end_grid"))
    places = first.unionByName(second).distinct().withColumnRenamed("gid", "place")
    at = nearest_node(places, node_table).select("place", "node")
    return pairs.join(at.select(F.col("place").alias("start_grid"), F.col("node").alias("start")), "start_grid").join(at.select(F.col("place").alias("end_grid"), F.col("node").alias("end")), "end_grid")


def region_route(edges: DataFrame, node_table: DataFrame, a: Rect, b: Rect, period: int, k: int = REGION_NEAREST, size: int = GRID_SIZE) -> DataFrame:
    """One row: ``start_grid``, ``end_grid``, ``seconds``, ``route``, ``searched`` pairs, from region to region.

    The least time over the border cells of the smaller region and the k nearest of the other's.
    """
    pairs = _candidates(edges.sparkSession, a, b, k, node_table, size)
    found = fastest_routes(edges, pairs.select("start", "end", F.lit(int(period)).alias("period")))
    best = F.min(F.struct("seconds", "start_grid", "end_grid", "route")).alias("m")
    met = pairs.join(found, ["start", "end"]).agg(best)
    return met.crossJoin(pairs.agg(F.count("*").alias("searched"))).select("m.start_grid", "m.end_grid", "m.seconds", "m.route", "searched").where("seconds is not null")


def compare_regions(edges: DataFrame, node_table: DataFrame, a: Rect, b: Rect, k: int = COMPARE_NEAREST, size: int = GRID_SIZE) -> DataFrame:
    """``period``, ``seconds``: the least time above 0 in each period, over each border cell of A and the k nearest of B's."""
    spark = edges.sparkSession
    first, second = edge_cells(spark, a, b, size), edge_cells(spark, b, a, size)
    pairs = nearest_centers(first, second, k)
    at = nearest_node(first.unionByName(second).distinct().withColumnRenamed("gid", "place"), node_table).select("place", "node")
    asked = pairs.join(at.select(F.col("place").alias("gid"), F.col("node").alias("start")), "gid").join(at.select(F.col("place").alias("other"), F.col("node").alias("end")), "other")
    asked = asked.select("start", "end").distinct().withColumn("period", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return fastest_routes(edges, asked).where("seconds > 0").groupBy("period").agg(F.min("seconds").alias("seconds"))


def endpoint(node_table: DataFrame, place: tuple[float, float] | Rect) -> DataFrame:
    """One row, ``node`` and ``meters``: the node nearest to a place; for a rectangle the one in it that
    is nearest to its centre, or, if it holds none, the one nearest to its centre at all."""
    lon, lat = place.center if isinstance(place, Rect) else place
    spark = node_table.sparkSession
    anywhere = nearest_node(spark.createDataFrame([(0, float(lon), float(lat))], "place int, lon double, lat double"), node_table).select("node", "meters", F.lit(1).alias("order"))
    if not isinstance(place, Rect):
        return anywhere.drop("order")
    inside = nearest_node_in(node_table, place, lon, lat).withColumn("order", F.lit(0))
    return inside.unionByName(anywhere).orderBy("order").limit(1).drop("order")


def edge_seconds(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (src, dst, period) with ``seconds``; of a pair without that period those of the off-peak
    one, infinity for a pair that is no edge."""
    of = edges.groupBy("src", "dst").agg(F.map_from_entries(F.collect_list(F.struct("period", "seconds"))).alias("times"))
    out = asked.join(of, ["src", "dst"], "left")
    return out.withColumn("seconds", F.coalesce(F.element_at("times", F.col("period")), F.element_at("times", F.lit(2)), F.lit(float("inf")))).drop("times")


def route_cells(routes: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """``routes`` with ``cells``, the cells of their ``coords`` without those outside and without repeats in a row."""
    cells = F.filter(F.transform("coords", lambda c: grid_id(c[0], c[1], size)), lambda g: g != -1)
    return routes.withColumn("cells", cells).withColumn("cells", F.filter("cells", lambda g, i: (i == 0) | (F.get("cells", i - 1) != g)))


def route_coords(routes: DataFrame, node_table: DataFrame) -> DataFrame:
    """``routes`` with ``coords``, the centres of their nodes in order."""
    steps = routes.select("start", "end", "period", F.posexplode("route").alias("at", "node")).join(node_table.select("node", "lon", "lat"), "node")
    line = F.transform(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))), lambda x: F.array(x["lon"], x["lat"]))
    return routes.join(steps.groupBy("start", "end", "period").agg(line.alias("coords")), ["start", "end", "period"])


def time_text(seconds):
    """Minutes with one decimal above a minute, else whole seconds."""
    return F.when(seconds > 60, F.format_string("%.1f min", seconds / 60)).otherwise(F.format_string("%d s", F.bround(seconds).cast("long")))
