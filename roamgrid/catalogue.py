"""Every registered query of the trajectory engine: a callable of (spark, sf_dir)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, EXPAND_RATIOS, Rect
from roamgrid.functions.grid import grid_bounds, grid_id, haversine, intensity_color, period_name, period_of
from roamgrid.operators import cells, density, display, neighbours, od, paths, polyline, regions, road, routing, stats, trajectory, trips, upkeep, viewport
from roamgrid.plans.storage import new_path, written
from roamgrid.sources.points import from_events, scan, stride_sample, vehicle_page, vehicles
from roamgrid.streaming import live

A, B, C, OUT = Rect(116.30, 39.60, 116.45, 39.75), Rect(116.45, 39.65, 116.65, 39.85), Rect(116.40, 39.70, 116.50, 39.76), Rect(115.0, 39.0, 115.5, 39.2)
RECTS = {"A": A, "B": B, "C": C, "OUT": OUT}
START, END = 3132, 5960
#: Number, centre, zoom, width and height of some map views.
VIEWS = [(1, 116.45, 39.70, 11.0, 1200, 800), (2, 116.40, 39.75, 9.5, 1200, 800), (3, 116.50, 39.72, 13.5, 800, 600)]

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def _on_points(f: Callable[[DataFrame], DataFrame]) -> Callable:
    """Registers a query that takes the points derived from the events."""
    _queries[f.__name__] = lambda spark, sf_dir: f(from_events(spark, sf_dir))
    return f


def _on_matrix(f: Callable[[DataFrame], DataFrame]) -> Callable:
    """Registers a query that takes the origin-destination matrix."""
    _queries[f.__name__] = lambda spark, sf_dir: f(od.matrix(from_events(spark, sf_dir)))
    return f


def queries() -> dict[str, Query]:
    return dict(_queries)


def _rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@_on_points
def points_scan(p):
    return scan(p)


@_on_points
def points_bbox_half_open(p):
    return scan(p, BOUNDS.expanded(0.05)).select("event_id", "lon", "lat")


@_on_points
def points_stride_sample(p):
    return scan(p, stride=15).select("event_id", "taxi_id")


@_on_points
def vehicle_list(p):
    return vehicles(p)


@_on_points
def vehicle_page_of_ten(p):
    return vehicle_page(p, 10)


@_on_points
def vehicle_trajectory(p):
    return trajectory.of_vehicle(p, 3).select("seq", "event_id", "ts", "lon", "lat")


@_on_points
def trajectory_all_strided(p):
    return trajectory.strided(p).select("taxi_id", "rn", "event_id", "lon", "lat")


@_on_points
def trajectory_capped(p):
    return trajectory.capped(trajectory.first_vehicles(p, 30), 5, 15).select("taxi_id", "rn", "event_id")


@_on_points
def period_histogram(p):
    return p.groupBy(period_of(F.col("ts")).alias("period")).agg(F.count("*").alias("n"))


@_on_points
def period_labels(p):
    return p.select(period_name(period_of(F.col("ts"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@_on_points
def grid_id_projection(p):
    return p.select("event_id", grid_id(F.col("lon"), F.col("lat")).alias("gid"))


@_on_points
def grid_bounds_of_cells(p):
    cells = p.select(grid_id(F.col("lon"), F.col("lat")).alias("gid")).where("gid <> -1").distinct()
    return cells.select("gid", grid_bounds(F.col("gid")).alias("b")).select("gid", "b.x_min", "b.y_min", "b.x_max", "b.y_max")


def _trip_rects(p):
    """Boxes around the points in bounds of every trip."""
    return cells.trip_boxes(trips.split(scan(p)))


@_on_points
def rect_to_grids(p):
    """The cells of every trip's box, and of some rectangles of which one is out of bounds."""
    named = p.sparkSession.createDataFrame([(n, *map(float, r)) for n, r in RECTS.items()], "rect string, x_min double, y_min double, x_max double, y_max double")
    return regions.rect_cells(_trip_rects(p).select(F.col("box").alias("rect"), "x_min", "y_min", "x_max", "y_max").unionByName(named))


@_on_points
def many_boxes(p):
    """Points and vehicles in the box around every trip."""
    return cells.count_boxes(p, _trip_rects(p))


@_on_points
def adaptive_density_cells(p):
    found = cells.adaptive(cells.with_cell_of(p), depth=16)
    return found.where("leaf").select("level", "cx", "cy", "n")


@_on_points
def quadtree_stats(p):
    return cells.tree_stats(cells.adaptive(cells.with_cell_of(p), depth=16))


@_on_points
def haversine_steps(p):
    w = trips.in_time()
    before = p.withColumn("lon0", F.lag("lon").over(w)).withColumn("lat0", F.lag("lat").over(w)).where("lon0 is not null")
    return before.select("event_id", F.round(haversine(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")), 3).alias("meters"))


@_on_points
def region_point_count(p):
    return regions.region_count(p, C)


@_on_points
def region_sampled_count(p):
    return regions.region_count(stride_sample(scan(p), 15), C)


@_on_points
def region_taxi_count_by_period(p):
    return regions.region_count_by_period(p, C)


@_on_points
def region_search_time_range(p):
    return regions.search(p, C, "2008-02-02 09:00:00", "2008-02-02 15:00:00").select("event_id", "taxi_id", "ts")


@_on_points
def density_by_period(p):
    return density.density(p).select("period", "gx", "gy", "n")


@_on_points
def density_all_day(p):
    return density.with_all_day(density.density(p)).where(F.col("period") == density.ALL_DAY).select("gx", "gy", "n")


@_on_points
def density_stats(p):
    return density.totals(density.density(p, EXPAND_RATIOS))


@_on_points
def density_expand_5_10_15(p):
    return density.density(p, EXPAND_RATIOS)


@_on_points
def density_r_param(p):
    return density.density(p, (0.10,), 37).select("period", "gx", "gy", "n")


@_on_points
def density_intensity(p):
    return _rounded(density.intensity(density.with_all_day(density.density(p))), 9, "intensity").select("period", "gx", "gy", "n", "intensity")


@_on_points
def density_colors(p):
    c = intensity_color(F.round("intensity", 9))  # engines' logarithms differ in the last digit
    shades = density.intensity(density.density(p)).select("period", "n", F.round(c[0], 3).alias("r"), F.round(c[1], 3).alias("g"), F.round(c[2], 3).alias("b"))
    return shades.distinct()


@_on_points
def trip_split(p):
    return trips.split(p).select("taxi_id", "trip_id", "event_id", "n")


@_on_points
def trip_summary(p):
    return trips.summary(p)


@_on_points
def trip_endpoints(p):
    return trips.endpoints(p)


@_on_points
def od_matrix_by_period(p):
    return od.matrix(p)


@_on_points
def od_matrix_refreshed(p):
    """The matrix made without some points and with others moved, then refreshed with all."""
    folder = new_path(p.sparkSession, "od_tables")
    moved = F.when(F.hour("ts") == 12, F.lit(116.5)).otherwise(F.col("lon"))
    upkeep.refresh(p.where("hour(ts) <> 15").withColumn("lon", moved), folder, "HOUR")
    upkeep.refresh(p, folder, "HOUR")
    return upkeep.matrix(p.sparkSession, folder)


@_on_matrix
def od_flow_between_regions(m):
    return od.flow_between(m, A, B)


@_on_matrix
def od_paths_between_regions(m):
    return od.paths_between(m, A, B)


@_on_matrix
def od_region_totals(m):
    return od.region_totals(m, C)


@_on_matrix
def od_region_top_destinations(m):
    return od.top_counterparts(m, C, od.OUT)


@_on_matrix
def od_region_top_sources(m):
    return od.top_counterparts(m, C, od.IN)


@_on_matrix
def od_region_arcs(m):
    return od.top_arcs(od.paths_of_region(m, C))


@_on_matrix
def od_arc_styles(m):
    styled = od.arc_style(od.with_centers(od.paths_of_region(m, C)), "region", True)
    return _rounded(styled, 9, "width", "height").select("start_grid", "end_grid", "period", "direction", "sector", "quadrant", "width", "height", F.array_join("color", "/").alias("color"))


@_on_matrix
def od_path_labels(m):
    labelled = _rounded(od.with_labels(od.with_centers(od.paths_between(m, A, B))), 9, "source_lon", "source_lat", "target_lon", "target_lat")
    return labelled.select("start_grid", "end_grid", "source_lon", "source_lat", "target_lon", "target_lat", "count", "period_name", "direction", "label")


@_on_matrix
def od_balance_metrics(m):
    return _rounded(od.balance(od.paths_of_region(m, C)), 9, "dominant_ratio", "imbalance")


@_on_matrix
def od_sector_quota(m):
    return od.quota_arcs(od.paths_of_region(m, C), 40).select("start_grid", "end_grid", "period", "direction", "count", "sector")


@_on_points
def path_sequences(p):
    return paths.sequences(p).select("taxi_id", "trip_id", F.array_join("path", ">").alias("path"))


def _frequencies(p):
    return paths.prefix_frequency(written(paths.sequences(p), "sequences"))


@_on_points
def path_prefix_frequency(p):
    return _frequencies(p).select(F.array_join("path", ">").alias("path"), "vehicles", "trips")


def _ranked(rows):
    return _rounded(rows, 6, "score").select(F.array_join("path", ">").alias("path"), "vehicles", "path_len", F.bround("distance").alias("distance"), "score")


@_on_points
def frequent_paths_topk(p):
    return _ranked(paths.top_k(_frequencies(p), 10))


@_on_points
def frequent_paths_grown(p):
    """The same rows, by growing prefixes under a bound."""
    return _ranked(paths.top_k_grown(written(paths.sequences(p), "sequences"), 10)[0])


#: Ranges of hours that one table of bitmaps answers.
HOURS = {"morning": ("2008-02-02 06:00:00", "2008-02-02 09:00:00"), "daytime": ("2008-02-02 09:00:00", "2008-02-02 17:00:00"), "all": ("2008-02-02 00:00:00", "2008-02-03 00:00:00")}


@_on_points
def path_vehicles_by_hours(p):
    """Vehicles of every complete sequence in three ranges, from the same bitmaps."""
    bitmaps = written(paths.vehicle_bitmaps(written(paths.sequences(p, dated=True), "sequences"), "HOUR"), "bitmaps")
    parts = [paths.vehicles_between(bitmaps, *hours).select(F.lit(name).alias("hours"), F.array_join("path", ">").alias("path"), "vehicles") for name, hours in HOURS.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@_on_points
def frequent_paths_min_distance(p):
    return _ranked(paths.top_k(_frequencies(p), 10, 2000.0))


@_on_points
def frequent_paths_between(p):
    return _ranked(paths.top_k_between(_frequencies(p), A, B, 10))


@_on_points
def path_tree_stats(p):
    return paths.tree_stats(written(paths.sequences(p), "sequences"))


def _drawn(rows):
    """Paths and lines as texts."""
    line = F.array_join(F.transform("coords", lambda c: F.format_string("%.4f %.4f", c[0], c[1])), ",")
    return rows.withColumns({c: F.array_join("path", ">") for c in rows.columns if c == "path"} | {"coords": line})


@_on_points
def path_exemplars(p):
    return _drawn(paths.exemplars(display.trip_table(p)))


@_on_points
def path_styles(p):
    best = paths.top_k(_frequencies(p), 10)
    order = Window.orderBy(F.desc("vehicles"), F.desc("distance"), "path")  # ten rows
    return viewport.path_style(best.withColumn("place", F.row_number().over(order) - 1), F.col("place")).select(F.array_join("path", ">").alias("path"), "place", F.round("width", 6).alias("width"), "color")


def _asked_paths(p):
    """The frequent paths between two regions, and pairs of cells that trips lead from A to B between."""
    frequent = paths.top_k_between(_frequencies(p), A, B, 10).select("path")
    pairs = od.paths_between(od.matrix(p), A, B).where(F.col("direction") == od.A_TO_B).select(F.array("start_grid", "end_grid").alias("path"))
    return written(frequent.unionByName(pairs).distinct(), "asked_paths")


@_on_points
def path_vehicle_counts(p):
    found = paths.vehicles_of(_frequencies(p), _asked_paths(p))
    return found.select(F.array_join("path", ">").alias("path"), "vehicles")


@_on_points
def trips_crossing_regions(p):
    return display.crossing_trips(display.trip_table(p), A, B)


@_on_points
def region_trip(p):
    return _drawn(display.region_trip(display.trip_table(p), A, B))


@_on_points
def recorded_trips_of_paths(p):
    return _drawn(display.recorded_trips(_asked_paths(p), display.recorded_lines(display.trip_table(p))))


def _shown(p):
    trip_table = display.trip_table(p)
    return display.with_lines(_asked_paths(p), paths.exemplars(trip_table), display.recorded_lines(trip_table), display.region_trip(trip_table, A, B))


@_on_points
def shown_paths(p):
    return _drawn(_shown(p))


@_on_points
def display_hint(p):
    trip_table = display.trip_table(p)
    grid = display.with_lines(_asked_paths(p), paths.exemplars(trip_table), display.recorded_lines(trip_table).limit(0))
    counted = grid.agg(F.count_if(F.col("shown") != display.GRID).alias("hits"), F.count("*").alias("total"))
    return counted.withColumn("hint", display.hint(F.col("hits"), F.col("total")))


@_on_points
def road_nodes(p):
    return _rounded(road.nodes(p), 9, "lon", "lat")


@_on_points
def road_edges_default(p):
    return _rounded(road.default_edges(road.nodes(p)), 4, "meters", "seconds")


@_on_points
def travel_samples(p):
    return road.travel_samples(p).select("u", "v", "period", "seconds", "first_id")


@_on_points
def edge_travel_time_median(p):
    return road.edge_medians(road.travel_samples(p)).select("u", "v", "period", "samples", "seconds")


@_on_points
def road_edges_effective(p):
    return _rounded(road.effective_edges(p), 4, "seconds")


def _asked_places(p):
    return p.select(F.col("event_id").alias("place"), "lon", "lat")


@_on_points
def nearest_node(p):
    return _rounded(routing.nearest_node(_asked_places(p), road.nodes(p)), 3, "meters").select("place", "node", "meters")


@_on_points
def nearest_nodes_k(p):
    """The three nearest nodes of all points, those far from any node too."""
    return _rounded(neighbours.nearest(_asked_places(p), road.nodes(p), 3), 3, "meters")


def _trip_pairs(p):
    """The boxes of each vehicle's trips, each with that of the next trip."""
    after = Window.partitionBy("taxi_id").orderBy("trip_id")
    edges = F.struct("x_min", "y_min", "x_max", "y_max")
    return _trip_rects(p).select(F.col("box").alias("pair"), edges.alias("a"), F.lead(edges).over(after).alias("b")).where("b is not null")


@_on_points
def nearest_grid_centers_k(p):
    return regions.border_neighbours(_trip_pairs(p), 8)


@_on_points
def region_edge_grids(p):
    both = regions.with_borders(_trip_pairs(p))
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("rect"), F.col(f"border_{name}").alias("cells")) for name in "ab"]))
    return both.select("pair", sides.alias("s")).select("pair", "s.rect", F.explode_outer("s.cells").alias("gid")).where("gid is not null")


def _road_graph(p):
    """Nodes and edges, each worked out once."""
    nodes = written(road.nodes(p), "nodes")
    return nodes, written(road.effective_edges(p, node_table=nodes), "edges")


@_on_points
def shortest_time_by_period(p):
    asked = p.sparkSession.createDataFrame([(START, END, k) for k in range(3)], "start long, end long, period int")
    return _rounded(routing.fastest_routes(_road_graph(p)[1], asked), 4, "seconds").select(F.col("start").alias("start_node"), F.col("end").alias("end_node"), "period", "seconds")


@_on_points
def shortest_times_from_node(p):
    sources = p.sparkSession.createDataFrame([(START, 2)], "start long, period int")
    return _rounded(routing.relaxed(_road_graph(p)[1], sources), 4, "seconds").select("node", "seconds")


@_on_points
def routes_of_any_size(p):
    """Routes by relaxation and pointer doubling, in three periods and one without edges."""
    asked = p.sparkSession.createDataFrame([(START, END, k) for k in (0, 1, 2, 9)] + [(END, START, 2), (START, START, 1), (START, -7, 1), (-7, END, 1)], "start long, end long, period int")
    found = routing.routes(_road_graph(p)[1], asked)
    return _rounded(found, 4, "seconds").select(F.col("start").alias("start_node"), F.col("end").alias("end_node"), "period", "seconds", F.array_join("route", ">").alias("route"))


@_on_points
def region_shortest_path(p):
    nodes, edges = _road_graph(p)
    best = written(routing.region_route(edges, nodes, A, B, 2), "best")
    line = routing.route_coords(best.select(F.col("start_grid").alias("start"), F.col("end_grid").alias("end"), F.lit(2).alias("period"), "route"), nodes)
    line = routing.route_cells(line).select(F.col("start").alias("start_grid"), F.col("end").alias("end_grid"), F.array_join("cells", ">").alias("cells"))
    told = best.join(line, ["start_grid", "end_grid"]).withColumn("time", routing.time_text(F.round("seconds", 4)))
    return _rounded(told, 4, "seconds").select("start_grid", "end_grid", "seconds", "searched", F.array_join("route", ">").alias("route"), "cells", "time")


@_on_points
def routing_endpoints(p):
    nodes = written(road.nodes(p), "nodes")
    asked = {"A": A, "OUT": OUT, "place": (116.42, 39.71), "far": (110.0, 30.0)}
    parts = [routing.endpoint(nodes, place).select(F.lit(name).alias("asked"), "node", "meters") for name, place in asked.items()]
    return _rounded(functools.reduce(DataFrame.unionByName, parts), 3, "meters")


@_on_points
def edge_seconds_lookup(p):
    """Every edge both ways in a period that is there, one that isn't, and a pair that is no edge."""
    edges = _road_graph(p)[1]
    pairs = edges.select("src", "dst").distinct()
    asked = pairs.select("src", "dst", F.explode(F.array(F.lit(0), F.lit(9))).alias("period")).unionByName(pairs.select("src", F.lit(-5).cast("long").alias("dst"), F.lit(1).alias("period")).distinct())
    return _rounded(routing.edge_seconds(edges, asked), 4, "seconds")


@_on_points
def compare_periods(p):
    nodes, edges = _road_graph(p)
    return _rounded(routing.compare_regions(edges, nodes, A, B), 4, "seconds")


@_on_points
def viewport_lod_points(p):
    views = p.sparkSession.createDataFrame(VIEWS, "view int, lon double, lat double, zoom double, width int, height int")
    return viewport.thin(p, views).select("view", "event_id", "taxi_id", "vx", "vy")


@_on_points
def view_state(p):
    return _rounded(viewport.view_state(regions.search(p, C)), 9, "longitude", "latitude")


def _shaped(p, shape):
    """The places of every trip's line after shaping it."""
    lines = paths.display_coords(p).select("taxi_id", "trip_id", shape(F.col("coords")).alias("line"))
    # an outer one, as for an inner one a line would be worked out once more for a filter on its size
    places = lines.select("taxi_id", "trip_id", F.posexplode_outer("line").alias("place", "p")).where("place is not null")
    return places.select("taxi_id", "trip_id", "place", F.round(F.col("p")[0], 9).alias("lon"), F.round(F.col("p")[1], 9).alias("lat"))


@_on_points
def smooth_polyline(p):
    return _shaped(p, polyline.smooth)


@_on_points
def simplify_collinear(p):
    return _shaped(p, polyline.simplify)


@_on_points
def trajectory_like_line(p):
    return _shaped(p, polyline.trajectory_like)


@_on_points
def snap_to_road(p):
    nodes, edges = _road_graph(p)
    lines = trajectory.lines(trajectory.capped(trajectory.first_vehicles(scan(p))))
    return trajectory.snap_to_road(lines, edges, nodes).select("taxi_id", F.size("coords").alias("places"), "snapped")


@_on_points
def system_stats(p):
    return stats.system_stats(p)


@_on_points
def map_payload(p):
    found = regions.search(p, C)
    state = _rounded(viewport.view_state(found), 9, "longitude", "latitude")
    view = state.select(F.lit(0).alias("view"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "zoom", F.lit(1200).alias("width"), F.lit(800).alias("height"))
    return viewport.payload(state, [viewport.scatter(viewport.thin(found, written(view, "view")), 16)], {"rect": "C"})


@_on_points
def map_layers(p):
    """Layers of each kind: the most frequent paths, arcs of a region, density as heat, and rectangles."""
    best = paths.top_k(_frequencies(p), 10)
    order = Window.orderBy(F.desc("vehicles"), F.desc("distance"), "path")  # ten rows
    coords = F.transform(paths.path_coords(F.col("path")), lambda c: F.array(F.round(c[0], 6), F.round(c[1], 6)))
    lines = best.withColumn("place", F.row_number().over(order) - 1).withColumn("coords", coords)
    arcs = od.arc_style(od.with_centers(od.top_arcs(od.paths_of_region(od.matrix(p), C), 20)), "region", True)
    arcs = _rounded(arcs, 6, "width", "height", "source_lon", "source_lat", "target_lon", "target_lat")
    heat = density.density(scan(p), (0.05,), 10).groupBy("gx", "gy").agg(F.sum("n").alias("weight"))
    heat = heat.select((F.col("gx") + 0.5).alias("lon"), (F.col("gy") + 0.5).alias("lat"), "weight")
    rects = p.sparkSession.createDataFrame([(n, *map(float, r)) for n, r in RECTS.items()], "rect string, x_min double, y_min double, x_max double, y_max double")
    made = [viewport.path_layer(viewport.path_style(lines, F.col("place"))), viewport.arc_layer(arcs), viewport.heatmap_layer(heat), viewport.polygon_layer(rects)]
    return functools.reduce(DataFrame.unionByName, [m.select("layer.type", F.size("layer.data").alias("places"), F.to_json("layer.data").alias("data")) for m in made])


@_on_points
def density_columns(p):
    return _rounded(viewport.column_rows(density.density(p)), 6, "elevation").select("period", "gx", "gy", "elevation")


def _streamed(spark, sf_dir, make):
    """A stream over the written points, drained, with a last point that lets all windows close."""
    source, out, state = (new_path(spark, n) for n in ("stream_in", "stream_out", "stream_state"))
    end = spark.sql("select -1L event_id, -1L taxi_id, timestamp_ntz'2030-01-01 00:00:00' ts, 116.5D lon, 39.5D lat")
    from_events(spark, sf_dir).write.parquet(source)
    end.write.mode("append").parquet(source)
    stream = make(live.points(spark, source))
    live.drain(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


def _moves(trips):
    return trips.select("taxi_id", F.explode("moves").alias("m")).select("m.u", "m.v", "m.period", "m.seconds", "m.first_id")


_queries |= {
    "stream_trip_ends": lambda spark, sf_dir: _streamed(spark, sf_dir, live.trips).drop("moves"),
    "stream_travel_samples": lambda spark, sf_dir: _moves(_streamed(spark, sf_dir, live.trips)),
    "stream_density": lambda spark, sf_dir: _streamed(spark, sf_dir, live.density).groupBy("period", "gx", "gy").agg(F.sum("n").alias("n")),
    "stream_trip_sessions": lambda spark, sf_dir: _streamed(spark, sf_dir, live.trip_sessions),
}
