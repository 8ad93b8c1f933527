import datetime as dt
import heapq

import pytest
from pyspark.sql import functions as F

from roamgrid.config import Rect
from roamgrid.operators import display, density, od, paths, polyline, road, routing, trajectory, viewport
from roamgrid.sources.points import from_events

SF = "/root/testdata/sf0.001"
POINTS = "event_id long, taxi_id long, ts timestamp_ntz, lon double, lat double"


def line(spark, f, coords):
    return spark.createDataFrame([(coords,)], "c array<array<double>>").select(f(F.col("c"))).head()[0]


def place(gid):
    return 116.0 + (gid % 100 + 0.5) * 0.01, 39.4 + (gid // 100 + 0.5) * 0.007


@pytest.mark.parametrize("gids,path", [([5, 5, None, 5, 6], [5, 6]), ([5, None, 5, 5, 5], None), ([1, 2, 1, 2, 2], [1, 2, 1, 2])])
def test_sequences(spark, gids, path):
    rows = [(i, 1, dt.datetime(2008, 2, 2) + dt.timedelta(seconds=60 * i), *(place(g) if g is not None else (0.0, 0.0))) for i, g in enumerate(gids)]
    got = paths.sequences(spark.createDataFrame(rows, POINTS)).collect()
    assert [r.path for r in got] == ([path] if path else [])


def test_prefixes_count_vehicles(spark):
    rows = [(1, [1, 2, 3]), (2, [1, 2]), (3, [1, 2, 4]), (1, [1, 2])]
    got = paths.prefix_frequency(spark.createDataFrame(rows, "taxi_id long, path array<int>")).collect()
    assert {(tuple(r.path), r.vehicles, r.trips) for r in got} == {((1, 2), 3, 4), ((1, 2, 3), 1, 1), ((1, 2, 4), 1, 1)}
    table = spark.createDataFrame(got)
    assert paths.with_prefix(table, [1, 2]).count() == 3
    top = paths.top_k(table, 2, long_paths=False).collect()
    assert [r.vehicles for r in top] == [3, 1]


def samples(spark, rows):
    return spark.createDataFrame([(*r, 1, i) for i, r in enumerate(rows)], "u long, v long, period int, seconds double, taxi_id long, first_id long")


def test_medians_need_three_samples_and_the_later_direction_wins(spark):
    rows = [(1, 2, 0, 5.0)] * 2 + [(3, 4, 0, s) for s in (1.0, 9.0, 2.0)] + [(4, 3, 0, s) for s in (10.0, 20.0, 30.0, 40.0)]
    medians = road.edge_medians(samples(spark, rows))
    assert {(r.u, r.v, r.samples, r.seconds) for r in medians.collect()} == {(3, 4, 3, 2.0), (4, 3, 4, 25.0)}
    assert [(r.a, r.b, r.seconds) for r in road.symmetric_medians(medians).collect()] == [(3, 4, 25.0)]


def lattice(n):
    for y in range(n):
        for x in range(n):
            for dx, dy in road.NEIGHBOURS:
                if 0 <= x + dx < n and 0 <= y + dy < n:
                    yield y * n + x, (y + dy) * n + x + dx, 2, 1.0


def test_routes_on_a_lattice(spark):
    edges = spark.createDataFrame(list(lattice(12)), "src long, dst long, period int, seconds double")
    asked = spark.createDataFrame([(0, 143, 2), (5, 5, 2), (0, 999, 2), (0, 143, 1)], "start long, end long, period int")
    got = {(r.start, r.end, r.period): r for r in routing.fastest_routes(edges, asked).collect()}
    assert got[0, 143, 2].seconds == 11 and got[0, 143, 2].route == [13 * i for i in range(12)]
    assert got[5, 5, 2].seconds == 0 and (0, 999, 2) not in got
    assert got[0, 143, 1].seconds == 11  # a period without edges takes the off-peak ones
    reached = {r.node: r.seconds for r in routing.relaxed(edges, spark.createDataFrame([(0, 2)], "start long, period int")).collect()}
    assert reached == {y * 12 + x: float(max(x, y)) for x in range(12) for y in range(12)}


def test_routes_agree_with_a_plain_search(spark):
    edges = road.effective_edges(from_events(spark, SF)).where("period = 2").cache()
    of = {}
    for r in edges.collect():
        of.setdefault(r.src, []).append((r.dst, r.seconds))
    start = next(iter(of))
    best, queue = {}, [(0.0, start)]
    while queue:
        t, u = heapq.heappop(queue)
        if u not in best:
            best[u] = t
            for v, w in of.get(u, []):
                heapq.heappush(queue, (t + w, v))
    asked = spark.createDataFrame([(start, n, 2) for n in best], "start long, end long, period int")
    got = {r.end: r.seconds for r in routing.fastest_routes(edges, asked).collect()}
    assert got.keys() == best.keys() and all(abs(got[n] - t) < 1e-9 for n, t in best.items())


def test_nearest_node_looks_farther_only_if_it_must(spark):
    nodes = spark.createDataFrame([(1, 116.0, 39.4), (2, 116.5, 39.9)], "node long, lon double, lat double")
    places = spark.createDataFrame([("near", 116.01, 39.41), ("far", 116.3, 39.8)], "place string, lon double, lat double")
    assert {(r.place, r.node) for r in routing.nearest_node(places, nodes).collect()} == {("near", 1), ("far", 2)}
    assert routing.nearest_node_in(nodes, Rect(116.4, 39.8, 116.6, 40.0), 116.0, 39.4).head().node == 2


def test_polylines(spark):
    straight = [[float(i), 0.0] for i in range(5)]
    assert line(spark, polyline.simplify, straight) == [[0.0, 0.0], [4.0, 0.0]]
    assert line(spark, polyline.simplify, [[0.0, 0.0]]) == [[0.0, 0.0]] and line(spark, polyline.simplify, []) == []
    assert len(line(spark, polyline.densify, straight)) == 4 * 7 + 1
    assert line(spark, polyline.smooth, [[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]])[0] == [0.0, 0.0]
    assert line(spark, polyline.smooth, straight) == straight
    thin = line(spark, lambda c: polyline.subsample(c, 4), [[float(i), 0.0] for i in range(11)])
    assert thin == [[0.0, 0.0], [3.0, 0.0], [6.0, 0.0], [9.0, 0.0]]
    assert len(line(spark, polyline.trajectory_like, [[float(i), float(i % 3)] for i in range(500)])) <= 360


def test_sums_agree(spark):
    p = from_events(spark, SF).cache()
    cells = density.with_all_day(density.density(p))
    sums = {r.period: r.n for r in cells.groupBy("period").agg(F.sum("n").alias("n")).collect()}
    assert sums[-1] == sums[0] + sums[1] + sums[2]
    a, b = Rect(116.30, 39.60, 116.45, 39.75), Rect(116.45, 39.65, 116.65, 39.85)
    m = od.matrix(p)
    one, two = ({r.period: r for r in od.flow_between(m, x, y).collect()} for x, y in ((a, b), (b, a)))
    assert all(one[k].a_to_b == two[k].b_to_a for k in one)
    assert od.quota_arcs(od.paths_of_region(m, a), 5).count() == 5
    assert od.is_edge_region(Rect(116.0, 39.6, 116.1, 39.7)) and not od.is_edge_region(Rect(116.4, 39.7, 116.5, 39.8))


def test_views(spark):
    empty = spark.createDataFrame([], POINTS)
    assert tuple(viewport.view_state(empty).head()) == (116.51, 39.92, 11.0)
    assert [viewport.detail(z).max_points for z in (10, 11.5, 13, 14)] == [1200, 3000, 6000, 10000]
    views = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 512, 512), (2, 10.0, 60.0, 1.0, 512, 256), (3, 0.0, 90.0, 3.0, 64, 64)], "view int, lon double, lat double, zoom double, width int, height int")
    boxes = {r.view: r for r in viewport.with_boxes(views).collect()}
    assert [boxes[1][c] for c in ("x_min", "y_min", "x_max", "y_max", "max_points")] == [-180.0, -180.0, 180.0, 180.0, 1200]
    assert abs(boxes[2].y_max - 150.0) < 1e-9 and boxes[2].x_max == 100.0 and boxes[3].y_max - 90.0 == 2.8125 / 0.01
    box = Rect(1.0, 2.0, 3.0, 4.0)
    assert viewport.rect_polygon(box)[0] == viewport.rect_polygon(box)[-1]
    assert viewport.thin(empty, views).count() == 0


def test_capped_lines(spark):
    rows = [(i, 1, dt.datetime(2008, 2, 2) + dt.timedelta(seconds=i), 116.5, 39.5) for i in range(100)]
    got = trajectory.capped(spark.createDataFrame(rows, POINTS), 1, 30)
    assert got.count() == 30 and got.agg(F.max("rn")).head()[0] == 87


def test_route_cells(spark):
    routes = spark.createDataFrame([([[116.005, 39.4], [116.006, 39.401], [116.015, 39.4], [0.0, 0.0], [116.005, 39.4]],), ([],)], "coords array<array<double>>")
    assert [r.cells for r in routing.route_cells(routes).collect()] == [[0, 1, 0], []]


def test_a_line_is_led_over_the_roads(spark):
    """Three nodes in a bent row; the line's key places lie near the first and the last."""
    nodes = spark.createDataFrame([(1, 116.0, 39.4), (2, 116.1, 39.4), (3, 116.1, 39.5)], "node long, lon double, lat double")
    edges = spark.createDataFrame([(a, b, 2, 60.0) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2))], "src long, dst long, period int, seconds double")
    lines = spark.createDataFrame([(7, [[116.001, 39.4], [116.05, 39.45], [116.1, 39.499]]), (8, [[116.0, 39.4], [116.001, 39.4]])], "taxi_id long, coords array<array<double>>")
    got = {r.taxi_id: r for r in trajectory.snap_to_road(lines, edges, nodes, keyframe=10).collect()}
    assert got[7].snapped and got[7].coords == [[116.0, 39.4], [116.1, 39.4], [116.1, 39.5]]
    assert not got[8].snapped and got[8].coords == [[116.0, 39.4], [116.001, 39.4]]


def test_shown_lines_on_small_cases(spark):
    """The first exact trip before a longer one of the same ends; nothing for unknown ends."""
    lines = spark.createDataFrame([(2, 0, [5, 6, 9], [[0.0, 0.0]] * 9), (1, 3, [5, 7, 9], [[1.0, 1.0]] * 2), (1, 4, [5, 7, 9], [[2.0, 2.0]] * 5)], "taxi_id long, trip_id long, path array<int>, coords array<array<double>>")
    asked = spark.createDataFrame([([5, 7, 9],), ([5, 9],), ([1, 2],)], "path array<int>")
    got = {tuple(r.path): r for r in display.recorded_trips(asked, lines).collect()}
    assert (got[5, 7, 9].trip_id, got[5, 7, 9].exact) == (3, True) and (got[5, 9].taxi_id, got[5, 9].exact) == (2, False) and (1, 2) not in got
    known = asked.limit(0).select("path", F.lit(None).cast("array<array<double>>").alias("coords"))
    assert {tuple(r.path): r.shown for r in display.with_lines(asked, known, lines).collect()} == {(5, 7, 9): "trip", (5, 9): "trip", (1, 2): "grid"}
    notes = spark.range(3).select(display.hint(F.col("id").cast("int"), F.lit(2)).alias("h")).collect()
    assert notes[0].h.startswith("no recorded") and notes[1].h.startswith("1 paths") and notes[2].h is None
