"""Cells, many boxes, neighbours, routes of any size, grown paths and bitmaps on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roamgrid import catalogue
from roamgrid.config import BOUNDS
from roamgrid.operators import cells, neighbours, paths, regions, routing, viewport
from roamgrid.sources import points as sources
from tests.compare import DATA

POINT = "event_id long, taxi_id long, lon double, lat double"


def metres(a, b, c, d):
    p, q = math.radians(b), math.radians(d)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(c - a) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture(scope="module")
def odd_points():
    rng = random.Random(4)
    rows = [(rng.choice([116.0, 116.5, 116.50001, 116.53, 0.0, -0.5]) + rng.choice([0.0, rng.random() / 100]), rng.choice([39.5, 39.9, 0.0, -1.0]) + rng.choice([0.0, rng.random() / 100])) for _ in range(300)]
    rows += [(116.25, 39.75)] * 200 + [(None, 39.5), (116.5, None), (float("nan"), 39.5), (116.5, float("inf")), (117.0, 40.0), (180.0, -90.0)]
    return [(i, None if i == 7 else i % 11, lon, lat) for i, (lon, lat) in enumerate(rows)]


@pytest.mark.parametrize("capacity, few", [(1_000, 100_000), (3, 100_000), (3, 0)])
def test_many_boxes(spark, odd_points, capacity, few, monkeypatch):
    """Edges on points and on cells, boxes of one point, empty, crossed, null and whole-earth ones."""
    monkeypatch.setattr(cells, "BROADCAST_CELLS", few)
    rng = random.Random(5)
    boxes = []
    for i in range(40):
        (_, _, a, b), (_, _, c, d) = rng.sample(odd_points[:500], 2)
        boxes.append((f"b{i}", min(a, c), min(b, d), max(a, c), max(b, d)))
    boxes += [("point", 116.25, 39.75, 116.25, 39.75), ("none", 10.0, 10.0, 11.0, 11.0), ("crossed", 2.0, 2.0, 1.0, 1.0), ("null", None, 0.0, 1.0, 1.0), ("all", -400.0, -400.0, 400.0, 400.0), ("cell", 116.0, 39.0, 118.0, 40.0)]
    want = {}
    for name, a, b, c, d in boxes:
        inside = [(t, x, y) for _, t, x, y in odd_points if None not in (a, x, y) and a <= x <= c and b <= y <= d]
        want[name] = len(inside), len({t for t, *_ in inside if t is not None})
    got = cells.count_boxes(spark.createDataFrame(odd_points, POINT), spark.createDataFrame(boxes, "box string, x_min double, y_min double, x_max double, y_max double"), capacity)
    assert {r.box: (r.points, r.taxis) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_row_for_each_box_and_vehicle(spark, monkeypatch):
    """Many vehicles in many boxes, of which most have the same edges: what tasks tell is a row for each box and part."""
    monkeypatch.setattr(cells, "PART_BOXES", 2)
    places = [(i, i // 3, 116.0 + i % 7 / 10, 39.5 + i % 4 / 10) for i in range(1_200)]
    names = [(f"b{i}", 116.0, 39.5, 116.05 + i % 3 / 10, 39.5 + i % 2 / 10) for i in range(200)] + [("nan", 116.3, 39.5, float("nan"), float("nan"))]
    told = []
    got = cells.count_boxes(spark.createDataFrame(places, POINT), spark.createDataFrame(names, "box string, x_min double, y_min double, x_max double, y_max double"), 100)
    for r in got.collect():
        _, a, b, c, d = next(n for n in names if n[0] == r.box)
        inside = [t for _, t, x, y in places if a <= x and b <= y and not x > c and not y > d]
        told.append((r.points, r.taxis) == (len(inside), len(set(inside))))
    assert told == [True] * 201
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "taxi_id, " not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_boxes_without_points(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0)], "box string, x_min double, y_min double, x_max double, y_max double")
    assert [tuple(r) for r in cells.count_boxes(spark.createDataFrame([], POINT), boxes).collect()] == [("a", 0, 0)]
    assert cells.count_boxes(spark.createDataFrame([(1, 1, 0.5, 0.5)], POINT), boxes.limit(0)).collect() == []


def test_cells_are_split_while_too_full(spark):
    rng = random.Random(6)
    rows = [(rng.random() ** 3, rng.random() ** 2) for _ in range(500)] + [(0.123, 0.4)] * 30
    points = spark.createDataFrame([(i, 1, 116 + x, 39.4 + 0.7 * y) for i, (x, y) in enumerate(rows)], POINT)

    def split(held, level):
        if len(held) <= 10 or level == 6:
            return [(level, len(held))] if held else []
        quarters = {}
        for x, y in held:
            quarters.setdefault((x >> (5 - level), y >> (5 - level)), []).append((x, y))
        return [leaf for q in quarters.values() for leaf in split(q, level + 1)]

    placed = cells.with_cell_of(points, BOUNDS, 6)
    found = cells.adaptive(placed, 10, 6)
    want = split([(r.cx, r.cy) for r in placed.collect()], 0)
    assert sorted((r.level, r.n) for r in found.where("leaf").collect()) == sorted(want)
    stats = cells.tree_stats(found).head()
    assert stats.points == 530 and stats.nodes == 4 * found.where("not leaf").count() + 1 and stats.leaves == stats.nodes - found.where("not leaf").count()
    assert tuple(cells.tree_stats(cells.adaptive(placed.limit(0), 10, 6)).head()) == (1, 1, 0, 0)


@pytest.mark.parametrize("k, few", [(1, 100_000), (4, 100_000), (4, 0)])
def test_nearest_of_many(spark, k, few, monkeypatch):
    """Near, far, equal, polar places and such across the 180th meridian; ties to the smaller node."""
    monkeypatch.setattr(neighbours, "BROADCAST_CELLS", few)
    rng = random.Random(7)
    nodes = [(i, 116 + rng.randrange(50) / 50, 39.4 + rng.randrange(30) / 50) for i in range(150)] + [(900, 179.9, 10.0), (901, -179.8, -10.0), (902, 20.0, 88.0), (903, 116.0, 39.4), (904, 116.0, 39.4)]
    places = [(i, 116 + rng.random() * 1.2, 39.3 + rng.random()) for i in range(120)] + [(500, 0.0, 0.0), (501, 0.0, 0.0), (502, -179.95, 9.0), (503, 179.99, -11.0), (504, -160.0, 89.5), (505, 116.0, 39.4), (506, 10.0, -89.9), (507, None, 1.0)]
    got = neighbours.nearest(spark.createDataFrame(places, "place long, lon double, lat double"), spark.createDataFrame(nodes, "node long, lon double, lat double"), k).collect()
    for place, lon, lat in places:
        own = sorted((r.rank, r.node, r.meters) for r in got if r.place == place)
        if lon is None:
            assert not own
            continue
        want = sorted((metres(lon, lat, x, y), n) for n, x, y in nodes)[:k]
        assert [r for r, _, _ in own] == list(range(1, k + 1))
        assert [m for _, _, m in own] == pytest.approx([m for m, _ in want], rel=1e-7, abs=1e-3), place
    assert [r.node for r in sorted(got, key=lambda r: r.rank) if r.place == 505][:2] == [903, 904][:k]


def test_fewer_nodes_than_asked(spark):
    place = spark.createDataFrame([(1, 5.0, 5.0)], "place long, lon double, lat double")
    nodes = spark.createDataFrame([(1, 6.0, 5.0), (2, None, None)], "node long, lon double, lat double")
    assert [(r.node, r.rank) for r in neighbours.nearest(place, nodes, 3).collect()] == [(1, 1)]
    assert neighbours.nearest(place, nodes.limit(0), 3).collect() == []


def test_routes_equal_those_of_the_search(spark):
    """Random graphs with equal times, loops, nodes out of reach and a period without edges."""
    rng = random.Random(8)
    edges = [(a, b, p, float(rng.randrange(1, 5))) for p in (0, 2) for a in range(40) for b in rng.sample(range(45), 3) if a != b]
    table = spark.createDataFrame(edges, "src long, dst long, period int, seconds double")
    asked = [(rng.randrange(42), rng.randrange(46), rng.choice([0, 1, 2])) for _ in range(60)] + [(1, 1, 0), (99, 1, 0), (1, 99, 2)]
    requests = spark.createDataFrame(asked, "start long, end long, period int")
    plain = {(r.start, r.end, r.period): (r.seconds, r.route) for r in routing.fastest_routes(table, requests).collect()}
    grown = {(r.start, r.end, r.period): (r.seconds, r.route) for r in routing.routes(table, requests).collect()}
    assert grown == plain and len(plain) > 30
    assert max(len(route) for _, route in plain.values()) > 4


def test_grown_paths_make_fewer_prefixes(spark):
    """The same rows as over all prefixes, with fewer of them made."""
    rng = random.Random(9)
    hot = [3100, 3101, 3201]
    rows = [(v, t, hot[: rng.choice([2, 3])] + [3202 + rng.randrange(40) for _ in range(rng.randrange(0, 6))]) for v in range(30) for t in range(4)]
    table = spark.createDataFrame(rows, "taxi_id long, trip_id long, path array<int>")
    for k, distance in ((3, 0.0), (5, 500.0), (400, 0.0)):
        best, made = paths.top_k_grown(table, k, distance)
        assert best.collect() == paths.top_k(paths.prefix_frequency(table), k, distance).collect()
    every = sum(len(p) - 1 for _, _, p in rows)
    assert paths.top_k_grown(table, 2)[1] < every
    empty, made = paths.top_k_grown(table.limit(0))
    assert empty.collect() == [] and made == 0


def test_bitmaps_of_days(spark):
    """Counts of any range of days are those of the trips in it, beyond one bitmap's numbers too."""
    rng = random.Random(10)
    rows = [(rng.choice([1, 2, 3, 40_000, 70_000]), i, rng.choice([[1, 2], [1, 2, 3], [4, 5]]), f"2008-02-0{rng.randrange(1, 6)} 10:00:00") for i in range(80)]
    table = spark.createDataFrame(rows, "taxi_id long, trip_id long, path array<int>, at string").withColumn("start_ts", F.col("at").cast("timestamp_ntz"))
    bitmaps = paths.vehicle_bitmaps(table)
    for first, last in ((1, 2), (2, 5), (1, 9), (8, 9)):
        got = {tuple(r.path): r.vehicles for r in paths.vehicles_between(bitmaps, f"2008-02-0{first}", f"2008-02-0{last}").collect()}
        want = {}
        for taxi, _, path, at in rows:
            if first <= int(at[9]) < last:
                for whole in ((1, 2), (1, 2, 3), (4, 5)):
                    if tuple(path[: len(whole)]) == whole:
                        want.setdefault(whole, set()).add(taxi)
        assert got == {p: len(v) for p, v in want.items()}


def test_views_have_no_nested_loop(spark):
    points = sources.from_events(spark, f"{DATA}/sf0.001")
    views = spark.createDataFrame(catalogue.VIEWS, "view int, lon double, lat double, zoom double, width int, height int")
    seen = viewport._in_boxes(points, viewport.with_boxes(views).select("view", "x_min", "y_min", "x_max", "y_max"))
    assert "NestedLoop" not in seen._jdf.queryExecution().executedPlan().toString()
    assert viewport.thin(points, views.limit(0)).collect() == []


def test_borders_equal_those_of_one_rectangle(spark):
    rects = list(catalogue.RECTS.values())
    rows = [(f"{i}{j}", tuple(map(float, a)), tuple(map(float, b))) for i, a in enumerate(rects) for j, b in enumerate(rects) if i != j]
    box = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
    pairs = spark.createDataFrame(rows, f"pair string, a {box}, b {box}")
    got = {r.pair: (r.border_a, r.border_b) for r in regions.with_borders(pairs).collect()}
    for i, a in enumerate(rects):
        for j, b in enumerate(rects):
            if i != j:
                assert got[f"{i}{j}"] == (routing.border(a, b), routing.border(b, a))


def test_sampled_vehicles_and_times_as_text(spark):
    points = spark.range(4_000).select(F.col("id").alias("taxi_id"))
    some = sources.sampled_vehicles(points, 0.3)
    assert 1_000 < some.count() < 1_400
    assert some.exceptAll(sources.sampled_vehicles(points.repartition(7), 0.3)).isEmpty()
    assert sources.sampled_vehicles(points, 1.0).count() == 4_000 and sources.sampled_vehicles(points, 0.0).isEmpty()
    texts = spark.createDataFrame([(59.5,), (60.0,), (61.0,), (2.5,), (90.0,)], "s double").select(routing.time_text(F.col("s"))).collect()
    assert [t[0] for t in texts] == ["60 s", "60 s", "1.0 min", "2 s", "1.5 min"]


@pytest.mark.parametrize("query", ["simplify_collinear", "smooth_polyline", "trajectory_like_line", "region_edge_grids", "nearest_grid_centers_k"])
def test_shapes_are_worked_out_once(spark, query):
    """Nothing that a line or a border is made from is worked out for a filter too."""
    plan = catalogue.queries()[query](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan()
    filters = []
    while plan.children().size():
        filters += [plan.expressions().mkString()] if plan.nodeName() == "Filter" else []
        plan = plan.children().apply(0)
    assert not any("lambda" in f for f in filters)
