"""The catalogue's queries in DuckDB's SQL, over the tables that the driver registers."""

from __future__ import annotations

import math

from roamgrid.catalogue import END, HOURS, OUT, START, VIEWS, A, B, C, RECTS
from roamgrid.config import BOUNDS, DEFAULT_SPEEDS, EXPAND_RATIOS, PATH_COLORS, PERIODS, VALID_BOX, Rect
from roamgrid.operators import od as od_ops
from roamgrid.operators.viewport import DETAILS


def d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def steps(size: int = 100, box: Rect = BOUNDS) -> tuple[float, float]:
    """Sides of a cell: a part of the box's sides."""
    return (box.x_max - box.x_min) / size, (box.y_max - box.y_min) / size


def cell_range(r: Rect) -> list[int]:
    """Cells of a rectangle's edges x_min, x_max, y_min, y_max, those outside as the first or the last."""
    at = [(r.x_min - BOUNDS.x_min) / DX, (r.x_max - BOUNDS.x_min) / DX, (r.y_min - BOUNDS.y_min) / DY, (r.y_max - BOUNDS.y_min) / DY]
    return [min(99, max(0, math.floor(v))) for v in at]


POINTS = """WITH b AS (SELECT event_id, user_id // 3 AS taxi_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 60000000) AS BIGINT) AS s FROM events),
k AS (SELECT *, (s // 240 + 7*(taxi_id % 3)) AS st FROM b),
points AS (SELECT event_id, taxi_id, TIMESTAMP '2008-02-02 06:30:00' + to_seconds(s) AS ts,
  CASE WHEN event_id % 101 = 0 THEN CAST(0 AS DOUBLE) WHEN event_id % 37 = 0 THEN CAST(117.05 AS DOUBLE)
       ELSE CAST(116200 + 10*abs(((st + 11*(taxi_id % 5)) % 60) - 30) + 60*(taxi_id%5) + 1 + event_id % 7 AS DOUBLE) / 1000.0::DOUBLE END AS lon,
  CASE WHEN event_id % 101 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(39600 + 7*abs((st % 40) - 20) + 35*(taxi_id%5) + 1 + event_id % 5 AS DOUBLE) / 1000.0::DOUBLE END AS lat FROM k)"""
DX, DY = steps()


def in_box(r: Rect) -> str:
    return f"(lon >= {d(r.x_min)} AND lon < {d(r.x_max)} AND lat >= {d(r.y_min)} AND lat < {d(r.y_max)})"


def in_rect(r: Rect) -> str:
    return f"(lon BETWEEN {d(r.x_min)} AND {d(r.x_max)} AND lat BETWEEN {d(r.y_min)} AND {d(r.y_max)})"


def cells(r: Rect, gid: str) -> str:
    x0, x1, y0, y1 = cell_range(r)
    return f"({gid} >= 0 AND {gid} % 100 BETWEEN {x0} AND {x1} AND {gid} // 100 BETWEEN {y0} AND {y1})"


def cell(name: str, low: float, step: float, size: int = 100) -> str:
    return f"CAST(least(floor(({name} - {d(low)}) / {d(step)}), {size - 1}) AS INTEGER)"


GID = f"CASE WHEN {in_box(BOUNDS)} THEN {cell('lat', BOUNDS.y_min, DY)} * 100 + {cell('lon', BOUNDS.x_min, DX)} ELSE -1 END"
PERIOD = "CASE WHEN hour(ts) IN (7, 8) THEN 0 WHEN hour(ts) IN (17, 18) THEN 1 ELSE 2 END"
CLON = lambda g: f"(({d(BOUNDS.x_min)} + ({g} % 100) * {d(DX)}) + ({d(BOUNDS.x_min)} + ({g} % 100 + 1) * {d(DX)})) / 2"
CLAT = lambda g: f"(({d(BOUNDS.y_min)} + ({g} // 100) * {d(DY)}) + ({d(BOUNDS.y_min)} + ({g} // 100 + 1) * {d(DY)})) / 2"


def meters(a: str, b: str, c: str, e: str) -> str:
    h = f"(sin(radians({e} - {b}) / 2) ** 2 + cos(radians({b})) * cos(radians({e})) * sin(radians({c} - {a}) / 2) ** 2)"
    return f"12742000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h}))"


TRIPS = f"""{POINTS},
g AS (SELECT *, {GID} AS gid, {PERIOD} AS period, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 300000000 THEN 1 ELSE 0 END AS brk FROM points WINDOW w AS (PARTITION BY taxi_id ORDER BY ts, event_id)),
t AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY taxi_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip_id, count(*) OVER (PARTITION BY taxi_id) AS of_vehicle FROM g),
trips AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY taxi_id, trip_id) AS n FROM t) WHERE n >= 2)"""
ENDS = f"""{TRIPS},
ends AS (SELECT taxi_id, trip_id, arg_min(gid, (ts, event_id)) AS start_grid, arg_max(gid, (ts, event_id)) AS end_grid, arg_min(period, (ts, event_id)) AS period FROM trips GROUP BY ALL)"""
OD = f"""{ENDS},
od AS (SELECT start_grid, end_grid, period, count(*) AS count FROM ends WHERE start_grid <> -1 AND end_grid <> -1 AND start_grid <> end_grid GROUP BY ALL)"""
SEQ = f"""{TRIPS},
runs AS (SELECT *, lag(gid) OVER (PARTITION BY taxi_id, trip_id ORDER BY ts, event_id) AS before FROM trips WHERE n >= 3 AND of_vehicle >= 5 AND gid <> -1),
seq AS (SELECT * FROM (SELECT taxi_id, trip_id, list(gid ORDER BY ts, event_id) AS path FROM runs WHERE before IS NULL OR before <> gid GROUP BY ALL) WHERE len(path) >= 2)"""
FREQ = f"""{SEQ},
pre AS (SELECT taxi_id, path[1:i] AS path FROM seq, (SELECT unnest(range(2, 200)) AS i) WHERE i <= len(path)),
freq AS (SELECT path, count(DISTINCT taxi_id) AS vehicles, count(*) AS trips FROM pre WHERE path IN (SELECT path FROM seq) GROUP BY path),
legs AS (SELECT path, unnest(path[1:len(path)-1]) AS a, unnest(path[2:]) AS c FROM freq),
dist AS (SELECT path, sum({meters(CLON('a'), CLAT('a'), CLON('c'), CLAT('c'))}) AS distance FROM legs GROUP BY path),
ranked AS (SELECT *, len(path) AS path_len FROM freq JOIN dist USING (path))"""
NODES = f"""{POINTS},
nth AS (SELECT *, row_number() OVER (PARTITION BY taxi_id ORDER BY ts, event_id) - 1 AS rn FROM points),
cellxy AS (SELECT DISTINCT {cell('lon', BOUNDS.x_min, DX)} AS gx, {cell('lat', BOUNDS.y_min, DY)} AS gy FROM nth WHERE rn % 3 = 0 AND {in_rect(BOUNDS)}),
nodes AS (SELECT CAST(gy * 100 + gx AS BIGINT) AS node, gx, gy, {d(BOUNDS.x_min)} + (gx + 0.5::DOUBLE) * {d(DX)} AS lon, {d(BOUNDS.y_min)} + (gy + 0.5::DOUBLE) * {d(DY)} AS lat FROM cellxy)"""
EDGES0 = f"""{NODES},
pairs AS (SELECT a.node AS src, b.node AS dst, {meters('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS meters FROM nodes a JOIN nodes b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.node <> b.node),
speeds(period, speed) AS (VALUES {', '.join(f'({p}, {d(s)})' for p, s in DEFAULT_SPEEDS.items())}),
defaults AS (SELECT src, dst, period, meters, meters / speed AS seconds FROM pairs, speeds)"""


def samples(known: bool) -> str:
    where = "WHERE u IN (SELECT node FROM nodes)" if known else ""
    return f"""
here AS (SELECT * FROM (SELECT *, CAST({cell('lat', BOUNDS.y_min, DY)} * 100 + {cell('lon', BOUNDS.x_min, DX)} AS BIGINT) AS u FROM points WHERE {in_rect(BOUNDS)}) {where}),
moves AS (SELECT *, lead(u) OVER w AS v, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0::DOUBLE AS seconds FROM here WINDOW w AS (PARTITION BY taxi_id ORDER BY ts, event_id)),
samples AS (SELECT u, v, {PERIOD} AS period, seconds, taxi_id, event_id AS first_id FROM moves WHERE u <> v AND seconds BETWEEN 1 AND 300),
medians AS (SELECT u, v, period, count(*) AS samples, least(median(seconds), 600.0::DOUBLE) AS seconds, min((taxi_id, first_id)) AS first FROM samples GROUP BY u, v, period HAVING count(*) >= 3)"""


EDGES = f"""{EDGES0},{samples(True)},
learned AS (SELECT least(u, v) AS a, greatest(u, v) AS b, period, arg_max(seconds, (first, u)) AS learned FROM medians GROUP BY ALL),
edges AS (SELECT src, dst, defaults.period, least(defaults.seconds, coalesce(learned, defaults.seconds)) AS seconds FROM defaults LEFT JOIN learned ON a = least(src, dst) AND b = greatest(src, dst) AND learned.period = defaults.period)"""


def spread(start_sql: str) -> str:
    """Least times from every (start, period) of a query, by relaxation."""
    body = EDGES.replace("WITH b AS", "WITH RECURSIVE b AS", 1)
    return f"""{body}, sources AS ({start_sql}),
best(start, period, node, seconds) USING KEY (start, period, node) AS (
  SELECT start, period, start, 0.0::DOUBLE FROM sources
  UNION
  SELECT x.start, x.period, x.node, min(x.seconds) FROM (SELECT f.start, f.period, e.dst AS node, f.seconds + e.seconds AS seconds FROM best f JOIN edges e ON e.src = f.node AND e.period = f.period) x
  LEFT JOIN recurring.best r ON r.start = x.start AND r.period = x.period AND r.node = x.node WHERE r.seconds IS NULL OR x.seconds < r.seconds GROUP BY ALL)"""


def walked(ends_sql: str) -> str:
    """Routes to the (start, period, ends) of a query, from the smallest node before each, as CTEs after ``best`` up to ``routes``."""
    return f""", prev AS (SELECT b.start, b.period, e.dst AS node, min(e.src) AS before FROM best b JOIN edges e ON e.src = b.node AND e.period = b.period
  JOIN best t ON t.start = b.start AND t.period = b.period AND t.node = e.dst AND t.seconds = b.seconds + e.seconds WHERE e.dst <> b.start GROUP BY ALL),
walk(start, period, ends, node, route) AS (SELECT start, period, ends, ends, CAST(ends AS VARCHAR) FROM ({ends_sql})
  UNION ALL SELECT w.start, w.period, w.ends, p.before, p.before || '>' || w.route FROM walk w JOIN prev p ON p.start = w.start AND p.period = w.period AND p.node = w.node),
routes AS (SELECT w.start, w.period, w.ends, b.seconds, w.route FROM walk w JOIN best b ON b.start = w.start AND b.period = w.period AND b.node = w.ends WHERE w.node = w.start)"""


def region_cells_sql(r: Rect) -> str:
    return f"(SELECT gid, {CLON('gid')} AS lon, {CLAT('gid')} AS lat FROM (SELECT unnest(range(0, 10000)) AS gid) WHERE {cells(r, 'gid')} AND {CLON('gid')} BETWEEN {d(r.x_min)} AND {d(r.x_max)} AND {CLAT('gid')} BETWEEN {d(r.y_min)} AND {d(r.y_max)})"


def edge_cells_sql(r: Rect, away: Rect | None = None) -> str:
    ext = f"(SELECT *, gid % 100 AS x, gid // 100 AS y, min(gid % 100) OVER () AS x0, max(gid % 100) OVER () AS x1, min(gid // 100) OVER () AS y0, max(gid // 100) OVER () AS y1 FROM {region_cells_sql(r)})"
    edge = f"SELECT * FROM {ext} WHERE x IN (x0, x1) OR y IN (y0, y1)"
    if away is None:
        return f"(SELECT gid, lon, lat FROM ({edge}))"
    dx, dy = (away.center[i] - r.center[i] for i in (0, 1))
    side = ("x = x0" if dx > 0 else "x = x1") if abs(dx) > abs(dy) else ("y = y0" if dy > 0 else "y = y1")
    return f"(SELECT gid, lon, lat FROM (SELECT *, sum(CAST(NOT gone AS INTEGER)) OVER () AS stay FROM (SELECT *, {side} AND count(*) OVER () > 4 AS gone FROM ({edge}))) WHERE NOT gone OR stay = 0)"


def near_sql(of: str, among: str, k: int) -> str:
    return f"(SELECT * FROM (SELECT o.gid, a.gid AS other, row_number() OVER (PARTITION BY o.gid ORDER BY sqrt((a.lon - o.lon) * (a.lon - o.lon) + (a.lat - o.lat) * (a.lat - o.lat)), a.gid) AS rank FROM {of} o, {among} a) WHERE rank <= {k})"


def nearest_sql(places: str) -> str:
    """The nearest node, in the buckets around if there is one, for rows (place, lon, lat)."""
    near = "abs(floor(p.lon / 0.01::DOUBLE) - floor(n.lon / 0.01::DOUBLE)) <= 2 AND abs(floor(p.lat / 0.01::DOUBLE) - floor(n.lat / 0.01::DOUBLE)) <= 2"
    return f"(SELECT place, node, meters FROM (SELECT p.place, n.node, {meters('p.lon', 'p.lat', 'n.lon', 'n.lat')} AS meters, row_number() OVER (PARTITION BY p.place ORDER BY NOT ({near}), {meters('p.lon', 'p.lat', 'n.lon', 'n.lat')}, n.node) AS rn FROM {places} p, nodes n) WHERE rn = 1)"


def density_sql(ratios, size: int = 100) -> str:
    parts = []
    for r in ratios:
        box = BOUNDS.expanded(r)
        dx, dy = steps(size, box)
        parts.append(f"SELECT {d(r)} AS ratio, {PERIOD} AS period, {cell('lon', box.x_min, dx, size)} AS gx, {cell('lat', box.y_min, dy, size)} AS gy FROM points WHERE {in_box(box)}")
    return f"{POINTS}, placed AS ({' UNION ALL '.join(parts)}), dens AS (SELECT ratio, period, gx, gy, count(*) AS n FROM placed GROUP BY ALL)"


def sectors(rel: str) -> str:
    dx, dy = f"{CLON('end_grid')} - {CLON('start_grid')}", f"{CLAT('end_grid')} - {CLAT('start_grid')}"
    turn = f"((atan2({dy}, {dx}) + pi()) / (2 * pi()))"
    return f"(SELECT *, CAST(floor({turn} * 8) % 8 AS INTEGER) AS sector, CAST(floor({turn} * 4) % 4 AS INTEGER) AS quadrant FROM {rel})"


REGION_PATHS = f"(SELECT *, CASE WHEN {cells(C, 'start_grid')} THEN '{od_ops.OUT}' ELSE '{od_ops.IN}' END AS direction FROM od WHERE {cells(C, 'start_grid')} <> {cells(C, 'end_grid')})"
ARC_ORDER = "count DESC, start_grid, end_grid, period, direction"


def by_period(values: dict) -> str:
    return "CASE period " + " ".join(f"WHEN {p} THEN {v}" for p, v in values.items()) + " END"


def _colors() -> str:
    main, other = ({p: f"'{'/'.join(map(str, c))}'" for p, c in part.items()} for part in od_ops.COLORS["region"])
    return f"CASE WHEN direction = '{od_ops.OUT}' THEN {by_period(main)} ELSE {by_period(other)} END"


def _top(where: str, order: str, score: str) -> str:
    return f"{FREQ} SELECT array_to_string(path, '>') AS path, vehicles, CAST(path_len AS INTEGER) AS path_len, round_even(distance, 0) AS distance, round({score}, 6) AS score FROM ranked WHERE {where} ORDER BY {order} LIMIT 10"


BONUS = "vehicles * (1 + least(1.25::DOUBLE, ln(1 + greatest(0, path_len - 2)) * 0.18::DOUBLE))"


def _thin(views: str, points: str) -> str:
    """CTEs up to ``thinned``: view, event_id, taxi_id, lon, lat, vx, vy of the points of some views."""
    most = "CASE " + " ".join(f"WHEN zoom <= {x.upto_zoom} THEN {x.max_points}" for x in DETAILS[:-1]) + f" ELSE {DETAILS[-1].max_points} END"
    pixel = "(360.0::DOUBLE / 512 / pow(2.0::DOUBLE, zoom))"
    clamp = lambda x: f"CAST(greatest(4, least(72, floor({x}))) AS BIGINT)"
    return f"""views(view, lon0, lat0, zoom, width, height) AS ({views}),
wide AS (SELECT *, {pixel} * width / 2 AS ax, {pixel} * height / 2 / greatest(cos(radians(lat0)), 0.01::DOUBLE) AS ay, {most} AS most FROM views),
boxes AS (SELECT *, lon0 - ax AS x_min, lat0 - ay AS y_min, lon0 + ax AS x_max, lat0 + ay AS y_max FROM wide),
shaped AS (SELECT *, {clamp('floor(sqrt(most)) * sqrt((x_max - x_min) / (y_max - y_min))')} AS cols, {clamp('floor(sqrt(most)) / sqrt((x_max - x_min) / (y_max - y_min))')} AS rws FROM boxes),
seen AS (SELECT s.*, p.*, row_number() OVER (PARTITION BY view ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY view) AS total FROM {points} p JOIN shaped s ON lon BETWEEN x_min AND x_max AND lat BETWEEN y_min AND y_max),
pool AS (SELECT *, CAST(least(cols - 1, floor((lon - x_min) / (x_max - x_min) * cols)) AS INTEGER) AS vx, CAST(least(rws - 1, floor((lat - y_min) / (y_max - y_min) * rws)) AS INTEGER) AS vy FROM seen WHERE total <= 12 * most OR rn % greatest(1, total // (12 * most)) = 0),
thinned AS (SELECT view, min(event_id) AS event_id, arg_min(taxi_id, event_id) AS taxi_id, arg_min(lon, event_id) AS lon, arg_min(lat, event_id) AS lat, vx, vy FROM pool GROUP BY view, vx, vy)"""


def _payload() -> str:
    state = f"""state AS (SELECT round((min(lon) + max(lon)) / 2, 9) AS longitude, round((min(lat) + max(lat)) / 2, 9) AS latitude, CASE WHEN greatest(max(lon) - min(lon), max(lat) - min(lat), 0.01) > 0.15 THEN 11.0::DOUBLE WHEN greatest(max(lon) - min(lon), max(lat) - min(lat), 0.01) > 0.06 THEN 12.0::DOUBLE ELSE 13.0::DOUBLE END AS zoom FROM found)"""
    dots = """'{"lon":' || lon || ',"lat":' || lat || ',"taxi_id":' || taxi_id || ',"radius":16}'"""
    return f"""{POINTS}, found AS (SELECT * FROM points WHERE {in_rect(C)}), {state}, {_thin("SELECT 0, longitude, latitude, zoom, 1200, 800 FROM state", "found")}
SELECT '{{"viewState":{{"longitude":' || longitude || ',"latitude":' || latitude || ',"zoom":' || zoom || '}},"layers":[{{"type":"scatter","id":"points","data":[' || (SELECT string_agg({dots}, ',' ORDER BY event_id) FROM thinned) || ']}}],"meta":{{"rect":"C"}},"lockViewport":false}}' AS payload FROM state"""


SHOWN = f"""{SEQ},
walks AS (SELECT taxi_id, trip_id, list({{'lon': lon, 'lat': lat, 'gid': gid}} ORDER BY ts, event_id) AS every FROM trips WHERE n >= 3 AND of_vehicle >= 5 GROUP BY ALL),
plausible AS (SELECT *, list_filter(every, lambda x: x.lon BETWEEN {d(VALID_BOX.x_min)} AND {d(VALID_BOX.x_max)} AND x.lat BETWEEN {d(VALID_BOX.y_min)} AND {d(VALID_BOX.y_max)}) AS valid FROM walks),
gridded AS (SELECT *, list_filter(valid, lambda x: x.gid <> -1) AS inside FROM plausible),
changed AS (SELECT *, [inside[i] for i in range(1, len(inside) + 1) if i = 1 OR inside[i - 1].gid <> inside[i].gid] AS stops FROM gridded),
strode AS (SELECT *, [stops[i] for i in range(1, len(stops) + 1) if (i - 1) % greatest(1, len(stops) // 800) = 0] AS picked FROM changed),
shown AS (SELECT taxi_id, trip_id, list_transform(CASE WHEN len(valid) < 2 THEN [every[1], every[-1]] WHEN len(stops) < 2 THEN [valid[1], valid[-1]] WHEN len(stops) <= 800 THEN stops
  WHEN picked[-1].lon = valid[-1].lon AND picked[-1].lat = valid[-1].lat THEN picked ELSE list_append(picked, valid[-1]) END, lambda x: [x.lon, x.lat]) AS coords FROM strode)"""
PLACES = f"""{SHOWN},
l AS (SELECT taxi_id, trip_id, generate_subscripts(coords, 1) - 1 AS place, unnest(coords) AS c FROM shown),
places AS (SELECT taxi_id, trip_id, place, c[1] AS lon, c[2] AS lat FROM l)"""
LINE_TEXT = "array_to_string(list_transform(coords, lambda c: printf('%.4f %.4f', c[1], c[2])), ',')"
PATH_TEXT = "array_to_string(path, '>')"
AT = "PARTITION BY taxi_id, trip_id ORDER BY place"


def _smooth(src: str, alpha: float) -> str:
    """Two rounds of smoothing of ``src``, as CTEs up to ``smooth2``."""
    move = lambda c: f"CASE WHEN lag({c}) OVER w IS NULL OR lead({c}) OVER w IS NULL THEN {c} ELSE {c} * {d(1 - alpha)} + ((lag({c}) OVER w + lead({c}) OVER w) / 2) * {d(alpha)} END AS {c}"
    step = lambda name, of: f"{name} AS (SELECT taxi_id, trip_id, place, {move('lon')}, {move('lat')} FROM {of} WINDOW w AS ({AT}))"
    return f"{step('smooth1', src)}, {step('smooth2', 'smooth1')}"


def _thinned_line(src: str, name: str, most: int) -> str:
    """``src`` subsampled, as CTEs up to ``name``."""
    return f"""{name}_n AS (SELECT *, count(*) OVER (PARTITION BY taxi_id, trip_id) AS n FROM {src}),
{name}_k AS (SELECT *, greatest(1, (n - 1) // {most - 1}) AS step FROM {name}_n),
{name} AS (SELECT taxi_id, trip_id, row_number() OVER ({AT}) - 1 AS place, lon, lat FROM {name}_k WHERE n <= {most} OR place % step = 0 OR place = n - 1 QUALIFY row_number() OVER ({AT}) <= {most})"""


def _trajectory_like() -> str:
    between = f"""dense AS (SELECT taxi_id, trip_id, row_number() OVER (PARTITION BY taxi_id, trip_id ORDER BY place, t) - 1 AS place, CASE WHEN t = 0 THEN lon ELSE lon + (lon2 - lon) * (t / 7::DOUBLE) END AS lon, CASE WHEN t = 0 THEN lat ELSE lat + (lat2 - lat) * (t / 7::DOUBLE) END AS lat
FROM (SELECT *, lead(lon) OVER (PARTITION BY taxi_id, trip_id ORDER BY place) AS lon2, lead(lat) OVER (PARTITION BY taxi_id, trip_id ORDER BY place) AS lat2 FROM few), (SELECT unnest(range(0, 7)) AS t) WHERE t = 0 OR lon2 IS NOT NULL)"""
    return f"""{PLACES}, {_thinned_line('places', 'few', 120)}, {between}, {_thinned_line('dense', 'many', 360)}, {_smooth('many', 0.24)}
SELECT taxi_id, trip_id, CAST(place AS INTEGER) AS place, round(lon, 9) AS lon, round(lat, 9) AS lat FROM smooth2"""


def _simplify() -> str:
    body = PLACES.replace("WITH b AS", "WITH RECURSIVE b AS", 1)
    cross = "abs((p.lon - w.klon) * (q.lat - p.lat) - (p.lat - w.klat) * (q.lon - p.lon)) > 1e-12"
    return f"""{body}, sized AS (SELECT *, count(*) OVER (PARTITION BY taxi_id, trip_id) AS n FROM places),
walk AS (SELECT taxi_id, trip_id, place, n, lon AS klon, lat AS klat, true AS keep FROM sized WHERE place = 0
  UNION ALL
  SELECT p.taxi_id, p.trip_id, p.place, p.n, CASE WHEN {cross} THEN p.lon ELSE w.klon END, CASE WHEN {cross} THEN p.lat ELSE w.klat END, coalesce({cross}, true) FROM walk w
  JOIN sized p ON p.taxi_id = w.taxi_id AND p.trip_id = w.trip_id AND p.place = w.place + 1 LEFT JOIN sized q ON q.taxi_id = p.taxi_id AND q.trip_id = p.trip_id AND q.place = p.place + 1)
SELECT taxi_id, trip_id, CAST(row_number() OVER ({AT}) - 1 AS INTEGER) AS place, round(lon, 9) AS lon, round(lat, 9) AS lat FROM walk JOIN places USING (taxi_id, trip_id, place) WHERE keep"""


def _display() -> dict[str, str]:
    """Paths and the recorded trips that show them."""
    between = f"SELECT path FROM ranked WHERE {cells(A, 'path[1]')} AND {cells(B, 'path[len(path)]')} AND path_len BETWEEN 2 AND 15 ORDER BY vehicles DESC, distance DESC, ranked.path LIMIT 10"
    frequent = FREQ.split("FROM k),", 1)[1]
    seq = SEQ.split("FROM k),", 1)[1]
    shown = SHOWN.split(seq, 1)[1]
    ends = ENDS.split(TRIPS, 1)[1]
    od = OD.split(ENDS, 1)[1]
    base = f"""{FREQ}{ends}{od}{shown},
asked AS (SELECT DISTINCT path FROM (SELECT * FROM ({between}) UNION ALL SELECT [start_grid, end_grid] FROM od WHERE {cells(A, 'start_grid')} AND {cells(B, 'end_grid')})),
lines AS (SELECT taxi_id, trip_id, path, coords FROM seq JOIN shown USING (taxi_id, trip_id) WHERE len(coords) >= 2),
known AS (SELECT path, arg_max(coords, (len(coords), -taxi_id, -trip_id)) AS coords FROM seq JOIN shown USING (taxi_id, trip_id) GROUP BY path),
tried AS (SELECT a.path, l.taxi_id, l.trip_id, l.coords, l.path = a.path AS exact, row_number() OVER (PARTITION BY a.path ORDER BY l.path <> a.path, CASE WHEN l.path = a.path THEN 0 ELSE -len(l.coords) END, l.taxi_id, l.trip_id) AS rn FROM asked a JOIN lines l ON l.path[1] = a.path[1] AND l.path[-1] = a.path[-1]),
recorded AS (SELECT path, taxi_id, trip_id, coords, exact FROM tried WHERE rn = 1),
turns AS (SELECT taxi_id, trip_id, every[1] AS p, every[-1] AS q FROM walks),
crossing AS (SELECT * FROM (SELECT taxi_id, trip_id, coalesce({cells(A, 'path[1]')} AND {cells(B, 'path[-1]')}, false) AS by_cells,
  (p.lon BETWEEN {d(A.x_min)} AND {d(A.x_max)} AND p.lat BETWEEN {d(A.y_min)} AND {d(A.y_max)} AND q.lon BETWEEN {d(B.x_min)} AND {d(B.x_max)} AND q.lat BETWEEN {d(B.y_min)} AND {d(B.y_max)}) AS by_points
  FROM turns LEFT JOIN seq USING (taxi_id, trip_id)) WHERE by_cells OR by_points),
region AS (SELECT arg_min(taxi_id, (-len(coords), taxi_id, trip_id)) AS taxi_id, arg_min(trip_id, (-len(coords), taxi_id, trip_id)) AS trip_id, arg_min(coords, (-len(coords), taxi_id, trip_id)) AS coords FROM crossing JOIN shown USING (taxi_id, trip_id))"""
    centres = f"list_transform(path, lambda g: [{CLON('g')}, {CLAT('g')}])"
    cascade = lambda r, g: f"""SELECT asked.path AS path, CASE WHEN len(k.coords) >= 2 THEN 'exemplar' WHEN len({r}) >= 2 THEN 'trip' WHEN len({g}) >= 2 THEN 'region' ELSE 'grid' END AS shown,
  CASE WHEN len(k.coords) >= 2 THEN k.coords WHEN len({r}) >= 2 THEN {r} WHEN len({g}) >= 2 THEN {g} ELSE {centres.replace('path,', 'asked.path,', 1)} END AS coords FROM asked LEFT JOIN known k ON k.path = asked.path LEFT JOIN recorded r ON r.path = asked.path, region g"""  # noqa: E731
    none = "NULL::DOUBLE[][]"
    return {
        "path_exemplars": f"{base} SELECT {PATH_TEXT} AS path, {LINE_TEXT} AS coords FROM known",
        "path_vehicle_counts": f"{base} SELECT {PATH_TEXT} AS path, coalesce(vehicles, 0) AS vehicles FROM asked LEFT JOIN freq USING (path)",
        "trips_crossing_regions": f"{base} SELECT * FROM crossing",
        "region_trip": f"{base} SELECT taxi_id, trip_id, {LINE_TEXT} AS coords FROM region",
        "recorded_trips_of_paths": f"{base} SELECT {PATH_TEXT} AS path, taxi_id, trip_id, {LINE_TEXT} AS coords, exact FROM recorded",
        "shown_paths": f"{base} SELECT {PATH_TEXT} AS path, shown, {LINE_TEXT} AS coords FROM ({cascade('r.coords', 'g.coords')})",
        "display_hint": f"{base}, c AS (SELECT count(*) FILTER (shown <> 'grid') AS hits, count(*) AS total FROM ({cascade(none, none)})) SELECT hits, total, CASE WHEN total > 0 AND hits = 0 THEN 'no recorded trip was found; lines follow the grid or the roads' WHEN total > 0 AND hits < total THEN printf('%d paths have no recorded trip and are drawn along the grid', total - hits) END AS hint FROM c",
    }


def _region_route() -> str:
    edge_a, edge_b = edge_cells_sql(A, B), edge_cells_sql(B, A)
    pairs = f"""SELECT gid AS s, other AS e FROM {near_sql('ea', 'eb', 8)} WHERE (SELECT count(*) FROM ea) <= (SELECT count(*) FROM eb) UNION ALL SELECT other, gid FROM {near_sql('eb', 'ea', 8)} WHERE (SELECT count(*) FROM ea) > (SELECT count(*) FROM eb)"""
    body = spread("SELECT DISTINCT node AS start, 2 AS period FROM near_a JOIN pair ON place = s").replace(
        ", sources AS", f", ea AS {edge_a}, eb AS {edge_b}, pair AS ({pairs}), near_a AS {nearest_sql('(SELECT gid AS place, lon, lat FROM ea)')}, near_b AS {nearest_sql('(SELECT gid AS place, lon, lat FROM eb)')}, sources AS", 1
    )
    ends = "SELECT start, 2 AS period, ends FROM (SELECT near_a.node AS start, near_b.node AS ends FROM met JOIN near_a ON near_a.place = s JOIN near_b ON near_b.place = e ORDER BY seconds, s, e LIMIT 1)"
    return f"""{body}, met AS (SELECT s, e, seconds FROM pair JOIN near_a ON near_a.place = s JOIN near_b ON near_b.place = e JOIN best ON best.start = near_a.node AND best.node = near_b.node){walked(ends)}
SELECT start_grid, end_grid, seconds, searched, route, route AS cells, CASE WHEN seconds > 60 THEN printf('%.1f min', seconds / 60) ELSE printf('%d s', CAST(round_even(seconds, 0) AS BIGINT)) END AS time
FROM (SELECT arg_min(s, (seconds, s, e)) AS start_grid, arg_min(e, (seconds, s, e)) AS end_grid, round(min(seconds), 4) AS seconds, (SELECT count(*) FROM pair) AS searched FROM met HAVING count(*) > 0), (SELECT route FROM routes)"""


def _layers() -> str:
    """Layers of paths, arcs, heat and rectangles as JSON texts."""
    box = BOUNDS.expanded(0.05)
    dx, dy = steps(10, box)
    point = lambda g: f"'[' || round({CLON(g)}, 6) || ',' || round({CLAT(g)}, 6) || ']'"
    od = OD.split(TRIPS, 1)[1]
    jitter = "((start_grid * 13 + end_grid * 7) % 15) * 0.015::DOUBLE"
    height = f"greatest(0.10::DOUBLE, {by_period({p: d(h) for p, h in od_ops.BASE_HEIGHT.items()})} + ((sector - 3.5::DOUBLE) * 0.06::DOUBLE + (quadrant - 1.5::DOUBLE) * 0.09::DOUBLE + CASE WHEN direction = '{od_ops.OUT}' THEN 0.10::DOUBLE ELSE 0.03::DOUBLE END) + {jitter})"
    at = lambda x, y: f"'[' || {d(x)} || ',' || {d(y)} || ']'"
    rings = " UNION ALL ".join(
        f"SELECT '{n}' AS rect, '{{\"rect\":\"{n}\",\"polygon\":[' || concat_ws(',', {at(r.x_min, r.y_min)}, {at(r.x_max, r.y_min)}, {at(r.x_max, r.y_max)}, {at(r.x_min, r.y_max)}, {at(r.x_min, r.y_min)}) || ']}}' AS data" for n, r in RECTS.items()
    )
    return f"""{FREQ}{od}, best AS (SELECT * FROM ranked WHERE path_len >= 2 ORDER BY {BONUS} DESC, vehicles DESC, distance DESC, ranked.path LIMIT 10),
placed AS (SELECT *, row_number() OVER (ORDER BY vehicles DESC, distance DESC, path) - 1 AS place FROM best),
lines AS (SELECT place, '{{"path":[' || array_to_string(list_transform(path, lambda g: {point('g')}), ',') || '],"width":' || (2 + least(8.0::DOUBLE, vehicles / 50::DOUBLE)) || ',"color":"' || [{', '.join(repr('/'.join(map(str, c))) for c in PATH_COLORS)}][place % 6 + 1] || '"}}' AS data FROM placed),
tops AS (SELECT * FROM {REGION_PATHS} ORDER BY {ARC_ORDER} LIMIT 20),
arcs AS (SELECT row_number() OVER (ORDER BY {ARC_ORDER}) AS place, '{{"source_lon":' || round({CLON('start_grid')}, 6) || ',"source_lat":' || round({CLAT('start_grid')}, 6) || ',"target_lon":' || round({CLON('end_grid')}, 6) || ',"target_lat":' || round({CLAT('end_grid')}, 6)
  || ',"width":' || round(least(8.0::DOUBLE, 1 + log10(count + 1) * 1.5::DOUBLE), 6) || ',"height":' || round({height}, 6) || ',"color":"' || {_colors()} || '"}}' AS data FROM {sectors('tops')}),
heat AS (SELECT gy, gx, '{{"lon":' || (gx + 0.5::DOUBLE) || ',"lat":' || (gy + 0.5::DOUBLE) || ',"weight":' || count(*) || '}}' AS data FROM (SELECT {cell('lon', box.x_min, dx, 10)} AS gx, {cell('lat', box.y_min, dy, 10)} AS gy FROM points WHERE {in_box(BOUNDS)}) GROUP BY gx, gy),
rings AS ({rings})
SELECT type, CAST(places AS INTEGER) AS places, data FROM (SELECT 'path' AS type, count(*) AS places, '[' || string_agg(data, ',' ORDER BY place) || ']' AS data FROM lines
UNION ALL SELECT 'arc', count(*), '[' || string_agg(data, ',' ORDER BY place) || ']' FROM arcs
UNION ALL SELECT 'heatmap', count(*), '[' || string_agg(data, ',' ORDER BY gy, gx) || ']' FROM heat
UNION ALL SELECT 'polygon', count(*), '[' || string_agg(data, ',' ORDER BY rect) || ']' FROM rings)"""


def _endpoints() -> str:
    places = {"A": A.center, "OUT": OUT.center, "place": (116.42, 39.71), "far": (110.0, 30.0)}
    rows = ", ".join(f"('{n}', {d(x)}, {d(y)})" for n, (x, y) in places.items())
    near = nearest_sql("(SELECT name AS place, lon, lat FROM asked)")
    m = meters("a.lon", "a.lat", "n.lon", "n.lat")
    inside = " UNION ALL ".join(f"(SELECT '{n}' AS place, n.node, {m} AS meters FROM asked a, nodes n WHERE a.name = '{n}' AND {in_rect(r).replace('lon', 'n.lon').replace('lat', 'n.lat')} ORDER BY 3, 2 LIMIT 1)" for n, r in (("A", A), ("OUT", OUT)))
    return f"{NODES}, asked(name, lon, lat) AS (VALUES {rows}), inside AS ({inside}), anywhere AS {near} SELECT place AS asked, node, round(meters, 3) AS meters FROM (SELECT * FROM inside UNION ALL SELECT * FROM anywhere WHERE place NOT IN (SELECT place FROM inside))"


BOXES = f"""{TRIPS.replace("FROM points WINDOW", f"FROM (SELECT * FROM points WHERE {in_box(BOUNDS)}) WINDOW")},
boxes AS (SELECT taxi_id, trip_id, taxi_id || '/' || trip_id AS box, min(lon) AS x_min, min(lat) AS y_min, max(lon) AS x_max, max(lat) AS y_max FROM trips GROUP BY taxi_id, trip_id)"""
_AT = lambda edge, low, step: f"CAST(greatest(0, least(99, floor(({edge} - {d(low)}) / {d(step)}))) AS INTEGER)"
_TOUCHED = f"""unnest(range({_AT('y_min', BOUNDS.y_min, DY)}, {_AT('y_max', BOUNDS.y_min, DY)} + 1)) AS y"""
_TOUCHED_X = f"""unnest(range({_AT('x_min', BOUNDS.x_min, DX)}, {_AT('x_max', BOUNDS.x_min, DX)} + 1)) AS x"""
BORDERS = f"""{BOXES},
pairs AS (SELECT * FROM (SELECT box AS pair, x_min, y_min, x_max, y_max, lead(x_min) OVER w AS bx_min, lead(y_min) OVER w AS by_min, lead(x_max) OVER w AS bx_max, lead(y_max) OVER w AS by_max FROM boxes WINDOW w AS (PARTITION BY taxi_id ORDER BY trip_id)) WHERE bx_min IS NOT NULL),
sides AS (SELECT pair, 'a' AS rect, x_min, y_min, x_max, y_max, (bx_min + bx_max) / 2 - (x_min + x_max) / 2 AS across, (by_min + by_max) / 2 - (y_min + y_max) / 2 AS up FROM pairs
  UNION ALL SELECT pair, 'b', bx_min, by_min, bx_max, by_max, (x_min + x_max) / 2 - (bx_min + bx_max) / 2, (y_min + y_max) / 2 - (by_min + by_max) / 2 FROM pairs),
touched AS (SELECT *, y * 100 + x AS gid FROM (SELECT *, {_TOUCHED_X} FROM (SELECT *, {_TOUCHED} FROM sides))),
held AS (SELECT *, min(x) OVER s AS x0, max(x) OVER s AS x1, min(y) OVER s AS y0, max(y) OVER s AS y1 FROM touched WHERE {CLON('gid')} BETWEEN x_min AND x_max AND {CLAT('gid')} BETWEEN y_min AND y_max WINDOW s AS (PARTITION BY pair, rect)),
edged AS (SELECT *, count(*) OVER (PARTITION BY pair, rect) AS n, CASE WHEN abs(across) > abs(up) THEN x = CASE WHEN across > 0 THEN x0 ELSE x1 END ELSE y = CASE WHEN up > 0 THEN y0 ELSE y1 END END AS gone FROM held WHERE x IN (x0, x1) OR y IN (y0, y1)),
border AS (SELECT pair, rect, gid FROM (SELECT *, sum(CAST(NOT gone AS INTEGER)) OVER (PARTITION BY pair, rect) AS stay FROM edged) WHERE n <= 4 OR NOT gone OR stay = 0)"""


def _adaptive(depth: int = 16, capacity: int = 10) -> str:
    """Points down the tree, level by level, as CTEs up to ``walk``."""
    part = lambda c, low, high: f"CAST(least(floor(({c} - {d(low)}) / {d((high - low) / 2**depth)}), {2**depth - 1}) AS BIGINT)"
    cx, cy = f"fx >> ({depth - 1} - level)", f"fy >> ({depth - 1} - level)"
    return f"""{POINTS.replace("WITH b", "WITH RECURSIVE b", 1)}, placed AS (SELECT {part('lon', BOUNDS.x_min, BOUNDS.x_max)} AS fx, {part('lat', BOUNDS.y_min, BOUNDS.y_max)} AS fy FROM points WHERE {in_box(BOUNDS)}),
walk(level, cx, cy, fx, fy, n) AS (SELECT 0, 0::BIGINT, 0::BIGINT, fx, fy, count(*) OVER () FROM placed
  UNION ALL SELECT level + 1, {cx}, {cy}, fx, fy, count(*) OVER (PARTITION BY {cx}, {cy}) FROM walk WHERE n > {capacity} AND level < {depth}),
cell AS (SELECT DISTINCT level, cx, cy, n, n <= {capacity} OR level = {depth} AS leaf FROM walk)"""


def _quota(cap: int = 40) -> str:
    return f"""{OD}, arcs AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY {ARC_ORDER}) AS rank FROM {sectors(REGION_PATHS)}),
flows AS (SELECT sector, CAST(sum(greatest(1, count)) AS BIGINT) AS flow FROM arcs GROUP BY sector),
raw AS (SELECT *, greatest(0, {cap} - count(*) OVER ()) AS room, greatest(0, {cap} - count(*) OVER ()) * (flow / CAST(sum(flow) OVER () AS DOUBLE)) AS raw FROM flows),
base AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base, row_number() OVER (ORDER BY raw - floor(raw) DESC, sector) AS nth FROM raw),
quota AS (SELECT sector, 1 + base + CASE WHEN nth <= room - CAST(sum(base) OVER () AS BIGINT) THEN 1 ELSE 0 END AS quota FROM base)
SELECT start_grid, end_grid, period, direction, count, arcs.sector FROM arcs JOIN quota USING (sector) ORDER BY CAST(rank > quota AS INTEGER), {ARC_ORDER} LIMIT {cap}"""


def oracle_sql() -> dict[str, str]:
    stride = f"""{POINTS}, inside AS (SELECT *, row_number() OVER (PARTITION BY taxi_id ORDER BY event_id) - 1 AS rn FROM points WHERE {in_box(BOUNDS)}),
offs AS (SELECT taxi_id, CAST(coalesce(sum(count(*)) OVER (ORDER BY taxi_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) % 15 AS off FROM inside GROUP BY taxi_id),
sampled AS (SELECT * FROM inside JOIN offs USING (taxi_id) WHERE rn >= off AND (rn - off) % 15 = 0)"""
    numbered = f"{POINTS}, nth AS (SELECT *, row_number() OVER (PARTITION BY taxi_id ORDER BY ts, event_id) - 1 AS rn FROM points)"
    tops = lambda own, other: f"{OD} SELECT period, grid, flow, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY flow DESC, grid) AS rank FROM (SELECT period, {other} AS grid, CAST(sum(count) AS BIGINT) AS flow FROM od WHERE {cells(C, own)} GROUP BY ALL)) WHERE rank <= 10"
    s, e = "start_grid", "end_grid"
    there, back = f"{cells(A, s)} AND {cells(B, e)}", f"{cells(B, s)} AND {cells(A, e)}"
    colour = {
        "r": "CASE WHEN v < 0.15 THEN 0 WHEN v < 0.35 THEN 0 WHEN v < 0.55 THEN floor(0 + 200 * ((v - 0.35::DOUBLE) / 0.20::DOUBLE)) WHEN v < 0.75 THEN 200 + 55 * ((v - 0.55::DOUBLE) / 0.20::DOUBLE) ELSE 255 END",
        "g": "CASE WHEN v < 0.15 THEN floor(50 + 50 * (v / 0.15::DOUBLE)) WHEN v < 0.35 THEN floor(100 + 155 * ((v - 0.15::DOUBLE) / 0.20::DOUBLE)) WHEN v < 0.55 THEN 255 WHEN v < 0.75 THEN 255 - 55 * ((v - 0.55::DOUBLE) / 0.20::DOUBLE) ELSE floor(200 - 150 * ((v - 0.75::DOUBLE) / 0.25::DOUBLE)) END",
        "b": "CASE WHEN v < 0.15 THEN 150 + 105 * (v / 0.15::DOUBLE) WHEN v < 0.35 THEN floor(255 - 100 * ((v - 0.15::DOUBLE) / 0.20::DOUBLE)) WHEN v < 0.55 THEN floor(255 - 200 * ((v - 0.35::DOUBLE) / 0.20::DOUBLE)) ELSE 0 END",
    }
    jitter = "((start_grid * 13 + end_grid * 7) % 15) * 0.015::DOUBLE"
    height = f"greatest(0.10::DOUBLE, {by_period({p: d(h) for p, h in od_ops.BASE_HEIGHT.items()})} + ((sector - 3.5::DOUBLE) * 0.06::DOUBLE + (quadrant - 1.5::DOUBLE) * 0.09::DOUBLE + CASE WHEN direction = '{od_ops.OUT}' THEN 0.10::DOUBLE ELSE 0.03::DOUBLE END) + {jitter})"
    edge_a, edge_b = edge_cells_sql(A, B), edge_cells_sql(B, A)
    rects = f"{BOXES}, named AS (SELECT box AS rect, x_min, y_min, x_max, y_max FROM boxes UNION ALL {' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)}, ' + ', '.join(map(d, r)) for n, r in RECTS.items())}) SELECT rect, CAST(y * 100 + x AS INTEGER) AS gid FROM (SELECT *, {_TOUCHED_X} FROM (SELECT *, {_TOUCHED} FROM named))"
    dens = density_sql([0.10])
    day = "SELECT -1 AS period, gx, gy, CAST(sum(n) AS BIGINT) AS n FROM dens GROUP BY gx, gy"
    shades = f"{dens}, v AS (SELECT DISTINCT period, n, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY period)), 9) AS v FROM dens)"
    pair_sql = lambda k: near_sql("ea", "eb", k)
    routed = lambda k, periods: spread(f"SELECT DISTINCT node AS start, period FROM near_a, (SELECT unnest({periods}) AS period)").replace(
        ", sources AS", f", ea AS {edge_a}, eb AS {edge_b}, near_a AS {nearest_sql('(SELECT gid AS place, lon, lat FROM ea)')}, near_b AS {nearest_sql('(SELECT gid AS place, lon, lat FROM eb)')}, pair AS {pair_sql(k)}, sources AS", 1
    )
    return {
        "points_scan": f"{POINTS} SELECT * FROM points WHERE {in_box(BOUNDS)}",
        "points_bbox_half_open": f"{POINTS} SELECT event_id, lon, lat FROM points WHERE {in_box(BOUNDS.expanded(0.05))}",
        "points_stride_sample": f"{stride} SELECT event_id, taxi_id FROM sampled",
        "vehicle_list": f"{POINTS} SELECT taxi_id, count(*) AS points FROM points GROUP BY taxi_id",
        "vehicle_trajectory": f"{numbered} SELECT CAST(rn AS INTEGER) AS seq, event_id, ts, lon, lat FROM nth WHERE taxi_id = 3",
        "trajectory_all_strided": f"{numbered} SELECT taxi_id, CAST(rn AS INTEGER) AS rn, event_id, lon, lat FROM nth WHERE rn % 5 = 0",
        "trajectory_capped": f"""{numbered}, sel AS (SELECT *, count(*) OVER (PARTITION BY taxi_id) AS total, row_number() OVER (PARTITION BY taxi_id ORDER BY rn) - 1 AS k FROM nth WHERE rn % 5 = 0 AND taxi_id IN (SELECT DISTINCT taxi_id FROM points ORDER BY 1 LIMIT 30))
SELECT taxi_id, CAST(rn AS INTEGER) AS rn, event_id FROM sel WHERE total <= 15 OR (k % greatest(1, total // 15) = 0 AND k // greatest(1, total // 15) < 15)""",
        "period_histogram": f"{POINTS} SELECT {PERIOD} AS period, count(*) AS n FROM points GROUP BY 1",
        "grid_id_projection": f"{POINTS} SELECT event_id, {GID} AS gid FROM points",
        "grid_bounds_of_cells": f"{POINTS}, c AS (SELECT DISTINCT {GID} AS gid FROM points) SELECT gid, {d(BOUNDS.x_min)} + (gid % 100) * {d(DX)} AS x_min, {d(BOUNDS.y_min)} + (gid // 100) * {d(DY)} AS y_min, {d(BOUNDS.x_min)} + (gid % 100 + 1) * {d(DX)} AS x_max, {d(BOUNDS.y_min)} + (gid // 100 + 1) * {d(DY)} AS y_max FROM c WHERE gid <> -1",
        "rect_to_grids": rects,
        "haversine_steps": f"{POINTS}, l AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM points WINDOW w AS (PARTITION BY taxi_id ORDER BY ts, event_id)) SELECT event_id, round({meters('lon0', 'lat0', 'lon', 'lat')}, 3) AS meters FROM l WHERE lon0 IS NOT NULL",
        "region_point_count": f"{POINTS} SELECT count(*) AS count FROM points WHERE {in_rect(C)}",
        "region_sampled_count": f"{stride} SELECT count(*) AS count FROM sampled WHERE {in_rect(C)}",
        "region_taxi_count_by_period": f"{POINTS} SELECT {PERIOD} AS period, count(*) AS points, count(DISTINCT taxi_id) AS taxis FROM points WHERE {in_rect(C)} GROUP BY 1",
        "region_search_time_range": f"{POINTS} SELECT event_id, taxi_id, ts FROM points WHERE {in_rect(C)} AND ts >= TIMESTAMP '2008-02-02 09:00:00' AND ts < TIMESTAMP '2008-02-02 15:00:00'",
        "density_by_period": f"{dens} SELECT period, gx, gy, n FROM dens",
        "density_all_day": f"{dens} SELECT gx, gy, n FROM ({day})",
        "density_stats": f"{density_sql(EXPAND_RATIOS)} SELECT ratio, coalesce(period, -1) AS period, CAST(sum(n) AS BIGINT) AS total_points FROM dens GROUP BY GROUPING SETS ((ratio, period), (ratio))",
        "density_expand_5_10_15": f"{density_sql(EXPAND_RATIOS)} SELECT * FROM dens",
        "density_r_param": f"{density_sql([0.10], 37)} SELECT period, gx, gy, n FROM dens",
        "density_intensity": f"{dens}, every AS (SELECT period, gx, gy, n FROM dens UNION ALL {day}) SELECT *, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY period)), 9) AS intensity FROM every",
        "density_colors": f"{shades} SELECT period, n, " + ", ".join(f"CAST(round({x}, 3) AS DOUBLE) AS {n}" for n, x in colour.items()) + " FROM v",
        "trip_split": f"{TRIPS} SELECT taxi_id, trip_id, event_id, n FROM trips",
        "trip_summary": f"{TRIPS} SELECT taxi_id, trip_id, count(*) AS points, min(ts) AS start_ts, max(ts) AS end_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM trips GROUP BY ALL",
        "trip_endpoints": f"{ENDS} SELECT * FROM ends",
        "od_matrix_by_period": f"{OD} SELECT * FROM od",
        "od_matrix_refreshed": f"{OD} SELECT * FROM od",
        "od_flow_between_regions": f"{OD} SELECT *, a_to_b + b_to_a AS total FROM (SELECT period, CAST(sum(CASE WHEN {there} THEN count ELSE 0 END) AS BIGINT) AS a_to_b, CAST(sum(CASE WHEN {back} THEN count ELSE 0 END) AS BIGINT) AS b_to_a FROM od WHERE ({there}) OR ({back}) GROUP BY period)",
        "od_paths_between_regions": f"{OD} SELECT *, '{od_ops.A_TO_B}' AS direction FROM od WHERE {there} UNION ALL SELECT *, '{od_ops.B_TO_A}' FROM od WHERE {back}",
        "od_region_totals": f"{OD} SELECT period, CAST(sum(CASE WHEN {cells(C, s)} THEN count ELSE 0 END) AS BIGINT) AS departures, CAST(sum(CASE WHEN {cells(C, e)} THEN count ELSE 0 END) AS BIGINT) AS arrivals FROM od WHERE {cells(C, s)} OR {cells(C, e)} GROUP BY period",
        "od_region_top_destinations": tops(s, e),
        "od_region_top_sources": tops(e, s),
        "od_region_arcs": f"{OD} SELECT * FROM {REGION_PATHS} ORDER BY {ARC_ORDER} LIMIT 300",
        "od_arc_styles": f"{OD} SELECT start_grid, end_grid, period, direction, sector, quadrant, round(least(8.0::DOUBLE, 1 + log10(count + 1) * 1.5::DOUBLE), 9) AS width, round({height}, 9) AS height, {_colors()} AS color FROM {sectors(REGION_PATHS)}",
        "od_balance_metrics": f"{OD}, w AS (SELECT sector, sum(greatest(1, count)) AS w, count(*) AS n FROM {sectors(REGION_PATHS)} GROUP BY sector) SELECT CAST(sum(n) AS BIGINT) AS paths, CAST(sum(w) AS BIGINT) AS flow, round(max(w) / CAST(sum(w) AS DOUBLE), 9) AS dominant_ratio, round(greatest(0.0::DOUBLE, (max(w) / CAST(sum(w) AS DOUBLE) - 0.125::DOUBLE) / 0.875::DOUBLE), 9) AS imbalance FROM w",
        "od_sector_quota": _quota(),
        "path_sequences": f"{SEQ} SELECT taxi_id, trip_id, array_to_string(path, '>') AS path FROM seq",
        "path_prefix_frequency": f"{FREQ} SELECT array_to_string(path, '>') AS path, vehicles, trips FROM freq",
        "frequent_paths_topk": _top("path_len >= 2", f"{BONUS} DESC, vehicles DESC, distance DESC, ranked.path", BONUS),
        "frequent_paths_grown": _top("path_len >= 2", f"{BONUS} DESC, vehicles DESC, distance DESC, ranked.path", BONUS),
        "path_vehicles_by_hours": f"""{SEQ.replace("AS path FROM runs", "AS path, min(ts) AS start_ts FROM runs")},
pre AS (SELECT taxi_id, start_ts, path[1:i] AS path FROM seq, (SELECT unnest(range(2, 200)) AS i) WHERE i <= len(path)),
hours(name, low, high) AS (VALUES {', '.join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{z}')" for n, (a, z) in HOURS.items())})
SELECT name AS hours, array_to_string(path, '>') AS path, count(DISTINCT taxi_id) AS vehicles FROM pre JOIN hours ON date_trunc('hour', start_ts) >= low AND date_trunc('hour', start_ts) < high WHERE path IN (SELECT path FROM seq) GROUP BY ALL""",
        "frequent_paths_min_distance": _top("distance >= 2000", "vehicles DESC, distance DESC, ranked.path", "vehicles::DOUBLE"),
        "frequent_paths_between": _top(f"{cells(A, 'path[1]')} AND {cells(B, 'path[len(path)]')} AND path_len BETWEEN 2 AND 15", "vehicles DESC, distance DESC, ranked.path", "vehicles::DOUBLE"),
        "path_tree_stats": f"{SEQ}, p AS (SELECT DISTINCT path[1:i] AS path FROM seq, (SELECT unnest(range(1, 200)) AS i) WHERE i <= len(path)) SELECT (SELECT count(*) FROM p) + 1 AS nodes, (SELECT CAST(max(len(path)) AS INTEGER) FROM p) AS max_depth, (SELECT count(DISTINCT path) FROM seq) AS complete",
        "road_nodes": f"{NODES} SELECT node, gx, gy, round(lon, 9) AS lon, round(lat, 9) AS lat FROM nodes",
        "road_edges_default": f"{EDGES0} SELECT src, dst, period, round(meters, 4) AS meters, round(seconds, 4) AS seconds FROM defaults",
        "travel_samples": f"{POINTS},{samples(False)} SELECT u, v, period, seconds, first_id FROM samples",
        "edge_travel_time_median": f"{POINTS},{samples(False)} SELECT u, v, period, samples, seconds FROM medians",
        "road_edges_effective": f"{EDGES} SELECT src, dst, period, round(seconds, 4) AS seconds FROM edges",
        "nearest_node": f"{NODES} SELECT place, node, round(meters, 3) AS meters FROM {nearest_sql('(SELECT event_id AS place, lon, lat FROM points)')}",
        "nearest_nodes_k": f"{NODES} SELECT place, node, round(meters, 3) AS meters, CAST(rank AS INTEGER) AS rank FROM (SELECT p.event_id AS place, n.node, {meters('p.lon', 'p.lat', 'n.lon', 'n.lat')} AS meters, row_number() OVER (PARTITION BY p.event_id ORDER BY {meters('p.lon', 'p.lat', 'n.lon', 'n.lat')}, n.node) AS rank FROM points p, nodes n) WHERE rank <= 3",
        "many_boxes": f"{BOXES} SELECT box, count(*) AS points, count(DISTINCT p.taxi_id) AS taxis FROM boxes b JOIN points p ON p.lon BETWEEN x_min AND x_max AND p.lat BETWEEN y_min AND y_max GROUP BY box",
        "adaptive_density_cells": f"{_adaptive()} SELECT level, cx, cy, n FROM cell WHERE leaf",
        "quadtree_stats": f"{_adaptive()} SELECT 4 * count(*) FILTER (NOT leaf) + 1 AS nodes, 3 * count(*) FILTER (NOT leaf) + 1 AS leaves, CAST(coalesce(sum(n) FILTER (leaf), 0) AS BIGINT) AS points, coalesce(max(level), 0) AS depth FROM cell",
        "nearest_grid_centers_k": f"{BORDERS} SELECT pair, CAST(gid AS INTEGER) AS gid, CAST(other AS INTEGER) AS other, CAST(rank AS INTEGER) AS rank FROM (SELECT o.pair, o.gid, t.gid AS other, row_number() OVER (PARTITION BY o.pair, o.gid ORDER BY sqrt(({CLON('t.gid')} - ({CLON('o.gid')})) * ({CLON('t.gid')} - ({CLON('o.gid')})) + ({CLAT('t.gid')} - ({CLAT('o.gid')})) * ({CLAT('t.gid')} - ({CLAT('o.gid')}))), t.gid) AS rank FROM border o JOIN border t ON o.pair = t.pair AND o.rect = 'a' AND t.rect = 'b') WHERE rank <= 8",
        "region_edge_grids": f"{BORDERS} SELECT pair, rect, CAST(gid AS INTEGER) AS gid FROM border",
        "shortest_time_by_period": f"{spread(f'SELECT {START}::BIGINT AS start, unnest([0, 1, 2]) AS period')} SELECT start AS start_node, node AS end_node, period, round(seconds, 4) AS seconds FROM best WHERE node = {END}",
        "shortest_times_from_node": f"{spread(f'SELECT {START}::BIGINT AS start, 2 AS period')} SELECT node, round(seconds, 4) AS seconds FROM best",
        "map_layers": _layers(),
        "routes_of_any_size": f"""{spread(f'SELECT * FROM (VALUES ({START}::BIGINT, 0), ({START}, 1), ({START}, 2), ({END}, 2)) AS v(start, period)')}{walked(f'SELECT * FROM (VALUES ({START}::BIGINT, 0, {END}::BIGINT), ({START}, 1, {END}), ({START}, 2, {END}), ({END}, 2, {START}), ({START}, 1, {START})) AS v(start, period, ends)')}
SELECT start AS start_node, ends AS end_node, CAST(period AS INTEGER) AS period, round(seconds, 4) AS seconds, route FROM (SELECT * FROM routes UNION ALL SELECT start, 9, ends, seconds, route FROM routes WHERE start = {START} AND ends = {END} AND period = 2)""",
        "compare_periods": f"{routed(5, '[0, 1, 2]')} SELECT best.period, round(min(seconds), 4) AS seconds FROM pair JOIN near_a ON near_a.place = pair.gid JOIN near_b ON near_b.place = pair.other JOIN best ON best.start = near_a.node AND best.node = near_b.node WHERE seconds > 0 GROUP BY best.period",
        "viewport_lod_points": f"{POINTS}, {_thin('VALUES ' + ', '.join(map(str, VIEWS)), 'points')} SELECT CAST(view AS INTEGER) AS view, event_id, taxi_id, vx, vy FROM thinned",
        "map_payload": _payload(),
        "vehicle_page_of_ten": f"{POINTS} SELECT taxi_id, (SELECT count(DISTINCT taxi_id) FROM points) AS total FROM (SELECT DISTINCT taxi_id FROM points) ORDER BY taxi_id LIMIT 10",
        "period_labels": f"{POINTS} SELECT CASE {PERIOD} {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in PERIODS.items())} END AS name, count(*) AS n FROM points GROUP BY 1",
        "density_columns": f"{dens} SELECT period, gx, gy, round(n * (10000.0::DOUBLE / max(n) OVER (PARTITION BY period)), 6) AS elevation FROM dens",
        "od_path_labels": f"""{OD}, either_way AS (SELECT *, '{od_ops.A_TO_B}' AS direction FROM od WHERE {there} UNION ALL SELECT *, '{od_ops.B_TO_A}' FROM od WHERE {back}),
named AS (SELECT *, {by_period({k: f"'{v}'" for k, v in PERIODS.items()})} AS period_name FROM either_way)
SELECT start_grid, end_grid, round({CLON(s)}, 9) AS source_lon, round({CLAT(s)}, 9) AS source_lat, round({CLON(e)}, 9) AS target_lon, round({CLAT(e)}, 9) AS target_lat, count, period_name, direction, printf('%s %s cells %d > %d', period_name, direction, start_grid, end_grid) AS label FROM named""",
        "path_styles": f"{FREQ}, best AS (SELECT * FROM ranked WHERE path_len >= 2 ORDER BY {BONUS} DESC, vehicles DESC, distance DESC, ranked.path LIMIT 10), placed AS (SELECT *, row_number() OVER (ORDER BY vehicles DESC, distance DESC, path) - 1 AS place FROM best) SELECT array_to_string(path, '>') AS path, CAST(place AS INTEGER) AS place, round(2 + least(8.0::DOUBLE, vehicles / 50::DOUBLE), 6) AS width, [{', '.join(repr('/'.join(map(str, c))) for c in PATH_COLORS)}][place % 6 + 1] AS color FROM placed",
        "routing_endpoints": _endpoints(),
        "edge_seconds_lookup": f"{EDGES} SELECT src, dst, 0 AS period, round(seconds, 4) AS seconds FROM edges WHERE period = 0 UNION ALL SELECT src, dst, 9, round(seconds, 4) FROM edges WHERE period = 2 UNION ALL SELECT DISTINCT src, -5, 1, CAST('Infinity' AS DOUBLE) FROM edges",
        "region_shortest_path": _region_route(),
        "simplify_collinear": _simplify(),
        "trajectory_like_line": _trajectory_like(),
        **_display(),
        "view_state": f"{POINTS} SELECT round((min(lon) + max(lon)) / 2, 9) AS longitude, round((min(lat) + max(lat)) / 2, 9) AS latitude, CASE WHEN greatest(max(lon) - min(lon), max(lat) - min(lat), 0.01) > 0.15 THEN 11.0::DOUBLE WHEN greatest(max(lon) - min(lon), max(lat) - min(lat), 0.01) > 0.06 THEN 12.0::DOUBLE ELSE 13.0::DOUBLE END AS zoom FROM points WHERE {in_rect(C)}",
        "smooth_polyline": f"{PLACES}, {_smooth('places', 0.22)} SELECT taxi_id, trip_id, CAST(place AS INTEGER) AS place, round(lon, 9) AS lon, round(lat, 9) AS lat FROM smooth2",
        "system_stats": f"""{NODES}, edge AS (SELECT count(*) AS n FROM nodes a JOIN nodes b ON abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND a.node <> b.node),{samples(True)},
{SEQ.split("points AS", 1)[1].split("FROM k),", 1)[1]}
SELECT count(DISTINCT taxi_id) AS vehicle_count, count(*) AS total_points, CAST(sum(CAST({in_box(BOUNDS)} AS BIGINT)) AS BIGINT) AS points_in_bounds, (SELECT count(*) FROM nodes) AS graph_nodes, (SELECT n FROM edge) AS graph_edges, (SELECT count(*) FROM samples) AS graph_samples, (SELECT count(*) FROM seq) AS path_trips FROM points""",
        "stream_trip_ends": f"{TRIPS} SELECT taxi_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points, arg_min(gid, (ts, event_id)) AS start_grid, arg_max(gid, (ts, event_id)) AS end_grid, arg_min(period, (ts, event_id)) AS period FROM trips GROUP BY taxi_id, trip_id",
        "stream_travel_samples": f"{POINTS},{samples(False)} SELECT u, v, period, seconds, first_id FROM samples",
        "stream_density": f"{dens} SELECT period, gx, gy, n FROM dens",
        "stream_trip_sessions": f"{TRIPS} SELECT taxi_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points FROM trips GROUP BY taxi_id, trip_id",
    }
