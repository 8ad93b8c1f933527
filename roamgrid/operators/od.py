"""Origin-destination flow between cells and regions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.config import ARC_CAP, BOUNDS, Rect
from roamgrid.functions.grid import center_lat, center_lon, direction_part, in_cells, period_name
from roamgrid.operators import trips

OUT, IN, A_TO_B, B_TO_A = "departure", "arrival", "A→B", "B→A"
EDGE_MARGIN, BALANCE_PATHS, BALANCE_IMBALANCE = 0.08, 40, 0.72
# Heights and colours of arcs by period, in the main and in the other direction.
BASE_HEIGHT = {0: 0.22, 1: 0.32, 2: 0.42}
COLORS = {
    "between": ({0: (80, 255, 140, 200), 1: (255, 210, 90, 200), 2: (120, 190, 255, 200)}, {0: (50, 210, 100, 170), 1: (255, 150, 50, 170), 2: (90, 160, 230, 170)}),
    "region": ({0: (80, 255, 140, 190), 1: (255, 210, 90, 190), 2: (120, 190, 255, 190)}, {0: (100, 180, 255, 170), 1: (255, 150, 120, 170), 2: (180, 140, 255, 170)}),
}


def matrix(points: DataFrame) -> DataFrame:
    """``start_grid``, ``end_grid``, ``period``, ``count`` of trips between two different cells."""
    ends = trips.endpoints(points).where("start_grid <> -1 and end_grid <> -1 and start_grid <> end_grid")
    return ends.groupBy("start_grid", "end_grid", "period").agg(F.count("*").alias("count"))


def _of_period(od: DataFrame, period: int | None) -> DataFrame:
    return od if period is None else od.where(F.col("period") == period)


def flow_between(od: DataFrame, a: Rect, b: Rect, period: int | None = None) -> DataFrame:
    """``period``, ``a_to_b``, ``b_to_a``, ``total`` in one pass; periods without flow have no row."""
    s, e, n = F.col("start_grid"), F.col("end_grid"), F.col("count")
    there, back = in_cells(s, a) & in_cells(e, b), in_cells(s, b) & in_cells(e, a)
    sums = _of_period(od, period).where(there | back).groupBy("period").agg(F.sum(F.when(there, n).otherwise(0)).alias("a_to_b"), F.sum(F.when(back, n).otherwise(0)).alias("b_to_a"))
    return sums.withColumn("total", F.col("a_to_b") + F.col("b_to_a"))


def paths_between(od: DataFrame, a: Rect, b: Rect, period: int | None = None) -> DataFrame:
    """The matrix's rows from A to B and from B to A with ``direction``; a row may be both."""
    od, s, e = _of_period(od, period), F.col("start_grid"), F.col("end_grid")
    there = od.where(in_cells(s, a) & in_cells(e, b)).withColumn("direction", F.lit(A_TO_B))
    return there.unionByName(od.where(in_cells(s, b) & in_cells(e, a)).withColumn("direction", F.lit(B_TO_A)))


def paths_of_region(od: DataFrame, r: Rect, period: int | None = None) -> DataFrame:
    """Rows that leave the region and rows that enter it, with ``direction``; inner ones are neither."""
    s, e = in_cells(F.col("start_grid"), r), in_cells(F.col("end_grid"), r)
    return _of_period(od, period).where(s != e).withColumn("direction", F.when(s, OUT).otherwise(IN))


def region_totals(od: DataFrame, r: Rect) -> DataFrame:
    """``period``, ``departures``, ``arrivals``; trips inside the region count in both."""
    s, e, n = in_cells(F.col("start_grid"), r), in_cells(F.col("end_grid"), r), F.col("count")
    return od.where(s | e).groupBy("period").agg(F.sum(F.when(s, n).otherwise(0)).alias("departures"), F.sum(F.when(e, n).otherwise(0)).alias("arrivals"))


def top_counterparts(od: DataFrame, r: Rect, side: str = OUT, k: int = 10) -> DataFrame:
    """``period``, ``grid``, ``flow``, ``rank``: the k cells to (or from) which most trips of the region go."""
    own, other = ("start_grid", "end_grid") if side == OUT else ("end_grid", "start_grid")
    flows = od.where(in_cells(F.col(own), r)).groupBy("period", F.col(other).alias("grid")).agg(F.sum("count").alias("flow"))
    rank = F.row_number().over(Window.partitionBy("period").orderBy(F.desc("flow"), "grid"))
    return flows.withColumn("rank", rank).where(F.col("rank") <= k)


def with_centers(paths: DataFrame) -> DataFrame:
    """Adds the cells' centres and the sector and quadrant of the direction between them."""
    out = paths
    for name, gid in (("source", "start_grid"), ("target", "end_grid")):
        out = out.withColumn(f"{name}_lon", center_lon(F.col(gid))).withColumn(f"{name}_lat", center_lat(F.col(gid)))
    dx, dy = F.col("target_lon") - F.col("source_lon"), F.col("target_lat") - F.col("source_lat")
    return out.withColumn("sector", direction_part(dx, dy, 8)).withColumn("quadrant", direction_part(dx, dy, 4))


def with_labels(paths: DataFrame) -> DataFrame:
    """Adds ``period_name`` and a ``label`` for the reader."""
    named = paths.withColumn("period_name", period_name(F.col("period")))
    return named.withColumn("label", F.format_string("%s %s cells %d > %d", "period_name", "direction", "start_grid", "end_grid"))


def is_edge_region(r: Rect) -> bool:
    """Whether a rectangle comes near an edge of the bounds."""
    mx, my = (BOUNDS.x_max - BOUNDS.x_min) * EDGE_MARGIN, (BOUNDS.y_max - BOUNDS.y_min) * EDGE_MARGIN
    return r.x_min <= BOUNDS.x_min + mx or r.x_max >= BOUNDS.x_max - mx or r.y_min <= BOUNDS.y_min + my or r.y_max >= BOUNDS.y_max - my


def balance(paths: DataFrame) -> DataFrame:
    """One row: ``paths``, ``flow``, ``dominant_ratio`` and ``imbalance`` over the eight sectors."""
    weight = F.greatest(F.lit(1), F.col("count"))
    sectors = with_centers(paths).groupBy("sector").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    one = sectors.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("paths"), F.coalesce(F.sum("w"), F.lit(0)).alias("flow"), F.max("w").alias("most"))
    ratio = F.coalesce(F.col("most") / F.col("flow"), F.lit(0.0))
    return one.select("paths", "flow", ratio.alias("dominant_ratio"), F.greatest(F.lit(0.0), (ratio - 1 / 8) / (1 - 1 / 8)).alias("imbalance"))


def _order() -> list:
    return [F.desc("count"), "start_grid", "end_grid", "period", "direction"]


def top_arcs(paths: DataFrame, cap: int = ARC_CAP) -> DataFrame:
    """The ``cap`` rows of most trips."""
    return paths.orderBy(*_order()).limit(cap)


def quota_arcs(paths: DataFrame, cap: int = ARC_CAP) -> DataFrame:
    """``cap`` rows dealt over the eight sectors by their flow.

    Each sector with rows keeps its first; the rest is allotted in proportion to flow, the largest
    remainders first (the lower sector on a tie), and what sectors can't fill goes to the rows of most
    trips.  With ``cap`` rows or fewer all stay.
    """
    rank = F.row_number().over(Window.partitionBy("sector").orderBy(*_order()))
    rows = with_centers(paths).withColumn("rank", rank)
    flows = rows.groupBy("sector").agg(F.sum(F.greatest(F.lit(1), F.col("count"))).alias("flow"))  # eight rows
    everything = Window.partitionBy(F.lit(0))
    room = F.greatest(F.lit(0), F.lit(cap) - F.count("*").over(everything))
    raw = room * (F.col("flow") / F.sum("flow").over(everything))
    shares = flows.withColumn("room", room).withColumn("raw", raw).withColumn("base", F.floor("raw"))
    left = F.col("room") - F.sum("base").over(everything)
    by_rest = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("raw") - F.col("base")), "sector"))
    shares = shares.withColumn("left", left).withColumn("nth", by_rest)
    shares = shares.select("sector", (F.lit(1) + F.col("base") + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    late = (F.col("rank") > F.col("quota")).cast("int")
    return rows.join(F.broadcast(shares), "sector").orderBy(late, *_order()).limit(cap).drop("quota", "rank")


def arc_style(arcs: DataFrame, mode: str = "between", balanced: bool = False) -> DataFrame:
    """Adds ``width``, ``height`` and ``color`` (red, green, blue, alpha) to rows with centres."""
    main = F.col("direction").isin(A_TO_B, OUT)
    jitter = ((F.col("start_grid") * 13 + F.col("end_grid") * 7) % 15) * 0.015
    height = _by_period(BASE_HEIGHT) + jitter
    if balanced and mode == "region":
        lift = (F.col("sector") - 3.5) * 0.06 + (F.col("quadrant") - 1.5) * 0.09 + F.when(main, 0.10).otherwise(0.03)
        height = F.greatest(F.lit(0.10), _by_period(BASE_HEIGHT) + lift + jitter)
    first, second = ({p: F.array(*map(F.lit, c)) for p, c in part.items()} for part in COLORS[mode])
    width = F.least(F.lit(8.0), 1 + F.log10(F.col("count") + 1) * 1.5)
    return arcs.withColumn("width", width).withColumn("height", height).withColumn("color", F.when(main, _by_period(first)).otherwise(_by_period(second)))


def _by_period(values: dict) -> Column:
    out = None
    for p, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col("period") == p, v) if out is None else out.when(F.col("period") == p, v)
    return out


def uses_balance(paths: int, edge: bool, imbalance: float) -> bool:
    """Whether a region's arcs are dealt by sectors."""
    return paths >= BALANCE_PATHS and (edge or imbalance >= BALANCE_IMBALANCE)
