"""The road graph: occupied cells, edges between neighbours, travel times learned from points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, DEFAULT_SPEEDS, GRID_SIZE, NODE_STRIDE, SAMPLE_CAP_SECONDS, SAMPLE_SECONDS, SAMPLES_NEEDED
from roamgrid.functions.grid import cell_x, cell_y, haversine, in_rect, period_of, steps
from roamgrid.operators.trips import in_time
from roamgrid.plans.storage import written

#: Fixed value: the eight neighbours of a cell.
NEIGHBOURS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)]


def _node(size: int):
    return (cell_y(F.col("lat"), size) * size + cell_x(F.col("lon"), size)).cast("long")


def nodes(points: DataFrame, size: int = GRID_SIZE, stride: int = NODE_STRIDE) -> DataFrame:
    """``node``, ``gx``, ``gy``, ``lon``, ``lat`` of the cells of every ``stride``-th point of each vehicle.

    A node's number is ``gy * size + gx``; points on the bounds' edge belong to them.
    """
    dx, dy = steps(size)
    some = points.withColumn("rn", F.row_number().over(in_time()) - 1).where(F.col("rn") % stride == 0)
    cells = some.where(in_rect(F.col("lon"), F.col("lat"), BOUNDS)).select(cell_x(F.col("lon"), size).alias("gx"), cell_y(F.col("lat"), size).alias("gy")).distinct()
    lon, lat = F.lit(BOUNDS.x_min) + (F.col("gx") + 0.5) * dx, F.lit(BOUNDS.y_min) + (F.col("gy") + 0.5) * dy
    return cells.select((F.col("gy") * size + F.col("gx")).cast("long").alias("node"), "gx", "gy", lon.alias("lon"), lat.alias("lat"))


def default_edges(node_table: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``period``, ``meters``, ``seconds`` between neighbouring nodes at default speeds."""
    offsets = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in NEIGHBOURS]))
    ends = node_table.select(F.col("node").alias("dst"), "gx", "gy", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    pairs = (
        node_table.withColumn("o", offsets)
        .select(F.col("node").alias("src"), (F.col("gx") + F.col("o.x")).alias("gx"), (F.col("gy") + F.col("o.y")).alias("gy"), "lon", "lat")
        .join(ends, ["gx", "gy"])
        .withColumn("meters", haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))
    )
    speeds = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.lit(s).alias("speed")) for p, s in DEFAULT_SPEEDS.items()]))
    return pairs.withColumn("s", speeds).select("src", "dst", "s.period", "meters", (F.col("meters") / F.col("s.speed")).alias("seconds"))


def travel_samples(points: DataFrame, node_table: DataFrame | None = None, size: int = GRID_SIZE) -> DataFrame:
    """``u``, ``v``, ``period``, ``seconds`` of each move of a vehicle from one cell to another.

    Points outside the bounds, or in no known node, are skipped first.  Moves last 1 to 300 seconds
    and have the period of their start.  ``first_id`` is the event that begins the move.
    """
    here = points.where(in_rect(F.col("lon"), F.col("lat"), BOUNDS)).withColumn("u", _node(size))
    if node_table is not None:
        here = here.join(node_table.select(F.col("node").alias("u")), "u", "left_semi")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    moves = here.withColumn("v", F.lead("u").over(in_time())).withColumn("seconds", (F.lead(micros).over(in_time()) - micros) / 1_000_000)
    kept = moves.where((F.col("u") != F.col("v")) & F.col("seconds").between(*SAMPLE_SECONDS))
    return kept.select("u", "v", period_of(F.col("ts")).alias("period"), "seconds", "taxi_id", F.col("event_id").alias("first_id"))


def edge_medians(samples: DataFrame) -> DataFrame:
    """``u``, ``v``, ``period``, ``samples``, ``seconds``: the median of three samples or more, capped."""
    first = F.min(F.struct("taxi_id", "first_id"))
    sums = samples.groupBy("u", "v", "period").agg(F.count("*").alias("samples"), F.median("seconds").alias("seconds"), first.alias("first"))
    return sums.where(F.col("samples") >= SAMPLES_NEEDED).withColumn("seconds", F.least("seconds", F.lit(SAMPLE_CAP_SECONDS)))


def symmetric_medians(medians: DataFrame) -> DataFrame:
    """``a``, ``b``, ``period``, ``seconds`` for both directions: of two medians that of the later seen one."""
    pairs = medians.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "period")
    return pairs.agg(F.max_by("seconds", F.struct("first", "u")).alias("seconds"))


def effective_edges(points: DataFrame, size: int = GRID_SIZE, semantics: str = "reference", node_table: DataFrame | None = None) -> DataFrame:
    """``src``, ``dst``, ``period``, ``seconds``: default times and what was learned.

    With ``semantics="reference"`` a learned time counts where it is the smaller one, with
    ``"corrected"`` wherever there is one.
    """
    node_table = nodes(points, size) if node_table is None else node_table
    learned = symmetric_medians(edge_medians(travel_samples(points, node_table, size)))
    edges = default_edges(node_table).withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    joined = edges.join(learned.withColumnRenamed("seconds", "learned"), ["a", "b", "period"], "left")
    seconds = F.least("seconds", "learned") if semantics == "reference" else F.coalesce("learned", "seconds")
    return joined.select("src", "dst", "period", seconds.alias("seconds"))


def graph_stats(points: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """One row: ``nodes``, directed ``edges`` and travel ``samples`` between known nodes."""
    node_table = written(nodes(points, size), "nodes")
    n = node_table.agg(F.count("*").alias("nodes"))
    e = default_edges(node_table).where("period = 2").agg(F.count("*").alias("edges"))
    s = travel_samples(points, node_table, size).agg(F.count("*").alias("samples"))
    return n.crossJoin(e).crossJoin(s)
