"""Points: position records of vehicles, from files of one vehicle each or from a table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roamgrid.config import BOUNDS, Rect
from roamgrid.functions.grid import in_box

FILE_SCHEMA = "taxi_id long, timestamp timestamp_ntz, longitude double, latitude double, _bad string"


def from_files(spark: SparkSession, glob: str) -> DataFrame:
    """Points of headerless files ``<vehicle>.txt``; unreadable fields are null and ``_bad`` has the line.

    ``file_vehicle_id`` is null for other names.  ``event_id`` keeps the order inside a file.
    """
    rows = spark.read.schema(FILE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(glob)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.txt$", 1)
    return rows.select(
        F.monotonically_increasing_id().alias("event_id"),
        F.when(name != "", name.cast("long")).alias("file_vehicle_id"),
        F.col("_metadata.file_size").alias("file_size"),
        "taxi_id",
        F.col("timestamp").alias("ts"),
        F.col("longitude").alias("lon"),
        F.col("latitude").alias("lat"),
        "_bad",
    )


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points derived from a table of events: three users share a vehicle, time runs sixtyfold."""
    return points_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def points_of_events(events: DataFrame) -> DataFrame:
    micros = F.expr("unix_micros(cast(ts as timestamp)) - unix_micros(timestamp'2024-01-01 00:00:00')")
    taxi = F.expr("user_id div 3")
    base = events.select("event_id", taxi.alias("taxi_id"), F.floor(micros / 60_000_000).cast("long").alias("s"))
    base = base.withColumn("st", F.expr("s div 240 + 7 * (taxi_id % 3)"))
    lon = F.expr(
        "case when event_id % 101 = 0 then 0D when event_id % 37 = 0 then 117.05D else cast(116200 + 10 * abs(((st + 11 * (taxi_id % 5)) % 60) - 30) + 60 * (taxi_id % 5) + 1 + event_id % 7 as double) / 1000D end"
    )
    lat = F.expr("case when event_id % 101 = 0 then 0D else cast(39600 + 7 * abs((st % 40) - 20) + 35 * (taxi_id % 5) + 1 + event_id % 5 as double) / 1000D end")
    ts = F.expr("timestamp_ntz'2008-02-02 06:30:00' + make_dt_interval(0, 0, 0, s)")
    return base.select("event_id", "taxi_id", ts.alias("ts"), lon.alias("lon"), lat.alias("lat"))


def scan(points: DataFrame, bounds: Rect = BOUNDS, stride: int = 1) -> DataFrame:
    """Points inside the half-open bounds, thinned by ``stride_sample`` if the stride is above 1."""
    inside = points.where(in_box(F.col("lon"), F.col("lat"), bounds))
    return stride_sample(inside, stride) if stride > 1 else inside


def stride_sample(points: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th row of each vehicle's rows in file order, vehicles one after the other.

    A vehicle begins at the number of rows before it modulo the stride.  The counts before it come
    from one row for each vehicle, so no task sees all points.
    """
    order = Window.partitionBy("taxi_id").orderBy("event_id")
    counts = points.groupBy("taxi_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("taxi_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("taxi_id", (F.coalesce(F.sum("n").over(before), F.lit(0)) % stride).alias("off"))
    numbered = points.withColumn("rn", F.row_number().over(order) - 1).join(offsets, "taxi_id")
    return numbered.where((F.col("rn") >= F.col("off")) & ((F.col("rn") - F.col("off")) % stride == 0)).drop("rn", "off")


def vehicles(points: DataFrame) -> DataFrame:
    """``taxi_id`` and ``points`` of each vehicle."""
    return points.groupBy("taxi_id").agg(F.count("*").alias("points"))


def vehicle_page(points: DataFrame, limit: int = 50) -> DataFrame:
    """``taxi_id`` of the ``limit`` vehicles with the lowest ids, and ``total``, how many there are."""
    ids = points.select("taxi_id").distinct()
    return ids.orderBy("taxi_id").limit(limit).withColumn("total", F.lit(ids.count()))


def sampled_vehicles(points: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Points of about the share ``rate`` of vehicles, the same for one seed whatever the tables' layout."""
    share = F.pmod(F.xxhash64("taxi_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return points.where(share < rate)


def first_vehicles(points: DataFrame, rate: float) -> DataFrame:
    """Points of the share ``rate`` of vehicles with the lowest ids."""
    ids = points.select("taxi_id").distinct()
    keep = int(ids.count() * rate)
    return points.join(ids.orderBy("taxi_id").limit(keep), "taxi_id", "left_semi")


def size_estimate(points: DataFrame) -> DataFrame:
    """``rows``: points that the files' sizes suggest, at fifty bytes a line and one line a file."""
    files = points.groupBy("file_vehicle_id").agg(F.max("file_size").alias("size"))
    return files.agg(F.sum(F.greatest(F.lit(1), F.expr("size div 50"))).alias("rows"))
