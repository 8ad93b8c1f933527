"""An origin-destination matrix that is kept up to date: only parts of time whose points changed are worked out again.

A folder holds three tables: trips and the matrix, both by the part (an hour or a day) in which trips start, and a
fingerprint of the points of each part.  A trip may span parts and changed points may join or cut trips that
begin in others, so what is worked out again are the trips that reach into a changed part, or come as near as a trip's
gap, with all points of the parts that they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamgrid.config import TRIP_GAP_US
from roamgrid.functions.grid import grid_id, period_of
from roamgrid.operators.trips import split
from roamgrid.plans.storage import delete_path, settings, written

TRIP = "taxi_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, n long, start_grid int, end_grid int, period int, part string"
CELL = "start_grid int, end_grid int, period int, count long, part string"
PRINT = "part string, rows long, sum decimal(38,0), mix long"
#: Fixed forms of a part's name.
FORMS = {"HOUR": "yyyy-MM-dd-HH", "DAY": "yyyy-MM-dd"}


def _part(ts: Column, unit: str) -> Column:
    return F.coalesce(F.date_format(F.date_trunc(unit, ts), FORMS[unit]), F.lit("none"))


def _parts(start: Column, end: Column, unit: str) -> Column:
    """Names of all parts from one time to another; that of points without a time for null."""
    step = F.expr(f"interval 1 {unit.lower()}")
    named = F.transform(F.sequence(F.date_trunc(unit, start), F.date_trunc(unit, end), step), lambda t: F.date_format(t, FORMS[unit]))
    return F.coalesce(named, F.array(F.lit("none")))


def fingerprints(points: DataFrame, unit: str = "DAY") -> DataFrame:
    """``part``, and number, sum and mixture of its rows' hashes."""
    h = F.xxhash64("event_id", "taxi_id", "ts", "lon", "lat")
    return points.groupBy(_part(F.col("ts"), unit).alias("part")).agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum"), F.bit_xor(h).alias("mix"))


def _trips(points: DataFrame, unit: str) -> DataFrame:
    """All runs of points, single ones too: what a later point may make a trip of."""
    at = F.struct("ts", "event_id")
    rows = split(points, 1).withColumn("gid", grid_id(F.col("lon"), F.col("lat")))
    ends = rows.groupBy("taxi_id", "trip_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n"), F.min_by("gid", at).alias("start_grid"), F.max_by("gid", at).alias("end_grid"))
    return ends.withColumn("period", period_of(F.col("start_ts"))).withColumn("part", _part(F.col("start_ts"), unit)).drop("trip_id")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def refresh(points: DataFrame, folder: str, unit: str = "DAY") -> list[str]:
    """Brings the tables of a folder up to date with ``points``; gives the names of the parts that were written.

    The first call makes all parts.  Files of other parts stay as they are.  Only names of parts come to the
    driver.  Fingerprints are written last, so a call that broke off is made good by the next one.  Points
    without a time are a part of their own.
    """
    spark = points.sparkSession
    path = {name: f"{folder.rstrip('/')}/{name}" for name in ("trips", "matrix", "fingerprints")}
    new = written(fingerprints(points, unit), "fingerprints")
    old = _table(spark, path["fingerprints"], PRINT)
    same = new.join(old, ["part", "rows", "sum", "mix"], "left_semi").select("part")
    changed = [r.part for r in new.select("part").union(old.select("part")).distinct().join(same, "part", "left_anti").collect()]
    if not changed:
        return []
    gap = F.expr(f"interval {TRIP_GAP_US} microseconds")
    reach = F.arrays_overlap(_parts(F.col("start_ts") - gap, F.col("end_ts") + gap, unit), F.array(*map(F.lit, changed)))
    stored = written(_table(spark, path["trips"], TRIP).withColumn("touched", reach), "stored_trips")
    touched = stored.where("touched")
    lying = touched.select(F.explode(_parts(F.col("start_ts"), F.col("end_ts"), unit)).alias("part")).distinct()
    wanted = sorted({*changed, *(r.part for r in lying.collect())})
    again = written(_trips(points.where(_part(F.col("ts"), unit).isin(wanted)), unit).withColumn("touched", reach), "again")
    # runs that are what is left of a touched trip, though they reach no changed part any more
    own = touched.select(F.col("taxi_id").alias("t"), F.col("start_ts").alias("a"), F.col("end_ts").alias("z"))
    left = again.where("not touched").join(own, (F.col("taxi_id").eqNullSafe(F.col("t"))) & (F.col("start_ts") <= F.col("z")) & (F.col("end_ts") >= F.col("a")), "left_semi")
    made = written(again.where("touched").unionByName(left).drop("touched"), "made")
    parts = sorted({r.part for r in touched.select("part").unionByName(made.select("part")).distinct().collect()})
    rows = written(stored.where("not touched").drop("touched").where(F.col("part").isin(parts)).unionByName(made), "trips")
    cells = rows.where("n >= 2 and start_grid <> -1 and end_grid <> -1 and start_grid <> end_grid").groupBy("part", "start_grid", "end_grid", "period").agg(F.count("*").alias("count"))
    with settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        for name, table in (("trips", rows), ("matrix", cells)):
            there = {r.part for r in table.select("part").distinct().collect()}
            table.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path[name])
            for part in set(parts) - there:
                delete_path(spark, f"{path[name]}/part={part}")
    new.write.mode("overwrite").parquet(path["fingerprints"])
    return parts


def matrix(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``start_grid``, ``end_grid``, ``period``, ``count`` of the trips that start in the parts from ``start`` until before ``end``."""
    cells = _table(spark, f"{folder.rstrip('/')}/matrix", CELL)
    cells = cells if start is None else cells.where(F.col("part") >= start)
    cells = cells if end is None else cells.where(F.col("part") < end)
    return cells.groupBy("start_grid", "end_grid", "period").agg(F.sum("count").alias("count"))
