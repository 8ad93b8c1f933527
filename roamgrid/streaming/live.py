"""Density and trips of points that arrive as a stream of files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from roamgrid.config import BOUNDS, DEFAULT_EXPAND_RATIO, DENSITY_SIZE, GRID_SIZE, SAMPLE_SECONDS, TRIP_GAP_US
from roamgrid.functions.grid import cell_x, cell_y, grid_id, in_box, in_rect, period_of
from roamgrid.plans.storage import settings

LATENESS = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the state holds of a point, all longs, and what stands there for null.
HELD, UNKNOWN = ["event_id", "at", "gid", "node", "period"], -(2**63)
POINTS = "event_id long, taxi_id long, ts timestamp_ntz, lon double, lat double"


def points(spark: SparkSession, folder: str, files_per_batch: int = 100, lateness: str = LATENESS) -> DataFrame:
    """A stream of the Parquet files of a folder; ``time`` is the event time with a watermark."""
    rows = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", lateness)


def density(stream: DataFrame, width: str = "1 hour", ratio: float = DEFAULT_EXPAND_RATIO, size: int = DENSITY_SIZE) -> DataFrame:
    """Points for each window of time and cell of the expanded bounds."""
    box = BOUNDS.expanded(ratio)
    inside = stream.where(in_box(F.col("lon"), F.col("lat"), box))
    keys = [F.window("time", width).alias("w"), period_of(F.col("ts")).alias("period"), cell_x(F.col("lon"), size, box).alias("gx"), cell_y(F.col("lat"), size, box).alias("gy")]
    return inside.groupBy(*keys).agg(F.count("*").alias("n")).select("w.start", "period", "gx", "gy", "n")


def trip_sessions(stream: DataFrame) -> DataFrame:
    """Trips as session windows: a gap of over 300 seconds ends one; trips of one point are dropped."""
    # a point exactly 300 seconds after the last still joins the session, as it joins a trip
    sessions = stream.groupBy("taxi_id", F.session_window("time", "300 seconds").alias("w"))
    found = sessions.agg(F.count("*").alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return found.where(F.col("points") >= 2).select("taxi_id", "start_ts", "end_ts", "points")


def drain(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over what is there, appending final rows to Parquet files in ``out``."""
    with settings(df.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKSDB):
        query = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


class TripState(StatefulProcessor):
    """A vehicle's points that may still belong to an open trip.

    Points wait in the state, in whatever order they come, those that came together as one value.  One timer is
    set for the time from which no point can join the earliest trip any more; when the watermark has passed it,
    the trips that are over are told, with the moves between nodes in them, their points leave the state, and a
    timer is set for the earliest trip that is left.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "block binary")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            held = np.stack([part[c].to_numpy(np.int64) for c in HELD], 1)
            self.points.appendValue((held.tobytes(),))
            self._wait(np.sort(held[:, 1]))
        return iter(())

    def _wait(self, at):
        ends = np.flatnonzero(np.diff(at) > TRIP_GAP_US)
        self.handle.registerTimer(int(at[ends[0] if len(ends) else -1]) // 1_000 + TRIP_GAP_US // 1_000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1_000
        held = np.frombuffer(b"".join(block for (block,) in self.points.get()), np.int64).reshape(-1, len(HELD))
        held = held[np.lexsort((held[:, 0], held[:, 1]))]
        # trips that are over come before those that are not
        ends = np.append(np.flatnonzero(np.diff(held[:, 1]) > TRIP_GAP_US) + 1, len(held)) if len(held) else np.zeros(0, np.int64)
        ends = ends[held[ends - 1, 1] + TRIP_GAP_US < now].tolist()
        left = held[ends[-1] :] if ends else held
        if ends:
            self.points.put([(left.tobytes(),)]) if len(left) else self.points.clear()
        if len(left):
            self._wait(left[:, 1])
        rows = [tuple(None if x == UNKNOWN else x for x in r) for r in held.tolist()] if ends else []
        told = [self._row(key[0], rows[i:j]) for i, j in zip([0, *ends], ends) if j - i > 1]
        if told:
            yield pd.DataFrame(told, columns=["taxi_id", "start_us", "end_us", "points", "start_grid", "end_grid", "period", "moves"])

    @staticmethod
    def _row(taxi, trip):
        known = [p for p in trip if p[3] is not None]
        moves = [{"u": a[3], "v": b[3], "period": a[4], "seconds": (b[1] - a[1]) / 1e6, "first_id": a[0]} for a, b in zip(known, known[1:]) if a[3] != b[3] and SAMPLE_SECONDS[0] <= (b[1] - a[1]) / 1e6 <= SAMPLE_SECONDS[1]]
        return taxi, trip[0][1], trip[-1][1], len(trip), trip[0][2], trip[-1][2], trip[0][4], moves

    def close(self) -> None:
        pass


TRIP = "taxi_id long, start_us long, end_us long, points long, start_grid int, end_grid int, period int, moves array<struct<u:long,v:long,period:int,seconds:double,first_id:long>>"


def trips(stream: DataFrame, size: int = GRID_SIZE) -> DataFrame:
    """``taxi_id``, ``start_ts``, ``end_ts``, ``points``, ``start_grid``, ``end_grid``, ``period``, ``moves`` of trips that are over.

    The trips of ``trips.split`` with their ends and the samples of ``road.travel_samples``, from points in any order;
    points later than the watermark are left out, trips of one point too.  The state holds a vehicle's open trips only.
    Needs RocksDB as the state's store.
    """
    node = F.when(in_rect(F.col("lon"), F.col("lat"), BOUNDS), (cell_y(F.col("lat"), size) * size + cell_x(F.col("lon"), size)).cast("long"))
    known = lambda c: F.coalesce(c.cast("long"), F.lit(UNKNOWN))
    rows = stream.select("taxi_id", "event_id", "time", F.unix_micros("time").alias("at"), grid_id(F.col("lon"), F.col("lat"), size).alias("gid"), node.alias("node"), period_of(F.col("ts")).alias("period"))
    rows = rows.where("at is not null and taxi_id is not null").withColumns({c: known(F.col(c)) for c in HELD})
    found = rows.groupBy("taxi_id").transformWithStateInPandas(TripState(), TRIP, "Append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("taxi_id", time("start_us").alias("start_ts"), time("end_us").alias("end_ts"), "points", "start_grid", "end_grid", "period", "moves")
