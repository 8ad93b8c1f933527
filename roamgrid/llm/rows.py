"""Rows of a table by where they stand, so that rows alike in every column can be told apart."""

from __future__ import annotations

import pickle
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.plans.storage import new_path

#: Keys up to this number are broadcast when rows are looked up, more are shuffled.
BROADCAST_KEYS = 1_000_000
#: Rows of a group from which it is looked up by a broadcast, at least, and groups that are, at most:
#: groups of more than ``rows / HOT_GROUPS`` rows are that few.
HOT_ROWS, HOT_GROUPS = 100, 100_000
#: Bits of a row number that hold the place in its file.
PLACE_BITS = 40


def is_scan(docs: DataFrame) -> bool:
    """Whether the rows come straight from one scan of Parquet files, so that a file's row is met once."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName().startswith("LogicalRelation") and "parquet" in node.toString().lower() and "_metadata" not in docs.columns


def located(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``row`` (a struct of all columns), ``at_file`` and ``at_row``; what isn't a scan is written first.

    The copy goes to ``folder``, where it lasts as long as the locators that name it.
    """
    rows = docs.select(F.struct("*").alias("row")) if not is_scan(docs) else None
    if rows is not None:
        path = f"{folder}/located-{uuid.uuid4().hex}" if folder else new_path(docs.sparkSession, "located")
        rows.write.parquet(path)
        docs = docs.sparkSession.read.schema(rows.schema).parquet(path)
    row = F.struct("*") if rows is None else F.col("row")
    return docs.select(row.alias("row"), F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))


def numbered(docs: DataFrame) -> DataFrame:
    """``row`` and ``number``, one long for each row: its file's number and its place in the file.

    The files' names are the only thing that comes to the driver, which lists them for the scan anyway.
    """
    rows = located(docs)
    files = sorted(r[0] for r in rows.select("at_file").distinct().collect())
    named = docs.sparkSession.createDataFrame(list(enumerate(files)), "file_number long, at_file string")
    number = F.shiftleft("file_number", PLACE_BITS) + F.col("at_row")
    return rows.join(F.broadcast(named), "at_file").select("row", number.alias("number"))


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose key is in ``keys``; these are broadcast only if they are few."""
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, how)


def fitted(sample: DataFrame, fit):
    """What ``fit`` makes of the rows of a bounded sample, given as dictionaries; it works in a task, and only what it
    returns comes to the driver."""

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    made = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str) -> DataFrame:
    """Rows with their group's columns, for groups that know how many rows they have (``size``).

    A large group's rows don't meet in one task: the large groups, of which a count bounds the number,
    are broadcast.  Both tables should be written ones.
    """
    hot = max(HOT_ROWS, rows.count() // HOT_GROUPS)
    large, rest = groups.where(F.col(size) > hot), groups.where(F.col(size) <= hot)
    others = rows.join(F.broadcast(large.select(on)), on, "left_anti")
    return rows.join(F.broadcast(large), on).unionByName(others.join(rest, on))
