"""Intermediate tables that survive the loss of executors.

Everything that cuts lineage goes to the folder that the cluster shares between driver and
executors (``spark.checkpoint.dir``); a folder of our own is used only where none is set.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; in local mode without one, a temporary folder per application.

    On a cluster a folder of the driver's machine would be another folder on each executor, so there
    the setting is needed.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="roamgrid-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end the paths that were made inside, but for those added to the set that it gives.

    What is computed from them must be written by then.
    """
    start, kept = len(_made), set()
    try:
        yield kept
    finally:
        for path in _made[start:]:
            if path not in kept:
                delete_path(spark, path)
        _made[start:] = [p for p in _made[start:] if p in kept]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session that hold inside, ``__`` standing for a dot; for what is written there."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
