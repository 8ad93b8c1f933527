"""Prebuilt tables as Parquet beside a record of the settings they were built with."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _meta(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}_meta")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.text(f"{path}_meta").head()[0]


def cached(spark: SparkSession, path: str, settings: dict, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """The table at ``path`` if it was built with these settings, else built and written anew.

    The record is written last, so a table that was left half written is never taken.
    """
    want = json.dumps(settings, sort_keys=True)
    if _meta(spark, path) != want:
        build().write.mode("overwrite").partitionBy(*partition_by or []).parquet(path)
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}_meta")
    return spark.read.parquet(path)
