"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.plans.storage import delete_path, new_path, written

#: Edges that one task joins by itself; more go by rounds, of which each has plans that the driver holds.
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, few: int = 0) -> DataFrame:
    """``(node, root)`` for each node of an edge, root being the component's smallest node.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; order, repeats and loops don't
    matter.  An edgeless input gives an empty table.  Every round writes its edges to the shared
    folder, so a lost executor costs one round at most; the groups of a round are only minima,
    taken before the shuffle.  Up to ``few`` edges are joined in one task instead.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    if few:
        now = written(now, "edges")
        if now.count() <= few:
            kind = now.schema["a"].dataType.simpleString()
            return written(now.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), "components")
    before, old = None, None
    while True:
        path = new_path(spark, "stars")
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        if old:
            delete_path(spark, old)
        old = path
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = seen
        now = _small_star(_large_star(now))


def _joined(batches):
    """Node and root of all edges (larger, smaller), by halving ways to the smallest node."""
    given = [b for b in batches if b.num_rows]
    if not given:
        return
    a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in given]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        for ends in (x, y):
            np.minimum.at(root, root[ends], least)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
