"""SimHash near-duplicate groups found with a vantage-point tree over the fingerprints.

1. Fingerprints: one pass over the texts, nothing but 8 bytes a document leaves it.
2. Equal fingerprints become one row, so a group of copies of any size costs one row.
3. A vantage-point tree is fitted on a bounded sample of distinct fingerprints.  Each node has a
   vantage point and a radius; its two halves hold the fingerprints within the radius and beyond.
4. Every distinct fingerprint is stored in the shard of its own leaf and sent as a probe to those
   later leaves that the triangle inequality cannot exclude.  A leaf with many rows has several
   shards, told apart by a hash.
5. A task reads a shard's stored rows, then its probes in batches, and compares them exactly.  It
   gives a spanning forest of the links that it finds, never all pairs.
6. Connected components over these links, then back to the documents.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamgrid.llm.components import connected_components
from roamgrid.llm.rows import join_groups
from roamgrid.plans.storage import written

BITS = 64
#: Fingerprints that the tree is fitted on, at most; they are the ones with the smallest hashes.
SAMPLE = 32_768
#: Stored rows that a shard should hold.
SHARD_ROWS = 1_024
#: Probes compared with a shard's stored rows at a time.
BLOCK = 256

_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles; 0 for a text without words or null."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    n = max(1, len(w) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    columns = h.view(np.uint8).reshape(n, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BIT_OF for k in range(8)])
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) for each row."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """A tree of (vantage point, radius, inner child, outer child); a leaf is a number."""

    def __init__(self, points: np.ndarray, leaf_points: float, reach: int):
        self.reach, self.leaves = reach, 0
        self.root = self._build(points.astype(np.uint64), max(1.0, leaf_points))

    def _build(self, points, leaf_points):
        best = None
        if len(points) > leaf_points:
            for v in points[:: max(1, len(points) // 8)][:8]:
                d = np.bitwise_count(points ^ v)
                radius = int(np.median(d))
                radius -= not (d > radius).any()
                inner = d <= radius
                if inner.any() and not inner.all():
                    both = ((d >= radius - self.reach + 1) & (d <= radius + self.reach)).mean()
                    score = both + abs(inner.mean() - 0.5)
                    if best is None or score < best[0]:
                        best = score, v, radius, inner
        if best is None:
            self.leaves += 1
            return self.leaves - 1
        _, v, radius, inner = best
        left = self._build(points[inner], leaf_points)
        return v, radius, left, self._build(points[~inner], leaf_points)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each fingerprint's own leaf, and (row, leaf) of the later leaves that its ball may meet."""
        home = np.empty(len(x), np.int32)
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        stack = [(self.root, np.arange(len(x)), np.ones(len(x), bool))]
        while stack:
            node, at, own = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                home[at[own]] = node
                rows.append(at[~own])
                leaves.append(np.full(len(rows[-1]), node, np.int32))
                continue
            v, radius, left, right = node
            d = np.bitwise_count(x[at] ^ v).astype(np.int16)
            inner = d <= radius
            go = d <= radius + self.reach
            stack.append((left, at[go], (own & inner)[go]))
            go = d > radius - self.reach
            stack.append((right, at[go], (own & ~inner)[go]))
        rows, leaves = np.concatenate(rows), np.concatenate(leaves)
        later = leaves > home[rows]
        return home, rows[later], leaves[later]


def links(distinct: DataFrame, reach: int = 2, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints of column ``fp`` that span each component.

    Two fingerprints are joined by returned pairs if and only if they are by pairs that differ in
    ``reach`` bits or fewer.  A returned pair may stand for two such pairs that share a fingerprint.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    points = [r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    tree = VantageTree(np.array(points, np.int64).view(np.uint64), shard_rows * len(points) / max(n, 1), reach)
    tree_there = spark.sparkContext.broadcast(tree)

    def homes(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            leaf, many = np.unique(tree_there.value.route(x)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), pa.array(many, pa.int64())], names=["leaf", "n"])

    counted = distinct.select("fp").mapInArrow(homes, "leaf int, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    shards = np.ones(tree.leaves, np.int64)  # a number for each leaf, of which the sample bounds the count
    for leaf, many in counted.collect():
        shards[leaf] = -(-many // shard_rows)
    shards_there = spark.sparkContext.broadcast(shards)

    def deal(batches):
        """Stored rows have probe = 0, probes 1."""
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            home, rows, leaves = tree_there.value.route(fp.view(np.uint64))
            shards = shards_there.value
            mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = mixed.astype(np.int64) % shards[home]
            crowded = np.flatnonzero(part + 1 < shards[home])
            times = shards[leaves]
            sent = [np.repeat(rows, times), np.repeat(crowded, (shards[home] - part - 1)[crowded])]
            to = [np.repeat(leaves, times), home[sent[1]]]
            parts = [_counting(times), part[sent[1]] + 1 + _counting((shards[home] - part - 1)[crowded])]
            columns = (
                np.concatenate([home, *to]).astype(np.int32),
                np.concatenate([part, *parts]).astype(np.int32),
                np.concatenate([np.zeros(len(fp), np.int8), np.ones(len(sent[0]) + len(sent[1]), np.int8)]),
                np.concatenate([fp, fp[sent[0]], fp[sent[1]]]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["leaf", "part", "probe", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "leaf int, part int, probe tinyint, fp long")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(width, "leaf", "part").sortWithinPartitions("leaf", "part", "probe", "fp")
    return dealt.mapInArrow(lambda batches: _matches(batches, reach), "a long, b long")


def _counting(times: np.ndarray) -> np.ndarray:
    """0..t-1 for each t of times."""
    ends = np.cumsum(times)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)


class _Shard:
    """Stored fingerprints of a shard; matching probes and rows join their labels."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.stored: np.ndarray | None = None

    def add(self, fp):
        self.parts.append(fp)

    def close(self, reach):
        if self.stored is None:
            self.stored = np.concatenate([*self.parts, np.zeros(0, np.uint64)])
            self.label = np.arange(len(self.stored))
            self.probe(self.stored, reach)

    def probe(self, fp, reach):
        """Links (probe, a stored row) of the probes that match; what one matches becomes one label."""
        found = [], []
        for i in range(0, len(fp), BLOCK):
            near = np.bitwise_count(fp[i : i + BLOCK, None] ^ self.stored[None, :]) <= reach
            many = near.sum(axis=1)
            for k in np.flatnonzero(many):
                at = np.flatnonzero(near[k])
                found[0].append(fp[i + k])
                found[1].append(self.stored[at[0]])
                if len(at) > 1:
                    labels = self.label[at]
                    least = labels.min()
                    if (labels != least).any():
                        self.label[np.isin(self.label, labels)] = least
        return found

    def links(self):
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.stored[own], self.stored[self.label[own]]


def _matches(batches, reach):
    """Reads rows in order of (leaf, part, probe)."""
    key, shard = None, _Shard()

    def given(a, b):
        a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        leaf, part, probe = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        runs = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(part) != 0) | (np.diff(probe) != 0)) + 1
        for a, b in zip([0, *runs], [*runs, len(fp)]):
            if a == b:
                continue
            if (leaf[a], part[a]) != key:
                if key is not None:
                    shard.close(reach)
                    yield given(*shard.links())
                key, shard = (leaf[a], part[a]), _Shard()
            if probe[a]:
                shard.close(reach)
                yield given(*shard.probe(fp[a:b], reach))
            else:
                shard.add(fp[a:b])
    if key is not None:
        shard.close(reach)
        yield given(*shard.links())


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row of ``docs``.

    Documents are linked whose fingerprints differ in ``reach`` bits or fewer; a component's id is
    its smallest doc_id.  Empty and null texts have fingerprint 0 and are linked like any other.
    Rows with a null doc_id take part; a component of such rows alone has a null id.  Repeated rows
    stay repeated; other columns are left out.  An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct_fingerprints")
    roots = connected_components(links(distinct, reach))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(groups, "root").select("fp", "n", "component_id"), "named_fingerprints")
    return join_groups(fps, named, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
