"""Exact top-k by inner product with a vector-approximation file.

1. Vectors are turned into integers.  The approximation file holds for each vector one byte a
   dimension: the number of a cell.  Cells lie between marks, which are quantiles of a bounded sample
   within each dimension's exact ends, so far-off vectors don't widen the others' cells.
2. Queries are broadcast in chunks of bounded size.  For a chunk the cells, and nothing else, are
   scanned where they lie: each task keeps the k best lower bounds of every query over all its
   vectors, and gives those vectors whose upper bound reaches the k-th of them.
3. The k-th best lower bound over all tasks leaves each query few candidates.
4. Exact vectors are read in order of falling upper bounds, some more each round, until no next upper
   bound can reach the k-th exact score; after the first round few queries are left.

Only the first k + 1 copies of a vector can be among k results, so further copies are left out before,
by a window that Spark limits ahead of the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.plans.storage import written

SCALE = 256
CELLS = 256
#: Vectors and bytes of them that the marks are fitted on, at most; those with the smallest hashes of vec_id.
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 1 << 24
#: Bytes of queries that are broadcast at a time.
CHUNK_BYTES = 1 << 25
#: Vectors and queries of which bounds are worked out at a time.
DATA_ROWS, QUERY_ROWS = 2_048, 256
#: Candidates of a query that are read exactly in the first round, in multiples of k.
FIRST_ROUND = 4
#: Candidates up to this number are broadcast to the exact vectors.
BROADCAST_CANDIDATES = 1_000_000
#: Scaled components up to this size are scored in 64-bit integers, larger ones in Python's.
SMALL = 1 << 26
LONG = 1 << 63
LARGEST = float(np.finfo(np.float64).max)


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` (floor of 256 times each component, as doubles) of the vectors that take part.

    Those that are null, empty or hold null or non-finite components, and rows without an id, don't.
    A finite component whose 256-fold is no double counts as the largest double of its sign.
    Repeated rows count once.  Other columns are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    # rounded down as a double, as a component need not fit a long; doubles from 2**53 on are whole
    down = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    # what is finite but overflows when scaled counts as the largest double of its sign
    within = lambda y: F.least(F.greatest(y, F.lit(-LARGEST)), F.lit(LARGEST))
    whole = F.transform(v, lambda x: down(within(x * SCALE)))
    return table.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")).where("vec_id IS NOT NULL").distinct()


class Marks:
    """Cells of one length of vectors: between ``marks[d]`` and the next for each dimension d."""

    def __init__(self, low: np.ndarray, high: np.ndarray, sample: np.ndarray, cells: int = CELLS):
        share = np.arange(1, cells) / cells
        inner = np.quantile(sample, share, axis=0).T if len(sample) else low[:, None] + (high - low)[:, None] * share
        self.inner = np.clip(inner, low[:, None], high[:, None])
        ends = np.concatenate([low[:, None], self.inner, high[:, None]], axis=1)
        # halves first: the sum of two ends need not be a double
        self.middle, self.half = ends[:, 1:] / 2 + ends[:, :-1] / 2, ends[:, 1:] / 2 - ends[:, :-1] / 2

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(m, c, side="right") for m, c in zip(self.inner, x.T)], axis=1).astype(np.uint8)

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of every query's inner product with every vector, within a long's ends."""
        at = np.arange(cells.shape[1])
        middle, half = self.middle[at, cells], self.half[at, cells]
        with np.errstate(over="ignore", invalid="ignore"):
            score, room = q @ middle.T, np.abs(q) @ half.T
            # and room for the rounding of these sums
            room += 1e-9 * (np.abs(q) @ (np.abs(middle) + half).T) + 1e-6
            low, high = score - room, score + room
        # sums of infinities say nothing
        low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
        return np.clip(low, -float(LONG), float(LONG)), np.clip(high, -float(LONG), float(LONG))


class Candidates:
    """The vectors that may be among the k best of each query, over the blocks met so far."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.best = np.full((len(query_ids), k), -np.inf)
        self.found: list[list[np.ndarray]] = [[], [], [], []]
        self.held = 0

    def add(self, first: int, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        """Bounds of a block of vectors for the queries from ``first`` on."""
        own = self.query_ids[first : first + len(lower), None] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        best = self.best[first : first + len(lower)]
        many = min(self.k, len(ids))
        top = np.partition(lower, len(ids) - many, axis=1)[:, len(ids) - many :]
        both = np.concatenate([best, top], axis=1)
        best[:] = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :]
        q, v = np.nonzero((upper >= best.min(axis=1)[:, None]) & ~own)
        for column, more in zip(self.found, (q + first, ids[v], lower[q, v], upper[q, v])):
            column.append(more)
        self.held += len(q)
        if self.held > 64 * self.k * len(self.query_ids) + 100_000:
            self.result()

    def result(self) -> list[np.ndarray]:
        """Query's place, vector's id, lower and upper bound of each candidate that is left."""
        q, ids, lower, upper = (np.concatenate(c) if c else np.zeros(0) for c in self.found)
        left = upper >= self.best.min(axis=1)[q.astype(np.int64)]
        self.found = [[c[left]] for c in (q.astype(np.int64), ids.astype(np.int64), lower, upper)]
        self.held = int(left.sum())
        return [c[0] for c in self.found]


def _rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the rows of each length in a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(), np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        out.append((at, values[starts[at][:, None] + np.arange(dim)]))
    return out


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers; beyond a long they stop at its ends."""
    if max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) <= SMALL and x.shape[1] < 1 << 10:
        return np.einsum("ij,ij->i", x.astype(np.int64), q.astype(np.int64))
    return np.array([max(-LONG, min(LONG - 1, sum(int(a) * int(b) for a, b in zip(r, s)))) for r, s in zip(x, q)], dtype=np.int64)


def fit_marks(data: DataFrame) -> dict[int, Marks]:
    """Marks of each length of vectors: exact ends, quantiles of the sample."""

    def ends(batches):
        for b in batches:
            for _, x in _rows(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x.min(axis=0)], pa.list_(pa.float64())), pa.array([x.max(axis=0)], pa.list_(pa.float64()))], names=["dim", "low", "high"])

    far = data.select("v").mapInArrow(ends, "dim int, low array<double>, high array<double>")
    # each dimension's ends, so that no list of batches is gathered
    far = far.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("d", "e")).groupBy("dim", "d").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    found = far.toPandas().sort_values(["dim", "d"])
    rows = int(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(found["dim"].max(), 1))))) if len(found) else 1
    some: dict[int, list] = {}
    for r in data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("v").collect():
        some.setdefault(len(r[0]), []).append(r[0])
    return {int(dim): Marks(of["low"].to_numpy(), of["high"].to_numpy(), np.array(some.get(dim, []), float).reshape(-1, dim)) for dim, of in found.groupby("dim")}


def approximation_file(data: DataFrame, marks) -> DataFrame:
    """``vec_id``, ``dim`` and ``cells``, a byte a dimension, of each vector, written."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for at, x in _rows(b.column(1)):
                cells = marks.value[x.shape[1]].cells(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array([c.tobytes() for c in cells], pa.binary())], names=["vec_id", "dim", "cells"])

    return written(data.mapInArrow(run, "vec_id long, dim int, cells binary"), "cells")


def scan_cells(file: DataFrame, marks, queries: list, k: int) -> DataFrame:
    """``qno``, ``vec_id``, ``lower`` and ``upper`` of each task's candidates for these queries, rows of
    ``qno``, ``query_id`` and ``v``."""
    asked = {}
    for dim in {len(r.v) for r in queries}:
        of = [r for r in queries if len(r.v) == dim]
        asked[dim] = tuple(np.array(c) for c in ([r.qno for r in of], [r.query_id for r in of], [r.v for r in of]))
    there = file.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        kept = {dim: Candidates(ids, k) for dim, (_, ids, _) in there.value.items()}
        for b in batches:
            ids, dims = b.column(0).to_numpy(), b.column(1).to_numpy()
            for dim in set(dims.tolist()) & set(kept):
                at = np.flatnonzero(dims == dim)
                cells = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, dim)
                q = there.value[dim][2]
                for i in range(0, len(at), DATA_ROWS):
                    for j in range(0, len(q), QUERY_ROWS):
                        kept[dim].add(j, ids[at[i : i + DATA_ROWS]], *marks.value[dim].bounds(q[j : j + QUERY_ROWS], cells[i : i + DATA_ROWS]))
        for dim, found in kept.items():
            q, ids, lower, upper = found.result()
            yield pa.RecordBatch.from_arrays([pa.array(there.value[dim][0][q]), pa.array(ids), pa.array(lower), pa.array(upper)], names=["qno", "vec_id", "lower", "upper"])

    return file.where(F.col("dim").isin([int(d) for d in asked])).mapInArrow(run, "qno long, vec_id long, lower double, upper double")


def read_exactly(wanted: DataFrame, data: DataFrame, queries: DataFrame) -> DataFrame:
    """``qno``, ``query_id``, ``vec_id`` and ``score`` of candidates ``qno`` and ``vec_id``."""
    wanted = written(wanted, "wanted")
    few = wanted.count() <= BROADCAST_CANDIDATES
    pairs = data.join(F.broadcast(wanted) if few else wanted, "vec_id").join(queries.withColumnRenamed("v", "q"), "qno").where(F.size("v") == F.size("q"))

    def run(batches):
        for b in batches:
            scores = np.zeros(b.num_rows, np.int64)
            for (at, x), (_, q) in zip(_rows(b.column(3)), _rows(b.column(4))):
                scores[at] = exact(x, q)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(scores)], names=["qno", "query_id", "vec_id", "score"])

    return pairs.select("qno", "query_id", "vec_id", "v", "q").mapInArrow(run, "qno long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, chunk_bytes: int = CHUNK_BYTES, first_round: int = FIRST_ROUND) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k best of all other rows.

    Both inputs are ``vec_id`` and ``v`` as integer_vectors gives them.  Ties go to the smaller
    vec_id.  Only vectors of a query's length are its candidates; a query without any has no row.  An
    id with several vectors counts with its best score, and as a query with all its vectors.
    """
    spark = vectors.sparkSession
    copies = Window.partitionBy("v").orderBy("vec_id")
    data = written(vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    queries = written(queries.select(F.monotonically_increasing_id().alias("qno"), F.col("vec_id").alias("query_id"), "v"), "queries")
    # so many rows hold k different ids
    rows = k * (data.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 1)
    marks = spark.sparkContext.broadcast(fit_marks(data))
    file = approximation_file(data, marks)
    size = queries.agg(F.sum(F.size("v") * 8 + 16)).head()[0] or 0
    chunks = int(-(-size // chunk_bytes)) or 1
    found = None
    for chunk in range(chunks):
        asked = queries.where(F.pmod(F.xxhash64("qno"), F.lit(chunks)) == chunk).collect()
        part = written(scan_cells(file, marks, asked, rows), "candidates")
        found = part if found is None else found.unionByName(part)
    # the k-th best lower bound, and the candidates that reach it, in order of upper bounds
    lows = found.withColumn("at", F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("lower")))).where(F.col("at") <= rows)
    sure = lows.groupBy("qno").agg(F.when(F.count("*") >= rows, F.min("lower")).otherwise(float("-inf")).alias("sure"))
    place = F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("upper"), "vec_id"))
    left = written(found.join(sure, "qno").where("upper >= sure").withColumn("place", place).drop("lower", "sure"), "left_candidates")
    read, upto, scores = 0, first_round * rows, None
    wanted = left
    while True:
        part = written(read_exactly(wanted.where(F.col("place").between(read + 1, upto)).select("qno", "vec_id").distinct(), data, queries), "scores")
        scores = part if scores is None else scores.unionByName(part)
        # open are those whose next upper bound may still reach the k-th exact score
        at = F.row_number().over(Window.partitionBy("qno").orderBy(F.desc("score")))
        certain = scores.withColumn("at", at).where(F.col("at") == rows).select("qno", F.col("score").alias("kth"))
        still = left.where(F.col("place") == upto + 1).join(certain, "qno", "left").where("kth IS NULL OR upper >= kth").select("qno")
        still = written(still, "open_queries")
        if still.isEmpty():
            break
        wanted = left.join(still, "qno", "left_semi")
        read, upto = upto, 4 * upto
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
