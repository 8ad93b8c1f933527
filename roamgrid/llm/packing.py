"""Packing texts of like length: length buckets that minimise padding, and batches inside them.

The lengths' histogram of the whole corpus is the only thing that comes to the driver.  Dynamic
programming over it chooses the bounds of a given number of buckets with the least total padding.
Inside a bucket every text is padded to the bound, and a batch takes as many as its token budget
holds.  Places in a bucket are given without a global sort: rows are numbered inside hash cells and
the cells' counts, added up, say where each cell begins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamgrid.plans.storage import shuffle_width, written

BUCKETS = 16
TOKEN_BUDGET = 16_384
#: Rows alike in doc_id and length that one task makes rows again of, at most.
ALIKE = 10_000


def word_count(text: Column) -> Column:
    """Words between blanks, plus one for the end of the text; null counts as empty."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def choose_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of up to ``buckets`` buckets with the least total padding.

    ``lengths`` ascending and distinct.  The cost of a bucket from i to j is
    ``lengths[j] * count(i..j) - tokens(i..j)``, which has monotone best splits, so each row of the
    program is solved by halving, a level at a time in O(n).  Ties go to the earliest split.
    """
    n = len(lengths)
    if not n:
        return []
    number = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(lengths.astype(float) * counts)])
    upto = lengths * number[1:] - tokens[1:]  # one bucket for 0..j
    splits = []
    for _ in range(min(buckets, n) - 1):
        best, split = np.empty(n), np.zeros(n, np.int64)
        # level by level: the middles of all ranges are solved between their neighbours' splits
        lo, hi, s_lo, s_hi = (np.array([x]) for x in (0, n - 1, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(j, s_hi) - s_lo + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(start - s_lo, size)  # the last bucket begins at i
            to = np.repeat(j, size)
            before = np.where(i > 0, upto[i - 1], 0.0)
            cost = before + lengths[to] * (number[to + 1] - number[i]) - (tokens[to + 1] - tokens[i])
            least = np.minimum.reduceat(cost, start)
            at = np.flatnonzero(cost == np.repeat(least, size))
            best[j], split[j] = least, i[at[np.searchsorted(at, start)]]
            left, right = lo < j, j < hi
            lo, hi, s_lo, s_hi = (
                np.concatenate(x) for x in ((lo[left], j[right] + 1), (j[left] - 1, hi[right]), (s_lo[left], split[j][right]), (split[j][left], s_hi[right]))
            )
        splits.append(split)
        upto = best
    bounds, j = [], n - 1
    for split in reversed(splits):
        bounds.append(int(lengths[j]))
        j = int(split[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(int(lengths[j]))
    return sorted(bounds)


def histogram(rows: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and their counts over all rows, exact; only with ``most`` are they rounded up, to the least step that leaves so many."""
    counted = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    lengths, counts = (counted.column(i).to_numpy().astype(np.int64) for i in range(2))
    if most and len(lengths) > most:
        step = -(-lengths.max() // most)
        lengths = -(-lengths // step) * step
    found, at = np.unique(lengths, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, length: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``n_tokens``, ``bucket_bound``, ``batch_id`` and
    ``place`` (from 0) in its batch.

    A batch holds ``token_budget // bucket_bound`` texts, one at least, so a text longer than the
    budget is a batch of its own and nothing is cut.  Ids of batches are ``bound:number``.  The order
    inside a bucket is by a hash of doc_id, then doc_id (null first) and length; rows alike in these
    are alike in all that is returned.  Null texts count as empty.  An empty table gives an empty
    table; other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text")) if length is None else length.cast("long")).alias("n_tokens"))
    rows = written(rows, "lengths")
    bounds = choose_bounds(*histogram(rows), buckets)
    if not bounds:
        return rows.select("doc_id", "n_tokens", F.col("n_tokens").alias("bucket_bound"), F.lit("").alias("batch_id"), F.lit(0).cast("long").alias("place"))
    bound = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        bound = F.when(F.col("n_tokens") <= b, b).otherwise(bound)
    # many cells to a bucket, so that none is large although one bucket may hold a third of all rows
    cells = 8 * max(shuffle_width(docs.sparkSession), rows.count() // 50_000)
    rows = rows.withColumn("bucket_bound", bound.cast("long")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(cells)).cast("int"))
    # rows alike in all that counts are one row with their number, so that none of them are sorted
    alike = rows.groupBy("bucket_bound", "cell", "doc_id", "n_tokens").agg(F.count("*").alias("n"))
    sizes = alike.groupBy("bucket_bound", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("bucket_bound").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket_bound", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket_bound", "cell").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alike.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["bucket_bound", "cell"])
    ranked = ranked.withColumn("at", F.col("start") + F.col("at")).drop("start", "cell")
    # many alike are dealt out again by number before they are rows again
    many = ranked.where(F.col("n") > ALIKE).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ALIKE))))
    many = many.withColumn("at", F.col("at") + F.col("part") * ALIKE).withColumn("n", F.least(F.lit(ALIKE), F.col("n") - F.col("part") * ALIKE))
    many = many.repartition(shuffle_width(docs.sparkSession), "bucket_bound", "at").drop("part")
    ranked = ranked.where(F.col("n") <= ALIKE).unionByName(many).withColumn("at", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)))
    at, room = F.col("at"), F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_bound")))
    return ranked.select(
        "doc_id", "n_tokens", "bucket_bound", F.concat_ws(":", "bucket_bound", F.floor(at / room)).alias("batch_id"), F.pmod(at, room).alias("place")
    )
