"""Sharding by extendible hashing: a directory over the leading bits of a hash of the key.

A bucket is a prefix of the hash; it is split on the next bit only while its rows exceed the byte
limit.  Spark sums the bytes of every prefix of up to ROUND_BITS more bits of the buckets that are
still too large; the splitting itself needs nothing else.  Rows whose whole hash is equal cannot be
told apart by more bits: their bucket goes on by a hash of the row's whole content, and rows alike
in that too by numbered overflow shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamgrid.plans.storage import written

LIMIT_BYTES = 1 << 20
#: Bits by which a round may deepen a bucket, and bits of a row: half of the key, half of the content.
ROUND_BITS, HASH_BITS = 12, 128
#: Directory entries up to this number are broadcast, more are joined by a shuffle.
BROADCAST_ENTRIES = 500_000


def hash_bits(content: Column) -> Column:
    """The first 64 bits of the MD5 of a text, as a string of 0 and 1; any engine can repeat it."""
    digits = F.translate(F.substring(F.md5(content.cast("binary")), 1, 16), "0123456789abcdef", "ghijklmnopqrstuv")
    for digit in range(16):
        digits = F.replace(digits, F.lit("ghijklmnopqrstuv"[digit]), F.lit(format(digit, "04b")))
    return digits


def directory(rows: DataFrame, limit: int, round_bits: int = ROUND_BITS) -> DataFrame:
    """``prefix`` and ``shard_bytes`` of each shard, for ``rows`` of ``bits`` and ``bytes``.

    No prefix begins another and they cover all rows.  A prefix of all bits may exceed the limit.
    """
    rows = written(rows.groupBy("bits").agg(F.sum("bytes").alias("bytes")), "hash_bytes")
    found, depth, still = [], 0, None
    while True:
        deepest = min(depth + round_bits, HASH_BITS)
        open_rows = rows
        if still is not None:
            open_rows = rows.withColumn("prefix", F.substring("bits", 1, depth)).join(still, "prefix", "left_semi")
        fine = open_rows.groupBy(F.substring("bits", 1, deepest).alias("fine")).agg(F.sum("bytes").alias("bytes"))
        levels = fine.withColumn("depth", F.explode(F.sequence(F.lit(depth), F.lit(deepest))))
        sums = levels.groupBy(F.expr("substring(fine, 1, depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        sums = written(sums, "prefix_bytes")
        # a bucket becomes a shard if it fits, or has no more bits, while the one a bit shorter doesn't fit
        ends = (F.col("bytes") <= limit) | (F.length("prefix") == HASH_BITS)
        large = sums.where(~ends).select(F.col("prefix").alias("shorter"))
        ended = sums.where(ends).withColumn("shorter", F.expr("substring(prefix, 1, length(prefix) - 1)"))
        found.append(ended.where(F.length("prefix") > depth).join(large, "shorter", "left_semi").select("prefix", F.col("bytes").alias("shard_bytes")))
        if not depth:
            found.append(ended.where(F.length("prefix") == 0).select("prefix", F.col("bytes").alias("shard_bytes")))
        still = large.where(F.length("shorter") == deepest).withColumnRenamed("shorter", "prefix")
        if deepest == HASH_BITS or still.isEmpty():
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out
        depth = deepest


def assign(rows: DataFrame, limit: int = LIMIT_BYTES, round_bits: int = ROUND_BITS) -> DataFrame:
    """``rows`` of ``doc_id``, ``bytes`` and ``bits`` with ``shard`` and ``shard_bytes``, bits left out.

    ``shard`` is the hash prefix, ``~`` for the only bucket of a small table.  Rows that are alike in
    all bits and don't fit one shard get shards ``prefix/number`` of as many rows as fit, one at least.
    """
    shards = written(directory(rows.select("bits", "bytes"), limit, round_bits), "directory")
    # the lengths that occur are at most as many as there are bits
    depths = sorted(r[0] for r in shards.select(F.length("prefix")).distinct().collect())
    tried = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths] or [F.lit(0)])))
    tried = tried.withColumn("prefix", F.expr("substring(bits, 1, depth)"))
    few = shards.count() <= BROADCAST_ENTRIES
    dealt = tried.join(F.broadcast(shards) if few else shards, "prefix").select("doc_id", "bytes", "prefix", "shard_bytes")
    named = F.when(F.length("prefix") == 0, "~").otherwise(F.col("prefix"))
    fit = dealt.where(~((F.length("prefix") == HASH_BITS) & (F.col("shard_bytes") > limit)))
    alike = dealt.where((F.length("prefix") == HASH_BITS) & (F.col("shard_bytes") > limit))
    # alike rows are counted and dealt out again by number, so no task meets all of them
    alike = alike.groupBy("doc_id", "bytes", "prefix").agg(F.count("*").alias("n"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))))
    alike = alike.withColumn("room", room).withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("room")))))
    alike = alike.withColumn("many", F.least("room", F.col("n") - F.col("number") * F.col("room"))).repartition("prefix", "number")
    alike = alike.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("many").cast("int"))))
    return fit.select("doc_id", "bytes", named.alias("shard"), "shard_bytes").unionByName(
        alike.select("doc_id", "bytes", F.concat_ws("/", "prefix", "number").alias("shard"), (F.col("many") * F.col("bytes")).alias("shard_bytes"))
    )


def shard_documents(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``doc_id``, ``bytes`` (of the text in UTF-8), ``shard`` and ``shard_bytes`` for each document.

    The key is doc_id, null being one key; equal keys are told apart by their texts.  A null text has
    0 bytes.  Every shard fits the limit but for single texts that exceed it.  Repeated rows stay
    repeated; other columns are left out; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = F.concat(hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), hash_bits(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), bits.alias("bits"))
    return assign(written(rows, "hashed"), limit)

