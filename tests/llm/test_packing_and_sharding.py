"""Length buckets and extendible shards against plain Python."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roamgrid.llm import packing, registry, sharding
from tests.llm.samples import DOCUMENTS, ODD, no_documents, odd_documents

SF = "/root/testdata/sf0.001"


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_have_the_least_padding(histogram, buckets):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    bounds = packing.choose_bounds(np.array(lengths), np.array(counts), buckets)
    assert len(bounds) <= buckets and bounds[-1] == lengths[-1]
    best = min(padding(lengths, counts, [*some, lengths[-1]]) for k in range(buckets) for some in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
    assert padding(lengths, counts, bounds) == best


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) + 1


def check_packed(rows, got, buckets=packing.BUCKETS, budget=packing.TOKEN_BUDGET):
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, words(t)) for i, t in rows)
    histogram = Counter(words(t) for _, t in rows)
    lengths = sorted(histogram)
    bounds = packing.choose_bounds(np.array(lengths), np.array([histogram[x] for x in lengths]), buckets)
    batches = defaultdict(list)
    for r in got:
        assert r.bucket_bound == min(b for b in bounds if b >= r.n_tokens)
        assert r.batch_id.startswith(f"{r.bucket_bound}:")
        batches[r.batch_id].append(r.place)
    of_bucket = defaultdict(dict)
    for name, places in batches.items():
        bound, number = map(int, name.split(":"))
        assert sorted(places) == list(range(len(places))) and (len(places) * bound <= budget or len(places) == 1)
        of_bucket[bound][number] = len(places)
    for bound, sizes in of_bucket.items():  # all batches but the last are full
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(n == max(1, budget // bound) for k, n in sizes.items() if k < len(sizes) - 1)


def test_packing_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(rows, registry.op8_length_buckets(spark, SF).collect())


def test_no_length_is_rounded(spark):
    """More than 20,000 distinct lengths of which one is very long; the short ones keep their own bounds."""
    lengths = [2_000_000, *range(2, 20_010), *[3] * 5_000, *[7] * 5_000]
    rows = spark.createDataFrame([(i, "", n) for i, n in enumerate(lengths)], "doc_id long, text string, n long")
    found, counts = packing.histogram(rows.select(F.col("n").alias("n_tokens")))
    want = Counter(lengths)
    assert dict(zip(found.tolist(), counts.tolist())) == want and list(found) == sorted(want)
    got = packing.pack(rows, length=F.col("n")).select("n_tokens", "bucket_bound").distinct().collect()
    bounds = packing.choose_bounds(found, counts)
    assert all(r.bucket_bound == min(b for b in bounds if b >= r.n_tokens) for r in got) and len(bounds) == packing.BUCKETS
    step = 100  # what a step of longest / 20,000 would give
    rounded = Counter(-(-x // step) * step for x in lengths)
    coarse = packing.choose_bounds(np.array(sorted(rounded)), np.array([rounded[x] for x in sorted(rounded)]))
    exact = padding(list(want), list(want.values()), bounds)
    assert exact < padding(list(want), list(want.values()), coarse)


def test_packing_odd_rows(spark):
    check_packed(ODD, packing.pack(odd_documents(spark)).collect())
    check_packed(ODD, packing.pack(odd_documents(spark), 2, 64).collect(), 2, 64)
    empty = packing.pack(no_documents(spark))
    assert empty.count() == 0 and empty.columns == packing.pack(odd_documents(spark)).columns


def test_many_lengths_are_rounded_up(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("n_tokens"))
    lengths, counts = packing.histogram(rows, 25)
    assert lengths.tolist() == list(range(4, 101, 4)) and counts.tolist() == [4] * 25


def plain_bits(i, text):
    half = lambda s: "".join(f"{int(c, 16):04b}" for c in hashlib.md5(s.encode()).hexdigest()[:16])
    return half("" if i is None else str(i)) + half(text or "")


def plain_shards(rows, limit):
    """Prefix of each row, by splitting buckets one after the other."""
    out, todo = {}, [("", [(k, plain_bits(i, t), len((t or "").encode())) for k, (i, t) in enumerate(rows)])]
    while todo:
        prefix, members = todo.pop()
        total = sum(m[2] for m in members)
        if total <= limit or len(prefix) == 128:
            out |= {k: (prefix, total) for k, _, _ in members}
            continue
        for bit in "01":
            todo.append((prefix + bit, [m for m in members if m[1][len(prefix)] == bit]))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 30_000, 2_000])
def test_shards_of_all_documents(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = sorted((i, len((t or "").encode()), *shard) for (i, t), shard in zip(rows, (v for _, v in sorted(plain_shards(rows, limit).items()))))
    got = sorted((r.doc_id, r.bytes, "" if r.shard == "~" else r.shard.split("/")[0], r.shard_bytes) for r in sharding.shard_documents(docs, limit).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == w[3] for g, w in zip(got, want) if len(w[2]) < 128)
    names = sorted({g[2] for g in got})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))


def test_odd_rows_and_rows_alike(spark):
    got = sharding.shard_documents(odd_documents(spark), 50_000).collect()
    assert sorted((r.doc_id or 0, r.bytes) for r in got) == sorted((i or 0, len((t or "").encode())) for i, t in ODD)
    assert sharding.shard_documents(no_documents(spark)).count() == 0
    alike = spark.createDataFrame([(1, "x" * 40, None, None, None)] * 25 + [(2, "y", None, None, None)], DOCUMENTS)
    got = sharding.shard_documents(alike, 100).collect()
    total = Counter()
    for r in got:
        total[r.shard] += r.bytes
    assert len(got) == 26 and max(total.values()) <= 100
    assert all(total[r.shard] == r.shard_bytes for r in got)


def test_buckets_split_over_many_rounds(spark):
    rows = [(i, "z" * 50, None, None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = F.concat(sharding.hash_bits(F.col("doc_id").cast("string")), sharding.hash_bits(text))
    hashed = docs.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), bits.alias("bits"))
    got = {r.doc_id: r.shard for r in sharding.assign(hashed, 120, round_bits=3).collect()}
    assert got == {i: plain_shards([r[:2] for r in rows], 120)[i][0] for i in range(200)}
