"""SimHash groups against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from roamgrid.llm import registry, simhash
from roamgrid.llm.components import connected_components
from tests.llm.samples import ODD, no_documents, odd_documents


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def near(fps, reach=2):
    x = np.array(fps, np.uint64)
    return [(fps[i], fps[j]) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= reach) + i + 1]


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    component = groups(near(sorted(set(fps))), set(fps))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[component[f]] = min(i, least.get(component[f], i))
    return sorted(((i, f"{f:016x}", least.get(component[f])) for (i, _), f in zip(rows, fps)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(registry.op6_simhash_groups(spark, sf)) == expected(rows)


def test_odd_rows(spark):
    assert found(simhash.near_duplicates(odd_documents(spark))) == expected([(i, t) for i, t in ODD if t is None or len(t) < 200_000] + [r for r in ODD if r[1] and len(r[1]) >= 200_000])
    assert found(simhash.near_duplicates(no_documents(spark))) == []


@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.text(st.sampled_from("abAB Éé \t\x0b\n\x1c\x85"), max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("sample,shard_rows", [(32_768, 1024), (200, 32), (5, 64), (1, 1)])
def test_links_span_all_near_pairs(spark, sample, shard_rows):
    random = np.random.default_rng(sample)
    x = random.integers(0, 2**64, 400, np.uint64)
    for _ in range(4):  # chains of near ones, and some three bits away
        flips = np.bitwise_or.reduce(np.uint64(1) << random.integers(0, 64, (len(x), 3)).astype(np.uint64), axis=1)
        x = np.unique(np.concatenate([x, x[:200] ^ flips[:200], x[100:200] ^ (flips[100:200] & -flips[100:200])]))
    fps = x.view(np.int64).tolist()
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    given_pairs = [tuple(r) for r in simhash.links(distinct, 2, sample, shard_rows).collect()]
    as_unsigned = lambda n: n % 2**64
    true_pairs = near([as_unsigned(f) for f in fps])
    same = lambda pairs: groups(pairs, [as_unsigned(f) for f in fps])
    assert same([(as_unsigned(a), as_unsigned(b)) for a, b in given_pairs]) == same(true_pairs)
    assert len(given_pairs) < 40 * len(fps)


def test_components(spark):
    random = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in random.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == groups([p for p in pairs if p[0] != p[1]], nodes)
    assert connected_components(edges.where("a < 0")).count() == 0
