"""Top-k search against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamgrid.llm import registry, vector_search

VECTORS = "vec_id long, embedding array<double>, v string, copy int"


def brute(rows, k=5, asked=lambda i: i % 50 == 0):
    largest = float(np.finfo(np.float64).max)
    usable = [(i, [int(np.floor(max(-largest, min(largest, 256.0 * x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if asked(q):
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in usable if i != q and len(a) == len(b))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def found(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


def search(spark, rows, **how):
    table = vector_search.integer_vectors(spark.createDataFrame([(i, v, None, None) for i, v in rows], VECTORS))
    return found(vector_search.top_k(table, table.where("vec_id % 50 = 0"), **how))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(registry.op2_vector_top_k(spark, sf)) == brute(rows)


def test_odd_vectors_copies_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.1 * (i % 3), -0.2, 0.3]) for i in range(120)]  # hundreds of ties among copies
    rows += [(150, None), (200, []), (250, [nan, 0.0, 0.0]), (300, [inf, 0.0, 0.0]), (350, [None, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(400, [1.0, 2.0]), (401, [1.0, -2.0]), (450, [5.0])]  # other lengths meet their own
    rows += [(0, [0.0, -0.2, 0.3])]  # a repeated row counts once
    assert search(spark, rows, chunk_bytes=64, first_round=1) == brute(list(dict.fromkeys((i, tuple(v) if v is not None else None) for i, v in rows)))
    assert search(spark, []) == set()
    assert search(spark, [(50, [1.0])]) == set()


def test_scores_beyond_a_long_stop_at_its_ends(spark):
    rows = [(0, [1e15, 1.0]), (1, [1.0, 1.0]), (2, [1e3, 7.0]), (3, [-1e3, 0.0])]
    assert search(spark, rows) == brute(rows)


@pytest.mark.parametrize("large", [{7: 1e307}, {7: 1e307, 50: -1e307}, {0: 1.7e308, 8: -1.7e308, 9: 1e300}])
def test_components_that_overflow_when_scaled(spark, large):
    """Finite components count, whatever their 256-fold is: no row of the others is lost."""
    rows = [(i, [large.get(i, 0.01 * (i % 7)), 0.3 - 0.01 * i, -0.2]) for i in range(60)]
    assert search(spark, rows) == brute(rows)
    assert len(brute(rows)) == 10


def test_ids_with_several_vectors(spark):
    rows = [(i % 60, [float(i % 7), float(i % 11) - 5, 1.0]) for i in range(200)]
    best = {}
    for q, _, i, s in brute(list(dict.fromkeys((i, tuple(v)) for i, v in rows)), k=10**6):
        best[q, i] = max(s, best.get((q, i), s))
    want = set()
    for q in {q for q, _ in best}:
        ranked = sorted((-s, i) for (p, i), s in best.items() if p == q)[:5]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)}
    assert search(spark, rows) == want


def test_far_vectors_don_t_widen_the_cells(spark):
    random = np.random.default_rng(3)
    rows = [(i, random.normal(size=8).tolist()) for i in range(400)] + [(999, [1e9] * 8)]
    assert search(spark, rows, first_round=1) == brute(rows)


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.integers(0, 10**6), st.integers(1, 200), st.integers(1, 7), st.integers(1, 60))
def test_candidates_hold_the_exact_best(seed, n, k, block):
    random = np.random.default_rng(seed)
    x = np.floor(256 * random.normal(size=(n, 8)) * random.choice([0.01, 1, 100], size=(n, 1)))
    q, ids = x[: min(n, 9)], np.arange(n)
    marks = vector_search.Marks(x.min(axis=0), x.max(axis=0), x[::3])
    cells, kept = marks.cells(x), vector_search.Candidates(ids[: len(q)], k)
    for i in range(0, n, block):
        kept.add(0, ids[i : i + block], *marks.bounds(q, cells[i : i + block]))
    at, found, lower, upper = kept.result()
    for j in range(len(q)):
        exact = sorted((-int(s), i) for i, s in enumerate(x @ q[j]) if i != j)[:k]
        assert {i for _, i in exact} <= set(found[at == j].tolist())
    true = np.einsum("ij,ij->i", q[at], x[found])
    assert (lower <= true).all() and (true <= upper).all()


def test_few_vectors_are_candidates():
    random = np.random.default_rng(0)
    x = np.floor(256 * random.normal(size=(4096, 64)))
    marks, kept = vector_search.Marks(x.min(axis=0), x.max(axis=0), x[::4]), vector_search.Candidates(np.arange(50), 5)
    kept.add(0, np.arange(4096), *marks.bounds(x[:50], marks.cells(x)))
    assert len(kept.result()[0]) < 0.02 * 50 * 4096


@pytest.mark.parametrize("cells", [2, 64, 256])
def test_bounds_hold(cells):
    random = np.random.default_rng(1)
    x, q = np.floor(random.normal(size=(300, 16)) * 1000), np.floor(random.normal(size=(20, 16)) * 1000)
    x[:, 3] = 7
    marks = vector_search.Marks(x.min(axis=0), x.max(axis=0), x[:50], cells)
    low, high = marks.bounds(q, marks.cells(x))
    assert (low <= q @ x.T).all() and (q @ x.T <= high).all()
