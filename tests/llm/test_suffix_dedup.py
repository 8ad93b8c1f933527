"""Repeated passages against a plain search for earlier windows, and the suffix order against plain sorting."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from roamgrid.llm import induced_sort, suffix_dedup
from tests.llm.samples import DOCUMENTS, no_documents, odd_documents


def plainly(rows):
    """The contract: windows met before, in the order of texts; rows of one doc_id in the given order."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = hash(data[i : i + 100]), data[i : i + 20]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(1, k)))
    prose = lambda n: " ".join(word(9) for _ in range(n))
    passages = [prose(rng.randrange(15, 90)) for _ in range(8)]
    line = prose(11)[:60]
    rows = [(i, rng.choice(passages) if i % 9 == 0 else prose(rng.randrange(1, 30)) + rng.choice(["", " ", "\n"]) + rng.choice(passages) + prose(rng.randrange(0, 40)) + rng.choice([line, ""]) + prose(5)) for i in range(120)]
    rows += [(200, "ab" * 400), (201, "x" * 99), (202, "x" * 100), (203, "x" * 350), (204, "yx" * 51), (205, passages[0]), (205, passages[0]), (206, passages[1][3:110] + passages[2][:150])]
    return rows


@pytest.mark.parametrize("base", [4_000_000, 0])
def test_suffixes_in_order(base, monkeypatch):
    monkeypatch.setattr(induced_sort, "BASE_NAMES", base)
    rng = random.Random(1)
    for _ in range(400):
        k, n = rng.choice([1, 2, 3, 30]), rng.randrange(1, 90)
        text = [rng.randrange(1, k + 1) for _ in range(n)] * rng.choice([1, 1, 2])
        with induced_sort.Scratch(rng.choice([None, 0])) as scratch:
            got = [(p, c) for places, commons in induced_sort.order(np.array(text), 250, scratch) for p, c in zip(places.tolist(), commons.tolist())]
        want = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        common = [0] + [next((j for j, (a, b) in enumerate(zip(text[x:], text[y:])) if a != b), min(len(text) - x, len(text) - y)) for x, y in zip(want, want[1:])]
        assert got == list(zip(want, common))


def test_runs_on_disk_and_small_blocks(monkeypatch):
    """Short runs that are never merged, small blocks and chunks, everything in files; groups up to the limit."""
    for name, value in (("MOST_OF_RUN", 50), ("BLOCK", 64), ("CHUNK", 37), ("BASE_NAMES", 20)):
        monkeypatch.setattr(induced_sort, name, value)
    rng = random.Random(2)
    part = [rng.randrange(1, 5) for _ in range(400)]
    text = np.array(part + [rng.randrange(1, 5) for _ in range(1500)] + part + [2] * 300 + part)
    with induced_sort.Scratch(0) as scratch:
        blocks = list(induced_sort.order(text, 100, scratch))
    places, commons = (np.concatenate(x) for x in zip(*blocks))
    assert sorted(places.tolist()) == list(range(len(text)))
    data = bytes(text.tolist())
    for i in range(1, len(places)):
        a, b = places[i - 1], places[i]
        assert data[a : a + 100] >= data[b : b + 100]
        same = data[a : a + 100] == data[b : b + 100] and len(data) - max(a, b) >= 100
        assert (commons[i] >= 100) == same


def test_memory_for_a_byte_of_text():
    """What is needed to name substrings isn't held while the names are sorted, and places take 32 bits."""
    rng = np.random.default_rng(5)
    words = np.column_stack([rng.integers(2, 28, (3000, 6)), np.full(3000, 30)]).astype(np.uint16)
    text = words[rng.integers(0, len(words), 150_000)].ravel()
    with induced_sort.Scratch() as scratch:
        tracemalloc.start()
        for _ in induced_sort.order(text, 100, scratch):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak < 60 * len(text)


@pytest.mark.parametrize("options", [{}, {"broadcast_grams": 0}, {"most_of_gram": 3}, {"shard_bytes": 3_000}])
def test_random_texts(spark, texts, options):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCUMENTS).repartition(4)
    assert rows_of(suffix_dedup.digests(docs, **options)) == plainly(texts)


def test_spots_of_equal_windows(texts):
    """Every window has one spot, and equal windows have equal grams at the same place."""
    data = [t.encode() for _, t in texts]
    text, at, size, gram, key = suffix_dedup.spots(data)
    where = {}
    for i, a, n, g, k in zip(*(x.tolist() for x in (text, at, size, gram, key))):
        for j in range(n):
            window = data[i][a + j : a + j + 100]
            assert len(window) == 100
            assert where.setdefault(window, (g - j, k)) == (g - j, k)
    assert size.sum() == sum(max(0, len(d) - 99) for d in data)


def test_what_is_left_and_spans(spark):
    docs = spark.createDataFrame([(2, "é" * 80 + "tail", None, None, None), (1, "é" * 80, None, None, None)], DOCUMENTS)
    first, second = sorted(suffix_dedup.remove_repeats(docs).collect())
    # windows repeat inside the first text already: all but the first window's first two bytes
    assert (bytes(first.kept), first.spans) == ("é".encode(), [2, 160])
    assert (bytes(second.kept), second.spans) == (b"tail", [0, 160])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(suffix_dedup.digests(docs)) == plainly(given)
    assert rows_of(suffix_dedup.digests(no_documents(spark))) == []
