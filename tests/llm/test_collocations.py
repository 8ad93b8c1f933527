"""Collocations against plain counting of all phrases."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from roamgrid.llm import collocations
from tests.llm.samples import DOCUMENTS, no_documents, odd_documents


def plainly(rows, least, most):
    """The contract, with every phrase of every text in one counter."""
    counts = Counter()
    for lang, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                counts.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    n = Counter()
    for (lang, gram), f in counts.items():
        n[lang] += f * (len(gram) == 1)
    kept = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    found = []
    for (lang, gram), a in kept.items():
        held = any(100 * f >= 80 * a for (other, longer), f in kept.items() if other == lang and len(longer) > len(gram) and any(longer[i : i + len(gram)] == gram for i in range(len(longer))))
        if not held:
            cuts = [(2_000_000 * a // (counts[lang, gram[:k]] + counts[lang, gram[k:]]), k, counts[lang, gram[:k]], counts[lang, gram[k:]]) for k in range(1, len(gram))]
            score, _, left, right = min(cuts)
            found.append((lang, " ".join(gram), a, left, right, n[lang], score))
    out = []
    for lang in n:
        own = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[-1], -r[2], r[1].encode()))
        out += [(r[0], rank, *r[1:]) for rank, r in enumerate(own[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["a", "a", "b", "A", "c", "dd", "é", "É", "zz", "\x1c", "rare"] + [f"w{i}" for i in range(30)]
    ends = [" ", " ", " ", "\t", ". ", ",", "\n", " ; "]
    rows = [(rng.choice(["x", "y", None]), "".join(rng.choice(words[: rng.choice([4, 11, 41])]) + rng.choice(ends) for _ in range(rng.randrange(0, 120)))) for _ in range(150)]
    return rows + [("x", "a a a a a a a a a a")] * 5 + [("und", "one two three four five. one two three four")] * 12 + [(None, None), ("x", ""), ("x", " ,. ")]


@pytest.mark.parametrize("least, most, broadcast_words", [(5, 2000, 500_000), (12, 7, 500_000), (5, 40, 0)])
def test_random_texts(spark, texts, least, most, broadcast_words):
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, (lang, t) in enumerate(texts)], DOCUMENTS).repartition(5)
    got = rows_of(collocations.collocations(docs, least, most, broadcast_words))
    assert got == plainly(texts, least, most)
    assert len(got) > 10


def test_hot_pivots_and_small_chunks(spark, texts, monkeypatch):
    """Pivots dealt out in parts, chunks of a few words and fragments: the same rows."""
    monkeypatch.setattr(collocations, "_numbered_words", lambda c, least, unit, f=collocations._numbered_words: f(c, least, 20))
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, (lang, t) in enumerate(texts)], DOCUMENTS).repartition(5)
    for broadcast_words in (500_000, 0):
        assert rows_of(collocations.collocations(docs, 5, 2000, broadcast_words)) == plainly(texts, 5, 2000)


def test_rows_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    rows = np.array([[1, 2], [3, 4], [1, 2], [0, 0], [3, 4], [1, 2]])
    order, first, _ = collocations._grouped(rows)
    assert sorted((tuple(rows[order[i]].tolist()), n) for i, n in zip(first, np.diff([*first, 6]))) == [((0, 0), 1), ((1, 2), 3), ((3, 4), 2)]
    assert len(collocations._grouped(rows[:0])[1]) == 0


def test_odd_rows(spark):
    docs = odd_documents(spark)
    want = plainly([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 30, 2000)
    assert rows_of(collocations.collocations(docs)) == want and want
    assert rows_of(collocations.collocations(no_documents(spark))) == []


def test_mining_holds_numbers_of_32_bits():
    """Phrases and fragments of a chunk are held once, in the width that a fragment has."""
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(1, 5_000, (50_000, 7)).astype("<u4"), 1)
    n, part = np.ones(len(rows), np.int64), np.full(len(rows), -1)
    words = rng.integers(1, 5_000, 200_000).tolist()
    peaks = []
    for run in (lambda: collocations._mined(rows, n, part, 2), lambda: collocations._rewritten(words, {})):
        tracemalloc.start()
        run()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[0] < 45 and peaks[1] < 24, peaks
