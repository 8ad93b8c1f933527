"""Fill-in-the-middle against slices of lists of units."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from roamgrid.llm import fill_middle
from tests.llm.samples import DOCUMENTS, no_documents, odd_documents


def plainly(doc_id, text):
    """The contract, with all units in a list."""
    text = text or ""
    units = list(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, digest(text), digest(text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, low, high - low, digest(out), digest(text)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_random_and_marked_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab<>PSM é\n\U0001f600") for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += ["<", "<S", "S><M>", "<P", "x<S>y", "é", "\U0001f600" * 3, "\r\n\x00"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCUMENTS)
    got = rows_of(fill_middle.round_trip(docs))
    assert got == sorted((plainly(i, t) for i, t in enumerate(texts)), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    want = [plainly(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(fill_middle.round_trip(docs)) == sorted(want, key=repr)
    assert rows_of(fill_middle.round_trip(no_documents(spark))) == []


def test_other_units_and_restored_texts(spark):
    """Words as units: cuts fall behind words, and every text comes back."""
    docs = spark.createDataFrame([(i, "one  two three\nfour " * (i % 7), None, None, None) for i in range(60)], DOCUMENTS)
    rows = fill_middle.transform(docs, r"\S+").withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    for r in rows:
        text = "one  two three\nfour " * (r.doc_id % 7)
        assert r.back == text and r.n == len(text.split())
        if r.form != "plain":
            assert re.fullmatch(r"|.*\S", text[: r.prefix_chars], re.S) and re.fullmatch(r"|.*\S", text[: r.prefix_chars + r.middle_chars], re.S)


def test_no_unit_is_kept():
    """Two passes over a lazy iterator: memory stays far below one entry for each unit."""
    import tracemalloc

    text, unit = "ab\n" * 300_000, re.compile(fill_middle.CODE_POINT)
    tracemalloc.start()
    n = fill_middle.count_units(unit, text)
    assert n == len(text) and fill_middle.ends_of(unit, text, 5, n) == (5, n)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
