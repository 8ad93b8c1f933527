"""Exact deduplication against grouping in plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from roamgrid.llm import exact_dedup, rows as places
from roamgrid.llm.exact_dedup import ExactDedup
from tests.llm.samples import DOCUMENTS, ODD, no_documents, odd_documents


def expected(rows):
    """(doc_id, keep_id, group_size, sha256) of each row and how many rows stay."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))[0]
        out += [(i, keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=repr), len(groups)


def check(rows, df):
    got = df.collect()
    want, stay = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == stay and all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows_that_are_no_scan(spark):
    check(ODD, exact_dedup.exact_duplicates(odd_documents(spark)))
    check([], exact_dedup.exact_duplicates(no_documents(spark)))


def test_scans_unions_and_joins(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert places.is_scan(docs) and places.is_scan(docs.where("doc_id > 1").select("doc_id", "text"))
    twice = docs.join(spark.range(2).withColumnRenamed("id", "other"))
    assert not places.is_scan(docs.union(docs)) and not places.is_scan(twice)
    check(ODD, exact_dedup.exact_duplicates(docs))
    check(ODD * 2, exact_dedup.exact_duplicates(docs.union(docs)))
    check(ODD * 2, exact_dedup.exact_duplicates(twice))


def test_rows_that_stay_keep_their_columns(spark, tmp_path):
    odd = odd_documents(spark)
    odd.write.parquet(f"{tmp_path}/d")
    for docs in (odd, spark.read.parquet(f"{tmp_path}/d")):
        left = exact_dedup.drop_exact_duplicates(docs)
        assert left.columns == docs.columns
        assert len(left.collect()) == expected(ODD)[1]


def test_texts_of_one_digest_are_told_apart(spark):
    rows = [(i, f"{i % 40} text") for i in range(120)] + [(900, None), (901, " ")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    short = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    check(rows, ExactDedup(spark, digest=short).run(docs))
    one = lambda c: F.lit(b"x")
    check(rows, ExactDedup(spark, digest=one).run(docs))


def test_later_runs_meet_the_state_of_earlier_ones(spark):
    make = lambda rows: spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    first = ExactDedup(spark)
    assert [(r.kept, r.group_size) for r in first.run(make([(1, "a b"), (9, "z")])).orderBy("doc_id").collect()] == [(True, 1), (True, 1)]
    again = ExactDedup(spark, first.folder)
    got = {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in again.run(make([(2, "ab"), (3, "z  "), (4, "new")])).collect()}
    assert got == {2: (1, False, 2), 3: (3, True, 2), 4: (4, True, 1)}
    again.forget()


def test_contents_are_compared_across_runs(spark, tmp_path):
    """A digest without any use still keeps different texts apart, whichever runs they come in."""
    make = lambda rows: spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    make([(5, "a  c"), (6, "ad")]).write.parquet(f"{tmp_path}/with space")
    dedup = ExactDedup(spark, digest=lambda c: F.lit(b"x"))
    for docs, want in (
        (make([(1, "ab")]), {1: (1, True, 1)}),
        (make([(2, "ac"), (3, "a b ")]), {2: (2, True, 1), 3: (3, True, 2)}),
        (make([(4, "ab")]), {4: (3, False, 3)}),
        (spark.read.parquet(f"{tmp_path}/with space"), {5: (5, True, 2), 6: (6, True, 1)}),
        (make([(7, "ac"), (8, "ad"), (9, "ae")]), {7: (5, False, 3), 8: (6, False, 2), 9: (9, True, 1)}),
        (make([]), {}),
    ):
        assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in dedup.run(docs).collect()} == want
    dedup.forget()


def test_large_groups(spark):
    rows = [(i, "the same") for i in range(400)] + [(1000 + i, f"text {i // 2}") for i in range(60)]
    check(rows, exact_dedup.exact_duplicates(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)))


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    exact_dedup.exact_duplicates(no_documents(spark)).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
