"""The pipeline's near-duplicate stage against exact Jaccard similarity of all pairs."""

from collections import Counter

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline
from roamgrid.llm import near_texts
from roamgrid.llm.components import connected_components
from tests.llm.samples import DOCUMENTS, ODD, no_documents, odd_documents
from tests.llm.test_simhash import groups


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    """Rows of (doc_id, text) that stay."""
    sets = [(i, plain_set(t)) for i, t in rows]
    pairs = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                pairs.append((i, j))
    component = groups(pairs, [i for i, _ in rows])
    return sorted(i for i, _ in rows if component[i] == i)


def stays(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)
    return sorted(r.doc_id for r in corpus_pipeline.dissimilar(spark, df, "").collect())


def test_edited_copies_go_and_others_stay(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base))]
    for i in range(2, 60):  # copies that each differ from the first in one place, or in too many
        edited = list(base)
        for k in range(1 if i % 2 else 9):
            edited[(i * 7 + k * 31) % 300] = f"x{i}-{k}"
        rows.append((i, " ".join(edited)))
    rows += [(100, "A b c"), (101, "a  B c"), (102, "a b d")]
    want = expected(rows)
    assert stays(spark, rows) == want and 101 not in want and len(want) < len(rows)


def test_stage_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert stays(spark, rows) == expected(rows)


def test_rows_of_one_doc_id_are_told_apart(spark):
    """A text that nothing resembles stays, whatever its doc_id; null ids and repeated rows too."""
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (2, t + " "), (2, "another text that nothing else here resembles at all"), (None, t + " x"), (None, "one more of its own kind in this table"), (3, None), (4, " "), (3, None)]
    df = spark.createDataFrame([(i, x, None, None, None) for i, x in rows], DOCUMENTS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.dissimilar(spark, df, "").collect()]
    assert sorted(got, key=repr) == sorted([rows[0], rows[2], rows[4], (3, None)], key=repr)


def test_texts_that_share_a_passage_stay(spark):
    """Many texts of one passage and a few words of their own, too many of these to be similar."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"x{i}-{k}" for k in range(5 + i % 12))) for i in range(150)]
    assert stays(spark, rows) == expected(rows)


def test_large_groups_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[(i * 11) % 120] = f"x{i}"
        rows.append((i, " ".join(copy)))
    want = expected(rows)
    assert stays(spark, rows) == want and len(want) < 9


def edited_texts(many, edits, size=300):
    """Texts that each differ from one base in places of their own; most pairs are just below 0.8."""
    rows = []
    for i in range(many):
        text = [f"w{k}" for k in range(size)]
        for k in range(edits + i % 3):
            text[(i * 37 + k * 41) % size] = f"x{i}-{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_few_pairs_of_a_crowd_that_is_apart(spark, monkeypatch):
    """Texts that one base has in common but that aren't similar: none are paired, in place of nearly all."""
    monkeypatch.setattr(near_texts, "FREQUENT", 10**6)  # as in a table whose sample doesn't show the group
    rows = edited_texts(120, 9)
    assert expected(rows) == [i for i, _ in rows]
    texts = spark.createDataFrame(rows, "number long, text string")
    shared = near_texts.prefixes(texts).withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1").withColumn("root", F.col("number"))
    left = near_texts.left_pairs(shared, texts)
    assert left.count() < len(rows)
    assert stays(spark, rows) == expected(rows)


def test_no_pairs_of_a_base_with_few_words_of_their_own(spark, monkeypatch):
    """Own shingles of less than a ninth exclude nothing, so each of these met each; texts below 0.8 aren't paired."""
    monkeypatch.setattr(near_texts, "FREQUENT", 10**6)
    rows = [(i, t) for i, t in edited_texts(90, 5) if i % 3 == 0] + [(500 + i, t.replace("w", "v")) for i, t in edited_texts(75, 9)]
    assert len(rows) - 9 < len(expected(rows))
    texts = spark.createDataFrame(rows, "number long, text string")
    shared = near_texts.prefixes(texts).withColumn("many", F.count("*").over(Window.partitionBy("token"))).where("many > 1").withColumn("root", F.col("number"))
    assert near_texts.left_pairs(shared, texts).count() < len(rows)


def test_crowds_of_any_size_equal_all_pairs(spark, monkeypatch):
    rows = edited_texts(60, 4) + [(1000 + i, t.replace("w", "v")) for i, t in edited_texts(40, 3, 120)]
    for crowded in (2, 9, 1000):
        monkeypatch.setattr(near_texts, "CROWDED", crowded)
        assert stays(spark, rows) == expected(rows)


def test_few_edges_are_joined_in_one_task(spark):
    random = np.random.default_rng(5)
    pairs = [tuple(map(int, p)) for p in random.integers(-300, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1400)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    few, rounds = (sorted(map(tuple, connected_components(edges, n).collect())) for n in (10_000, 0))
    assert few == rounds and connected_components(edges.limit(0), 10_000).count() == 0
    component = groups([p for p in pairs if p[0] != p[1]], sorted({n for p in pairs for n in p}))
    assert all(component[node] == root for node, root in few)


def test_parities_never_exceed_the_difference():
    random = np.random.default_rng(3)
    for n, own, other in ((1, 0, 0), (1, 1, 1), (40, 3, 0), (300, 20, 35), (300, 0, 400), (5000, 600, 700)):
        x = random.integers(0, 2**64, n, np.uint64)
        a, b = (np.append(x, random.integers(0, 2**64, k, np.uint64)) for k in (own, other))
        apart = near_texts.least_difference(near_texts.parities(a), near_texts.parities(b))
        assert own + other >= apart and (apart + own + other) % 2 == 0 and apart > (own + other) // 2 - 1


def test_links_of_the_tree(spark):
    """Copies with another last word are linked by op6's tree alone; a text is in few of its pairs."""
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base + f" x{i}") for i in range(200)] + [(1000 + i, " ".join(f"y{i}-{k}" for k in range(40))) for i in range(20)]
    texts = spark.createDataFrame(rows, "number long, text string").repartition(3)
    pairs = [tuple(r) for r in near_texts.tree_pairs(texts).collect()]
    assert max(Counter(n for pair in pairs for n in pair).values()) <= 4
    none = near_texts.prefixes(texts).withColumn("many", F.lit(2)).where("false")
    linked = [tuple(r) for r in near_texts.links(none, texts).collect()]
    assert set(linked) <= set(pairs) and all(a < b < 1000 for a, b in linked)
    component = groups(linked, [i for i, _ in rows])
    assert max(Counter(component.values()).values()) > 100


def test_odd_rows(spark):
    assert near_texts.similar_groups(odd_documents(spark)).count() == len(ODD)
    assert near_texts.similar_groups(no_documents(spark)).count() == 0
    kept = near_texts.drop_similar(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and near_texts.drop_similar(no_documents(spark)).count() == 0
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted({1, 2, 7, 9, 10, 11})
