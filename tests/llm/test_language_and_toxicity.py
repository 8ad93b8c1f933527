"""The trained models: exact inference, held-out accuracy, odd rows."""

import itertools
import math
import os
import pickle
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import zstandard as zstd

from roamgrid.llm import language_id, registry, toxicity
from roamgrid.llm.rows import fitted
from tests.llm.samples import DOCUMENTS, ODD, no_documents, odd_documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def language_model(docs):
    return language_id.fit(docs)


def enumerated(x, a):
    """Label probabilities by going through all labellings."""
    n, k = x.shape
    p = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = a[:, labels[0]].sum() / k
        for t, y in enumerate(labels):
            w *= x[t, y] * (a[labels[t - 1], y] if t else 1)
        for t, y in enumerate(labels):
            p[t, y] += w
    return p / p.sum(axis=1, keepdims=True)


def test_forward_backward_is_exact():
    random = np.random.default_rng(0)
    a = np.exp(random.normal(size=(3, 3)))
    lengths = np.array([5, 0, 1, 7])
    x = np.exp(3 * random.normal(size=(13, 3)))
    want = np.concatenate([enumerated(x[i:j], a) for i, j in ((0, 5), (5, 6), (6, 13))])
    assert np.allclose(language_id._marginals(x, lengths, a), want)


def test_segments_join_exactly(monkeypatch):
    random = np.random.default_rng(1)
    a = np.exp(2 * random.normal(size=(4, 4)))
    lengths = np.array([500, 3, 0, 64, 65, 128])
    x = np.exp(3 * random.normal(size=(lengths.sum(), 4)))
    whole = {}
    for size in (7, 64, 1000):
        monkeypatch.setattr(language_id, "SEGMENT", size)
        whole[size] = language_id._marginals(x, lengths, a)
    assert np.allclose(whole[7], whole[1000]) and np.allclose(whole[64], whole[1000])


def test_gradient_counts_transitions():
    random = np.random.default_rng(2)
    e, t = random.normal(size=(2, 4, 3)), random.normal(size=(3, 3))
    p, pairs = language_id._expected(e, t)
    assert np.allclose(p[0], enumerated(np.exp(e[0]), np.exp(t)))
    assert np.isclose(pairs.sum(), 2 * 3)


def test_held_out_languages(spark, docs):
    got = registry.op10_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97


def test_switching_texts_are_labelled_word_by_word(spark, docs, language_model):
    texts = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND n_chars BETWEEN 400 AND 2000").collect()}
    for a, b in (("en", "fr"), ("de", "es")):
        first, second = (" ".join(language_id.find_words(texts[x])[:40]) for x in (a, b))
        labels = [y for _, y in language_model.label_words(f"{first} {second}")]
        assert labels[:40].count(a) >= 34 and labels[40:].count(b) >= 34
    df = spark.createDataFrame([(1, "", None, None, None), (2, texts["en"], None, None, None)], DOCUMENTS)
    words = {r.doc_id: r.words for r in language_id.label_words(df, language_model).collect()}
    assert words[1] == [] and len(words[2]) == len(language_id.find_words(texts["en"]))


def test_language_of_odd_rows(spark, language_model):
    got = language_id.predict(odd_documents(spark), language_model).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in ODD)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4, 9)} == {i: ("und", 0.0) for i in (2, 3, 4, 9)}
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (1, 7, 10, 11))
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert language_id.predict(no_documents(spark), language_model).count() == 0
    kept = language_id.keep_determined(odd_documents(spark), language_model, 0.0)
    assert kept.columns == odd_documents(spark).columns
    assert {2, 3, 4, 9}.isdisjoint(r.doc_id for r in kept.collect())


def test_the_stage_keeps_mixed_texts_and_drops_noise(spark, docs, language_model):
    """Four languages in like shares: no label has 0.4 of the words, but every word's label is sure."""
    texts = {r.lang: r.text for r in docs.where("lang IS NOT NULL AND n_chars BETWEEN 400 AND 2000").collect()}
    mixed = " ".join(" ".join(language_id.find_words(texts[x])[:40]) for x in ("de", "en", "es", "fr"))
    random = np.random.default_rng(3)
    noise = " ".join("".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(2, 10))) for _ in range(300))
    assert max(language_model.predict([mixed, noise])[1]) < language_id.LEAST_SCORE
    df = spark.createDataFrame([(1, mixed, None, None, None), (2, noise, None, None, None), (3, "漢字 " * 50, None, None, None)], DOCUMENTS)
    assert [r.doc_id for r in language_id.keep_determined(df, language_model).collect()] == [1]


def test_language_does_not_depend_on_the_batch(docs, language_model):
    texts = [r.text for r in docs.limit(60).collect()]
    fresh = pickle.loads(pickle.dumps(language_model))
    langs, scores = fresh.predict(texts)
    one = [fresh.predict([t]) for t in reversed(texts)][::-1]
    assert langs == [x[0][0] for x in one] and np.allclose(scores, [x[1][0] for x in one])


def test_language_without_training_rows(spark):
    model = language_id.fit(no_documents(spark))
    assert language_id.predict(odd_documents(spark), model).count() == len(ODD)
    many = spark.createDataFrame([(1, f"word{i}", "en", None, None) for i in range(50)] + [(2, "mot", "fr", None, None)], DOCUMENTS)
    assert language_id.fit(many, rows=10).labels is not None


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = registry.op9_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    toxic, ordinary = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    auc = np.mean([(x > y) + 0.5 * (x == y) for x in toxic for y in ordinary])
    assert auc >= 0.93
    assert np.mean(np.array(toxic) >= 0.3) >= 0.7 and np.mean(np.array(ordinary) >= 0.3) <= 0.04
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_windows_are_the_whole_text():
    for text in (b"", b"a", b"word " * 500, b"x" * 1000, "é漢 ".encode() * 99, b"One, two! (three)", b"a" * 64 + b" " + b"b" * 65):
        plain = re.sub(rb"[\x20\x09-\x0D.,;:!?|*#$%&\"'()\[\]{}<>=+~^_/\\]+", b"", text).lower()
        assert b"".join(toxicity.windows(text)) == plain
        assert all(len(w) <= toxicity.WINDOW_BYTES for w in toxicity.windows(text))


def test_scores_equal_a_plain_recount(toxicity_model):
    """Every window of whole texts compressed again by two compressors made from the model's dictionaries."""
    level = zstd.ZstdCompressionParameters.from_level(9, write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3, strategy=zstd.STRATEGY_LAZY2, window_log=20, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    size = lambda d, w: len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d + toxicity.TAIL, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=level).compress(b"  " + w + b"  " + toxicity.TAIL))
    texts = ["w1y w2z Dreadful, w4y; ghastly " * 30, "w1y", "", "x" * 300 + " dreadful"]
    want = []
    for text in texts:
        of_folds = []
        for toxic, threshold, mean, scale, weights in toxicity_model.folds:
            gains = [size(toxicity_model.ordinary, w) - size(toxic, w) for w in toxicity.windows(text.encode())]
            over = sum(max(g - threshold, 0) for g in gains)
            top = sorted(gains, reverse=True)[:3] or [-8.0]
            x = [top[0], sum(top) / len(top), math.log1p(100 * over / max(1, len(gains))), math.log1p(over)]
            z = sum(w * (v - m) / s for w, v, m, s in zip(weights, x, mean, scale)) + weights[-1]
            of_folds.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        want.append(sum(of_folds) / len(of_folds))
    assert np.allclose(toxicity_model.scores(texts), want, atol=1e-9)


def test_the_dictionaries_are_apart(toxicity_model):
    ordinary = toxicity_model.ordinary
    assert b"dreadful" not in ordinary and b"w1y" in ordinary
    assert all(b"dreadful" in f[0] and b"ghastly" in f[0] for f in toxicity_model.folds)


def test_features_are_those_of_whole_words():
    """Long words are no prefixes: what differs far behind tells, and both ways of making features agree."""
    a, b = "a" * 40 + "xyz", "a" * 40 + "uvw"
    (fa, _), (fb, _) = (language_id.word_features([w]) for w in (a, b))
    assert sorted(fa) != sorted(fb) and len(set(language_id.word_hashes([a, b]))) == 2
    for word in ("a", "ab", "straße", "x" * 24, "漢字かな"):
        assert sorted(language_id.word_features([word])[0]) == sorted(language_id._long_features(word)) if len(word) > 4 else True
    words = ["short", a, "x", b, "漢" * 3000, "end"]
    flat, counts = language_id.word_features(words)
    at = np.cumsum(counts) - counts
    for w, i, n in zip(words, at, counts):
        assert (flat[i : i + n] == language_id.word_features([w])[0]).all()


def test_no_language_learned_rejects_nothing_with_letters(spark):
    docs = spark.createDataFrame([(1, "Some words", None, None, None), (2, "12 --", None, None, None), (3, None, None, None, None)], DOCUMENTS)
    kept = language_id.keep_determined(docs, language_id.fit(docs)).collect()
    assert [r.doc_id for r in kept] == [1]


@pytest.fixture(scope="module")
def toxicity_model():
    random = np.random.default_rng(0)
    usual = [f"w{i}{'xyz'[i % 3]}" for i in range(200)]
    some = lambda extra: " ".join([*random.choice(usual, 30), *random.choice(extra, 5)])
    texts = [some(["dreadful", "ghastly"]) if i % 4 == 0 else some(usual) for i in range(200)]
    return toxicity.ToxicityModel.fit(texts, [int(i % 4 == 0) for i in range(200)])


def test_toxicity_of_plain_cases(toxicity_model):
    scores = toxicity_model.scores(["w1y w2z dreadful w4y ghastly w5z dreadful w7y", "w1y w2z w4y w5z w7y w8z", "", None])
    assert scores[0] > 0.6 and (scores[1:] < 0.3).all() and scores[2] == scores[3]


def test_toxicity_of_odd_rows(spark, toxicity_model):
    got = toxicity.score(odd_documents(spark), toxicity_model).collect()
    assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i, _ in ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_documents(spark), toxicity_model).count() == 0
    left = toxicity.drop_toxic(odd_documents(spark), toxicity_model)
    assert left.columns == odd_documents(spark).columns and left.count() == sum(r.predicted == 0 for r in got)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd_documents(spark), labels)
    assert {r.score for r in toxicity.score(odd_documents(spark), model).collect()} == {0.0}


def test_fit_holds_numbers_not_words():
    """A word of the training texts costs the driver its number, not a string."""
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}wort" for k in range(2000)) for i in range(400)]
    tracemalloc.start()
    language_id.LanguageModel.fit(texts, ["de", "en"] * 200, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * 2000 * len(texts)


def test_samples_do_not_come_to_the_driver(spark):
    """The task that fits has the texts; the driver gets what it returns."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(5)
    driver = os.getpid()
    assert fitted(docs, lambda rows: (len(rows), sorted(r["doc_id"] for r in rows)[-1], os.getpid() != driver)) == (50, 49, True)
    assert fitted(docs.limit(0), len) == 0
