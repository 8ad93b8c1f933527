"""The queries against their SQL, and the pipeline against its stages done in plain Python."""

import re

import pytest

import corpus_pipeline
from roamgrid.llm import language_id, registry, toxicity
from tests.compare import same_rows
from tests.llm.samples import no_documents, odd_documents
from tests.llm.test_near_texts import expected
from tests.llm.test_packing_and_sharding import check_packed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, name):
    same_rows(spark, registry.queries()[name], registry.oracle_sql()[name], "sf0.001")


def stage_by_stage(docs, language_model, toxicity_model_of):
    langs, scores, certain = language_model.predict_certainty([r.text for r in docs])
    docs = [r for r, lang, s, c in zip(docs, langs, scores, certain) if lang != "und" and (s >= language_id.LEAST_SCORE or c >= language_id.LEAST_CERTAINTY)]
    yield docs
    scores = toxicity_model_of(docs).scores([r.text for r in docs])
    docs = [r for r, s in zip(docs, scores) if s < toxicity.THRESHOLD]
    yield docs
    kept = {}
    for r in sorted(docs, key=lambda r: (-len(r.text), r.doc_id)):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), r)
    docs = sorted(kept.values(), key=lambda r: r.doc_id)
    yield docs
    stay = set(expected([(r.doc_id, r.text) for r in docs]))
    yield [r for r in docs if r.doc_id in stay]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    given = docs.orderBy("doc_id").collect()
    plain = stage_by_stage(given, language_id.fit(docs), lambda rows: toxicity.fit(spark.createDataFrame(rows, docs.schema), labels))
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain):
        out = stage(spark, docs, SF)
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, want)), name
        assert want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packed([(r.doc_id, r.text) for r in want], packed)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names through every stage."""
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    # texts without a letter and copies are gone, of which the one with the most code points stays
    assert sorted(r.doc_id for r in docs.collect()) == [6, 7, 10, 11]


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = no_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0, name


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
