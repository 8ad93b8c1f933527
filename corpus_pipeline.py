"""A corpus pipeline of five stages over the table ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamgrid.llm import exact_dedup, language_id, near_texts, packing, toxicity
from roamgrid.plans.storage import delete_path, new_path, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose words fit no language."""
    docs = docs.select(*COLUMNS)
    return language_id.keep_determined(docs, language_id.fit(docs))


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as toxic; learns from the labels of the documents that came in."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of texts linked by 0.8 or more of their 5-word shingles:
    op6's tree over SimHash fingerprints gives links, prefixes of shingle sets those that it can't, all are verified."""
    return near_texts.drop_similar(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of the documents that are left."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("toxicity", ordinary), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("packing", packed)]

#: Trained models, a stateful stream and a search tree: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again by the next, and what a stage
    needed besides is deleted when its result stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:
            out = stage(spark, docs, sf_dir)
            path = new_path(spark, f"stage_{name}")
            kept.add(path)
            out.write.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
