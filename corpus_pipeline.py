"""A corpus pipeline of five stages: quality rules, language ID, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import jaccard_join, language_id, line_dedup, packing, quality_rules
from tessella.llm.cluster import written
from tessella.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality_rules.repetition_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang stays as it was labelled."""
    models = language_id.learn(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select(*COLUMNS), models).where("not rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; n_chars follows the text. A document that loses all goes."""
    clean = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return clean.where(F.trim("text") != "").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (five words, similarity 0.8)."""
    groups = jaccard_join.similar(docs, k=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(groups, "doc_id", "left_anti").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, tokenizer(), 1024, 2)


STAGES = [("quality rules", quality), ("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", sequences)]

#: SQL can express neither the language models nor the packing; tests/llm/test_pipeline.py holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
