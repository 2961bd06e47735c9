"""A training-corpus pipeline: five stages over the documents table, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontaminate, language_crf, line_templates, mixing, near_dup
from gridloom.llm.store import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the random field names at 0.4 or more; those without a letter go."""
    model = language_crf.fit(language_crf.training_sample(docs))
    return language_crf.keep_identified(docs, model, least=0.4)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines leave all but their first document; documents left without a word go."""
    cleaned = line_templates.drop_recurring_lines(docs)
    gone = (cleaned["n_dropped"] > 0) & cleaned["text"].rlike(r"^[\x20\x09-\x0D]*$")
    return cleaned.filter(~gone).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dup.drop_near_duplicates(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words the mix takes of them and their training positions, in training order."""
    return mixing.curriculum_mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("mixing", mix_sources),
]

#: SQL can't express the random field, the sketches and the slot check; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
