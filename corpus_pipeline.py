"""Corpus pipeline: stages from raw documents to a weighted training mix.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns the documents that it keeps, with their columns; the last
returns the mix, one row a document.  ``docs`` may hold nulls, empty texts and
repeated rows: every stage has a defined result for them (see the operators).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohera.llm import decontaminate, mixing, ngram_join, pii, toxicity
from cohera.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go.  The examples are
    labelled rows of ``docs`` outside the held-out fold."""
    index, prior = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, index, prior)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles,
    Jaccard of at least 0.8, linked groups, the least id."""
    return ngram_join.keep_one_of_each(docs, n=5, pct=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; every row stays."""
    return pii.redact(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the weighted mix takes of every document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact),
    ("source_mix", mix),
]

#: hashing, trained models and pseudorandom permutations: not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
