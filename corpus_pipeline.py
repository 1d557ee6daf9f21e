"""A training corpus from raw documents: language ID, near-dedup, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; all but the last return the
columns of documents. The last returns those that the mix takes and `times`, how often it takes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, langid, mixing, neardup
from tessera.llm._store import read_table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without a letter, or between two languages, go."""
    return langid.identified(docs, langid.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id."""
    return neardup.deduplicated(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.remove(docs, read_table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix and how often it takes them."""
    return mixing.mixed(docs)


STAGES = [("language_id", known_language), ("near_dedup", one_of_each), ("decontaminate", clean_of_benchmark), ("mix", mixed_sources)]

#: Stages 1 to 3 can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
