"""The corpus pipeline: five stages over documents, each one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
to the shared folder and read again as the next stage's docs. All stages but the last
return the columns of documents; the last adds ``mix_epoch`` and ``mix_key`` and has a
row for each time that a document is taken. What each stage does with nulls, empty and
repeated rows, ties, long texts, empty tables and further columns is said by its operator.

The stages can't all be expressed in SQL (alignment, connected groups), so there is no
oracle; the tests compare ``run`` with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftmill.llm import decontam, linededup, mixing, quality, setjoin
from siftmill.llm.common import fresh, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.accept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document, or an earlier place, has go; so do documents that are empty then."""
    return linededup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the lowest doc_id stays."""
    return setjoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, some repeatedly, so that their tokens meet the target weights."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)  # what a stage wrote goes when the next one has written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
