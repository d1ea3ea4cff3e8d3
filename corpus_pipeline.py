"""From raw documents to packed training windows, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import written
from lectern.llm.exact import exact_dedup
from lectern.llm.near import near_dedup
from lectern.llm.packing import pack
from lectern.llm.pii import without_private
from lectern.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic; null texts stay, equal texts fare alike, and so do very long ones."""
    return without_toxic(docs, _labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts; labelled documents are the history and win.

    Null texts all stay; empty ones are equal to each other.  Of equal rows one stays.
    """
    return exact_dedup(docs, _labels(spark, sf_dir))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies, that of the least id, null ids last; null texts all stay."""
    return near_dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; null and empty texts stay as they are, and so do repeats."""
    return without_private(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows, in which sources have shares by the square roots of their tokens.

    Null and empty texts are their end id alone; a null source is a source; no documents, no windows.
    """
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("PII", private),
    ("packing", packing),
]

#: Trees, groups of near copies and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, which may have columns of any names besides; each is written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
