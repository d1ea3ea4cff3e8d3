"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode
from .exact import exact_duplicates
from .near import near_duplicates
from .packing import pack
from .pii import private_spans
from .quality import quality
from .spans import substring_dedup
from .spots import spot_duplicates
from .tokens import token_offsets
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's token ids are in the files, which are written to the shared folder."""
    return token_offsets(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats among the documents; those that were labelled are the history."""
    return exact_duplicates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document whose fingerprint is like another's, with its group's first."""
    return spot_duplicates(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each near copy with the document that its group keeps."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability of being toxic."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat another's."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every identifier in the documents, by character offsets."""
    return private_spans(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from heuristic labellers alone."""
    return quality(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids."""
    return encode(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows in which sources have their shares of the tokens."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_spotsigs": op3_spotsigs,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH t AS (
            SELECT d.doc_id, d.text, l.doc_id IS NOT NULL AS known
            FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
            WHERE d.text IS NOT NULL
        ), r AS (
            SELECT doc_id, first_value(doc_id) OVER w AS kept_doc_id, row_number() OVER w AS nth
            FROM t WINDOW w AS (PARTITION BY text ORDER BY known DESC, doc_id)
        )
        SELECT doc_id, kept_doc_id FROM r WHERE nth > 1
    """,
}
