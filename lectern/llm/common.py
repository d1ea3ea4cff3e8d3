"""What the operators share: the shared folder, written tables, and input columns by position.

Inputs are addressed by position, never by name, once their columns have been found, so
that extra columns may carry any name, also one that an operator uses itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only a single-machine session that has none gets a temporary one; a cluster without the
    setting is an error, since a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lectern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, most: int = ARROW_BYTES) -> Iterator[None]:
    """Within it, what goes to Python goes in batches of at most about ``most`` bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut and it survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    with arrow_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str) -> int:
    """Position of the column of that very name, else of the first that differs by case alone."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return i
    raise ValueError(f"no column {name!r} among {df.columns}")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1, ...; ``restored`` undoes it."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*(f"c{i}" for i in range(len(like.columns)))).toDF(*like.columns)


def picked(df: DataFrame, **names: str) -> DataFrame:
    """The columns called ``names``, under the keywords given: picked(docs, id="doc_id", text="text")."""
    p = positional(df)
    return p.select(*(F.col(f"c{column(df, n)}").alias(k) for k, n in names.items()))


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of a text as 32 bytes; null for null."""
    return F.unhex(F.sha2(text, 256))


def same(a: Column, b: Column) -> Column:
    """Equal, null equal to null."""
    return a.eqNullSafe(b)


def one_of_each(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, in any order, with all of their columns.

    ``decisions`` has (id, digest, keep, n): one row for each document id and text digest among
    the rows of ``docs`` whose text isn't null, n of them.  Rows with null text always stay.
    Of n > 1 equal rows that are to stay, one does.
    """
    at_id, at_text = f"c{column(docs, 'doc_id')}", f"c{column(docs, 'text')}"
    p = positional(docs).withColumn("digest", fingerprint(at_text))
    drop = decisions.where(~F.col("keep")).select(F.col("id").alias("d_id"), F.col("digest").alias("d_digest"))
    on = (F.col("digest") == F.col("d_digest")) & same(F.col(at_id), F.col("d_id"))
    kept = p.join(drop, on, "left_anti")
    several = decisions.where(F.col("keep") & (F.col("n") > 1)).select(F.col("id").alias("d_id"), F.col("digest").alias("d_digest"))
    if not several.isEmpty():
        once = kept.join(several, on, "left_semi").dropDuplicates([at_id, "digest"])
        kept = kept.join(several, on, "left_anti").unionByName(once)
    return restored(kept, docs)
