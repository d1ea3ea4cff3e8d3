"""Files: line-delimited JSON with one of four ways with malformed lines, whole texts and pages, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType, _parse_datatype_string

from lectern.functions.html import decoded

_BAD = "_corrupt_record"


def _struct(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else _parse_datatype_string(schema)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim(F.regexp_replace("value", r"(?U)\s", " ")) != "")


def skipping(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the good lines; malformed and blank lines are left out."""
    return spark.read.schema(_struct(schema)).option("mode", "DROPMALFORMED").json(path)


def failing(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of all lines that aren't blank; the first that isn't a JSON object fails the job."""
    lines = _lines(spark, path)
    checked = F.when(F.col("value").rlike(r"^\s*\{"), F.from_json("value", _struct(schema), {"mode": "FAILFAST"}))
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200))).cast(_struct(schema))
    return lines.select(F.when(F.col("value").rlike(r"^\s*\{"), checked).otherwise(bad).alias("row")).select("row.*")


def passing(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(value, row): every line in the file, with its row, or null for one that is blank or malformed."""
    row = F.from_json("value", StructType([*_struct(schema).fields, StructField(_BAD, StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    read = spark.read.text(path).select("value", row.alias("r"))
    good = F.struct(*(F.col(f"r.`{f.name}`").alias(f.name) for f in _struct(schema).fields))
    return read.select("value", F.when(F.col(f"r.{_BAD}").isNull() & F.col("r").isNotNull() & F.col("value").rlike(r"^\s*\{"), good).alias("row"))


def passed_on(lines: DataFrame, change: Column | None = None) -> DataFrame:
    """(value): what ``passing`` read, as lines again: rows as JSON, by ``change`` if given, and other lines as they were."""
    row = F.col("row") if change is None else change
    return lines.select(F.when(F.col("row").isNull(), F.col("value")).otherwise(F.to_json(row)).alias("value"))


def counting(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the rows of the good lines, and one row of processed and errors over the lines that aren't blank."""
    lines = passing(spark, path, schema).where(F.trim("value") != "")
    counts = lines.agg(F.count_if(F.col("row").isNotNull()).alias("processed"), F.count_if(F.col("row").isNull()).alias("errors"))
    return lines.where(F.col("row").isNotNull()).select("row.*"), counts


def exit_code(counts: DataFrame) -> int:
    """1 if nothing was processed, else 0: a few malformed lines don't count."""
    return int(counts.first().processed == 0)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text): each file, of one or of a folder, as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text): each file as one row of UTF-8 text, invalid bytes dropped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), decoded("content").alias("text"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as lines of JSON; null fields are left out, and characters beyond ASCII stay as they are."""
    rows.write.mode(mode).json(path)


def write_batches(batches: list[DataFrame], path: str) -> None:
    """Empties the folder and appends one batch after the other."""
    for k, rows in enumerate(batches):
        write_jsonl(rows, path, "append" if k else "overwrite")


def projector(vectors: DataFrame, word: str, embedding: str = "embedding", text: str = "text") -> DataFrame:
    """(vector, label): each vector as values between tabs, and the word if the text has it in any case, else 'autre'."""
    label = F.when(F.contains(F.lower(text), F.lit(word.lower())), F.lit(word)).otherwise(F.lit("autre"))
    return vectors.select(F.array_join(F.transform(embedding, lambda x: x.cast("string")), "\t").alias("vector"), label.alias("label"))
