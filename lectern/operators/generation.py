"""Operators that ask a generator: keywords of chunks, and answers over the parts of documents."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import parsed_list, strip
from lectern.operators.keywords import listed_keywords
from lectern.providers import Generator, Tokenizer

ASK_KEYWORDS = "List the 20 key phrases of the following text, of one to three of its own words each, without articles, as a JSON array of strings: "
ASK_PART = "{question}\nAnswer in full detail from the following text alone, without a summary:\n{text}"
ASK_WHOLE = "{question}\nAnswer in full detail from the following text alone:\n{text}"


def generated(prompt: Column | str, generator: Generator) -> Column:
    """The generator's answer to each prompt, by batches; a null prompt isn't asked and has a null answer."""

    def ask(prompts: pa.Array) -> pa.Array:
        texts = prompts.to_pylist()
        said = iter(generator.generate([t for t in texts if t is not None]))
        return pa.array([None if t is None else next(said) for t in texts], pa.string())

    return F.arrow_udf(ask, "string")(prompt)


def structured_list(prompt: Column | str, generator: Generator) -> Column:
    """The list of strings that a generator answers with; null if its answer holds none."""
    return parsed_list(generated(prompt, generator))


def token_count_by(text: Column | str, tokenizer: Tokenizer) -> Column:
    """Tokens of each text by a provider, in batches; 0 for null."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array(tokenizer.count([t or "" for t in texts.to_pylist()]), pa.int32())

    return F.arrow_udf(count, "int")(text)


def llm_keywords(chunks: DataFrame, generator: Generator, id: str = "chunk_id", most: int = 20) -> DataFrame:
    """(id, keywords): keywords that a generator lists; none for a blank text, which isn't asked about, or for a reply without a list."""
    prompt = F.when(strip(F.coalesce("text", F.lit(""))) != "", F.concat(F.lit(ASK_KEYWORDS), F.col("text")))
    replies = chunks.select(id, generated(prompt, generator).alias("reply"))
    return replies.select(id, listed_keywords(F.col("reply"), most).alias("keywords"))


def answered(parts: DataFrame, question: str, generator: Generator, keys: list[str], order: str = "part") -> DataFrame:
    """(keys, answer): the question is asked of each part of a document, and then of the parts' answers in order."""
    fill = lambda template, text: F.concat(F.lit(template.partition("{text}")[0].replace("{question}", question)), F.coalesce(text, F.lit("")))
    each = parts.select(*keys, F.col(order).alias("o"), generated(fill(ASK_PART, F.col("text")), generator).alias("a"))
    joined = each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "a"))), lambda x: x["a"]), "\n").alias("t"))
    return joined.select(*keys, generated(fill(ASK_WHOLE, F.col("t")), generator).alias("answer"))


def context_size(value: str) -> int:
    """A context length in tokens as given on a command line; a whole number above zero, or ValueError."""
    if not re.fullmatch(r"[0-9]+", value) or not int(value):
        raise ValueError(f"a context length is a whole number above zero, not {value!r}")
    return int(value)


def asked(prompts: DataFrame, generator: Generator, build: Callable[[Column], Column] = lambda c: c, text: str = "text") -> DataFrame:
    """``prompts`` with answer: each file's text as the prompt."""
    return prompts.withColumn("answer", generated(build(F.col(text)), generator))
