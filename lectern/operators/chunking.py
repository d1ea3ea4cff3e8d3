"""Lines, headings, chunks, keywords and titles.

Columns that an operator adds replace the caller's columns of the same names; those that it only
needs in between can't clash with any.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.html import html_to_markdown
from lectern.functions.markdown import BUDGET, chunked, cuts
from lectern.functions.text import STOPWORDS, deepest, file_stem, split_lines, strip, token_count
from lectern.functions.tokens import NO_KEYWORD, Tokens, parts

LEVELS = range(1, 7)
_OWN = "__lectern_"


def lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no from 1, line)."""
    return docs.select(id, F.posexplode(split_lines(F.col(text))).alias("at", "line")).select(id, (F.col("at") + 1).alias("line_no"), "line")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading, 0 for any other line."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})(?U)[\s\x1c-\x1f].", 1)).cast("int")


def heading_title(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^#{1,6}", ""))


def with_headings(lines: DataFrame, id: str, order: str = "line_no") -> DataFrame:
    """``lines`` with level, h1..h6 in force at each line, and full_headings.

    A heading of level k holds until the next of level k or less: it is in force where the last
    heading of level k or less is of level k.  All levels share one sort.
    """
    g = lambda k: f"{_OWN}g{k}"
    w = Window.partitionBy(id).orderBy(order)
    out = lines.withColumn("level", heading_level(F.col("line")))
    head = F.struct(F.col("level").alias("level"), heading_title(F.col("line")).alias("title"))
    out = out.select("*", *(F.last(F.when((F.col("level") > 0) & (F.col("level") <= k), head), ignorenulls=True).over(w).alias(g(k)) for k in LEVELS))
    out = out.withColumns({f"h{k}": F.when(F.col(f"{g(k)}.level") == k, F.col(f"{g(k)}.title")) for k in LEVELS})
    return out.drop(*map(g, LEVELS)).withColumn("full_headings", _joined([F.col(f"h{k}") for k in LEVELS]))


def _joined(titles: list[Column]) -> Column:
    return F.concat_ws("; ", *(F.nullif(t, F.lit("")) for t in titles))


def numbered(headings: DataFrame, id: str, order: str = "line_no", level: str = "level") -> DataFrame:
    """Heading rows with ``numbering``: counters by level, zero below a new heading, zeros left out."""
    g, n = (lambda k: f"{_OWN}g{k}"), (lambda k: f"{_OWN}n{k}")
    w = Window.partitionBy(id).orderBy(order)
    out = headings.select("*", *(F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(w).alias(g(k)) for k in LEVELS))
    for k in LEVELS:
        group = Window.partitionBy(id, g(k)).orderBy(order)
        out = out.withColumn(n(k), F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(group))
    of = [F.when(F.col(level) >= k, F.when(F.col(n(k)) > 0, F.col(n(k)).cast("string"))) for k in LEVELS]
    return out.withColumn("numbering", F.array_join(F.array(*of), ".")).drop(*(f(k) for f in (g, n) for k in LEVELS))


def packed(blocks: DataFrame, keys: list[str], order: str, budget: int = BUDGET, tokens: str = "n_tokens") -> DataFrame:
    """(keys, chunk_no, approx_tokens, n_blocks): greedy chunks of blocks that are never split.

    A chunk is closed before the block that would take it over ``budget``, if it has any block.
    Sizes alone are gathered, a row per group, and cut in time linear in the blocks.
    """
    sizes = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("int").alias("t")))).alias("b"))
    chunks = sizes.select(*keys, F.posexplode(cuts(F.transform("b", lambda x: x["t"]), budget)).alias("at", "c"))
    return chunks.select(*keys, (F.col("at") + 1).alias("chunk_no"), F.col("c.tokens").alias("approx_tokens"), F.col("c.blocks").alias("n_blocks"))


def sized_lines(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    return lines(docs, id).withColumn("n_tokens", token_count(F.col("line")))


def frequent(text: Column, n: int = 5) -> Column:
    """The ``n`` most frequent content tokens of a text, ties by first place; none for null."""

    def best(texts: pa.Array) -> pa.Array:
        out = [Tokens(part, NO_KEYWORD).content(STOPWORDS).best(n) for _, part in parts(texts)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return F.arrow_udf(best, "array<string>")(F.lower(text))


def top_keywords(docs: DataFrame, n: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, keywords): the ``n`` most frequent tokens; documents without any are left out."""
    return docs.select(id, frequent(F.col(text), n).alias("keywords")).where(F.size("keywords") > 0)


def chunk(docs: DataFrame, budget: int = BUDGET, compat: bool = True, drop_empty: bool = False, source: str = "source_file", text: str = "text") -> DataFrame:
    """(chunk_id, text, headings, heading, full_headings, keywords, approx_tokens): the chunks of Markdown texts.

    A chunk's id is the stem of its text's ``source`` and its number there.  A section of blank
    lines alone gives an empty chunk unless ``drop_empty``.  ``compat`` keeps a paragraph in front
    of an image description twice if blank lines part it from the next.  A null or empty text has
    no chunks; rows of one source are numbered each by itself.  Everything happens within the row.
    """
    c = docs.select(F.col(source).cast("string").alias("source"), F.posexplode(chunked(F.col(text), budget, compat, not drop_empty)).alias("at", "c"))
    titles = [F.get("c.titles", F.lit(k - 1)) for k in LEVELS]
    deeper = lambda k: F.coalesce(*titles[k:], F.lit(None)).isNull()
    return c.select(
        F.concat(file_stem(F.col("source")), F.lit("-"), F.col("at") + 1).alias("chunk_id"),
        F.col("c.text").alias("text"),
        F.struct(*(t.alias(f"h{k}") for k, t in zip(LEVELS, titles))).alias("headings"),
        F.struct(*(F.when(deeper(k), t).alias(f"h{k}") for k, t in zip(LEVELS, titles))).alias("heading"),
        _joined(titles).alias("full_headings"),
        frequent(F.col("c.text")).alias("keywords"),
        F.col("c.tokens").alias("approx_tokens"),
    )


def pages_to_chunks(pages: DataFrame, budget: int = BUDGET, source: str = "url", html: str = "html") -> DataFrame:
    """The chunks of HTML pages: ``chunk`` of their Markdown."""
    return chunk(pages.select(F.col(source).alias("source_file"), html_to_markdown(F.col(html)).alias("text")), budget)


def add_title(chunks: DataFrame, headings: list[str], text: str = "text") -> DataFrame:
    """Texts led by their deepest heading and a blank line, if they have one."""
    title = deepest([F.col(h) for h in headings])
    return chunks.withColumn(text, F.when(title.isNull(), F.col(text)).otherwise(F.concat(title, F.lit("\n\n"), F.col(text))))


def table_text(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """(keys, text): a table's rows as 'name: value' lists, empty values left out, under a TABLE: line."""
    row = F.concat_ws("; ", *(F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns))
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("row")))).alias("parts"))
    return parts.select(*keys, F.concat(F.lit("TABLE:\n"), F.array_join(F.transform("parts", lambda x: x["row"]), "\n")).alias("text"))
