"""Nearest neighbours, an approximate index, BM25 with postings, reranking, and prompts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import token_count
from lectern.functions.tokens import NO_TERM, Tokens, parts
from lectern.functions.vectors import distances, matrix, unit
from lectern.providers import Overlap, Scorer

K1, B = 1.2, 0.75
#: Hash buckets of terms by which postings are laid out.
BUCKETS = 64
#: Terms, counted with repeats, whose postings one task sorts and writes.
TERMS = 2_000_000
#: NO_TERM with each sign spelled out: Java looks signs of Latin-1 up in a table, but tries one range after the other, which takes six times as long.
_SPELLED = "[^" + "".join(c for c in map(chr, range(256)) if not re.match(NO_TERM, c)) + "]+"


def nearest(vectors: DataFrame, query: Sequence[float], k: int, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, distance): the ``k`` rows nearest to ``query`` by cosine distance, ties by id; exact.

    One pass in batches, each a matrix product; a task keeps its best ``k``.  Order is by the exact
    distance, which is rounded to 6 digits in the output.  Null vectors, and those of another
    length or with values that aren't finite, are not compared; without a query there are no rows.
    """
    return _nearest(vectors, query, k, id, embedding).select(id, F.round("d", 6).alias("distance"))


def ranked(vectors: DataFrame, query: Sequence[float], k: int, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, distance, rank from 1): ``nearest`` with its order, which the rounded distance doesn't give again."""
    rank = F.row_number().over(Window.orderBy(F.round("d", 12), id))
    return _nearest(vectors, query, k, id, embedding).select(id, F.round("d", 6).alias("distance"), rank.alias("rank"))


def _nearest(vectors: DataFrame, query: Sequence[float], k: int, id: str, embedding: str) -> DataFrame:
    """(id, d): ``nearest`` in order, with the exact distance."""
    q = np.array([query], np.float64)
    kept = vectors.select(id, embedding)
    if not q.size:
        return kept.select(id, F.lit(0.0).alias("d")).limit(0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, good = distances(batch.column(1), q)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array(d[good, 0])], ["id", "d"])

    found = kept.mapInArrow(score, f"id {kept.schema[id].dataType.simpleString()}, d double")
    # distances that agree to 12 digits differ by rounding alone: they are ties
    return found.orderBy(F.round("d", 12), "id").limit(k).select(F.col("id").alias(id), "d")


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", embedding: str = "embedding", most: int = 100_000) -> DataFrame:
    """(query, id, distance, rnk): for each row of ``queries`` its ``k`` nearest among ``vectors``; exact.

    Queries are collected in one block after the other of at most ``most`` rows, a stated set, and
    scored against each batch by a matrix product; a batch gives on its best ``k`` for each query.
    """
    rows = queries.select(F.col(id).alias("q"), F.col(embedding).alias("e")).where("e IS NOT NULL").orderBy("q")
    total, blocks = rows.count(), []
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy("q"))) if total > most else rows.withColumn("n", F.lit(1))
    for at in range(0, total, most):
        block = numbered.where((F.col("n") > at) & (F.col("n") <= at + most)).select("q", "e").toArrow()
        width = int(pc.max(pc.list_value_length(block["e"])).as_py() or 0)
        q, good = matrix(block["e"].combine_chunks(), width)
        names = block["q"].combine_chunks().filter(pa.array(good))
        blocks.append(_best_each(vectors.select(id, embedding), names, q[good], k, rows.schema["q"].dataType.simpleString()))
    if not blocks:
        none = vectors.select(F.col(id).alias("query"), F.col(id), F.lit(0.0).alias("distance"), F.lit(1).alias("rnk"))
        return none.limit(0)
    found = blocks[0]
    for b in blocks[1:]:
        found = found.unionByName(b)
    w = Window.partitionBy("query").orderBy(F.round("d", 12), "id")
    best = found.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
    return best.select("query", F.col("id").alias(id), F.round("d", 6).alias("distance"), "rnk")


def _best_each(vectors: DataFrame, names: pa.Array, q: np.ndarray, k: int, kind: str) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, good = distances(batch.column(1), q)
            d, ids = np.round(d[good], 12), batch.column(0).filter(pa.array(good))
            if not len(d):
                continue
            order = np.lexsort((np.broadcast_to(np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")), d.T.shape), d.T), axis=1)[:, :k]
            many = order.shape[1]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.repeat(np.arange(len(q)), many))), ids.take(pa.array(order.ravel())), pa.array(np.take_along_axis(d.T, order, axis=1).ravel())],
                ["query", "id", "d"],
            )

    return vectors.mapInArrow(score, f"query {kind}, id {vectors.schema[0].dataType.simpleString()}, d double")


def planes(width: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables * bits, width))


#: Bits of a bucket, tables, and doubtful bits tried both ways.  On unit vectors with no structure at
#: all, the hardest case, these find over nine of the ten nearest while comparing about half of the rows.
BITS, TABLES, FLIPS = 10, 40, 4


def signatures(vectors: DataFrame, width: int, bits: int = BITS, tables: int = TABLES, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, bucket): an approximate index by random hyperplanes, a row for each vector and table.

    Every vector of that width is indexed; nothing is fitted.  Write it clustered by ``bucket``, so
    that a question reads few of its files.
    """
    p = planes(width, bits, tables).T

    def sign(vectors: pa.Array) -> pa.Array:
        m, good = matrix(vectors, width)
        code = ((m @ p > 0).reshape(len(m), tables, bits) << np.arange(bits)).sum(axis=2) + (np.arange(tables) << bits)
        bounds = np.concatenate([[0], np.cumsum(np.where(good, tables, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(code[good].ravel().astype(np.int32)))

    return vectors.select(id, F.explode(F.arrow_udf(sign, "array<int>")(embedding)).alias("bucket"))


def approximate(vectors: DataFrame, index: DataFrame, query: Sequence[float], k: int, bits: int = BITS, tables: int = TABLES, flips: int = FLIPS, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``nearest`` among the vectors that share a bucket of ``signatures`` with the query, also with its ``flips`` least sure bits turned."""
    q = np.array(query, np.float64)
    side = (planes(len(q), bits, tables) @ unit(q[None])[0]).reshape(tables, bits)
    buckets = set()
    for t in range(tables):
        code = int(((side[t] > 0) << np.arange(bits)).sum())
        doubtful = np.argsort(np.abs(side[t]))[:flips]
        for pick in range(1 << len(doubtful)):
            flip = sum(1 << int(doubtful[j]) for j in range(len(doubtful)) if pick >> j & 1)
            buckets.add((t << bits) + (code ^ flip))
    near = index.where(F.col("bucket").isin(sorted(buckets))).select(id).distinct()
    return nearest(vectors.join(near, id, "left_semi"), query, k, id, embedding)


def re_terms(question: str) -> list[str]:
    """A question's terms as texts are cut into them."""
    return [t for t in re.split(NO_TERM, question.lower()) if t]


def term_counts(docs: DataFrame, query: list[str]) -> DataFrame:
    """(doc_id, dl, tf0, tf1, ...): each text's number of terms, and how often it has each of the query's; null counts as empty.

    Built-in functions on one row at a time: no batch of texts is held, in Python or elsewhere.
    """
    # generated, so that each text is split once: an expression would be repeated for every use of it
    cut = docs.select("doc_id", F.explode(F.array(F.split(F.lower(F.coalesce("text", F.lit(""))), _SPELLED))).alias("terms"))
    terms = F.col("terms")
    # what parts terms is matched at its longest, so only the first and the last can be empty
    dl = F.size(terms) - (terms[0] == "").cast("int") - ((F.size(terms) > 1) & (F.element_at(terms, -1) == "")).cast("int")
    often = [(F.size(terms) - F.size(F.array_remove(terms, t))).cast("long").alias(f"tf{i}") for i, t in enumerate(query)]
    return cut.select("doc_id", dl.cast("long").alias("dl"), *often)


def _term_counts(batches: Iterator[pa.RecordBatch], query: list[str]) -> Iterator[pa.RecordBatch]:
    """``term_counts`` of Arrow batches of lower-case texts, slice by slice; tests hold the two against each other."""
    names = ["doc_id", "dl", *(f"tf{i}" for i in range(len(query)))]
    for batch in batches:
        for at, texts in parts(batch.column("text")):
            t = Tokens(texts, NO_TERM)
            counts = [pa.array(x.astype(np.int64)) for x in (t.counts, *map(t.of, query))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *counts], names)


def bm25(docs: DataFrame, query: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score): the ``k`` best by BM25, ties by id, without an index.

    Terms are counted within each row, so nothing is shuffled but the corpus's counts, one row, and
    the tasks' best rows.  Null texts count as empty ones; without terms there are no hits.
    """
    counted = term_counts(docs, query)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    both = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(query)):
        score = score + bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("avgdl"), k1, b)
    some = " OR ".join(f"tf{i} > 0" for i in range(len(query))) or "false"
    return both.where(some).select("doc_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def bm25_term(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in parts(batch.column("text")):
            t = Tokens(texts, NO_TERM)
            row, code, count, _ = t.distinct()
            ids = batch.column("doc_id").take(pa.array(at + row))
            arrays = [t.words.take(pa.array(code)).cast(pa.string()), ids, pa.array(count.astype(np.int32)), pa.array(t.counts[row].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["term", "doc_id", "tf", "dl"])


class Postings:
    """A BM25 index as tables in ``path``: a question reads the buckets of its terms alone.

    postings (term, doc_id, tf, dl), partitioned by a hash of the term and sorted by it within
    files, so that row groups are skipped too; lengths (doc_id, dl), a row for each document.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, docs: DataFrame, buckets: int = BUCKETS, spread: int = 1) -> Postings:
        """Writes the index anew; each bucket is written by ``spread`` tasks, or as many as it has terms for, so that a term in most documents fills no single one.

        Rows of one doc_id and different texts are different documents; null texts are empty.
        """
        kind = docs.schema["doc_id"].dataType.simpleString()
        stats = term_counts(docs, []).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets"), F.sum("dl").alias("terms"))
        [total] = stats.collect()
        spread = max(spread, math.ceil((total.terms or 0) / (buckets * TERMS)))
        posted = docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(_posted, f"term string, doc_id {kind}, tf int, dl int")
        posted = posted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        salt = F.pmod(F.hash("doc_id"), F.lit(spread))
        posted.repartitionById(buckets * spread, (F.col("bucket") * spread + salt).cast("int")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        self.spark.createDataFrame([tuple(total)[:3]], "n long, avgdl double, buckets int").write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def search(self, query: list[str], k: int, k1: float = K1, b: float = B) -> DataFrame:
        """(doc_id, score) as ``bm25`` gives it."""
        [stats] = self.spark.read.parquet(f"{self.path}/stats").collect()
        terms = self.spark.createDataFrame([(t, m) for t, m in sorted({t: query.count(t) for t in query}.items())], "term string, times int")
        found = [r.b for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(stats.buckets)).alias("b")).distinct().collect()]
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(found) & F.col("term").isin(query))
        df = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(terms), "term")  # a row for each of the question's terms
        hits = hits.join(F.broadcast(df), "term")
        each = F.col("times") * bm25_term(F.col("tf"), F.col("dl"), F.col("df"), F.lit(stats.n), F.lit(stats.avgdl), k1, b)
        best = hits.groupBy("doc_id").agg(F.sum(each).alias("s")).select("doc_id", F.round("s", 6).alias("score"))
        return best.orderBy(F.desc("score"), "doc_id").limit(k)


def reranked(hits: DataFrame, question: str, scorer: Scorer | None = None, rank: str = "rank", text: str = "text") -> DataFrame:
    """All hits with ``reranker``, best first; ties keep their order, and texts stay as they are.

    ``scorer`` is given pairs in batches; by default it is the share of the question's terms that a
    text has.  A null text scores as an empty one.
    """
    model = scorer or Overlap()

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.asarray(model.score(question, [t or "" for t in texts.to_pylist()]), np.float64))

    return hits.withColumn("reranker", F.arrow_udf(score, "double")(text)).orderBy(F.desc("reranker"), rank)


def two_stage(vectors: DataFrame, query: Sequence[float], texts: DataFrame, question: str, scorer: Scorer | None = None, first: int = 500, last: int = 50, id: str = "doc_id", embedding: str = "embedding") -> DataFrame:
    """(id, text, distance, reranker, rnk): of the ``first`` nearest the best ``last`` after reranking.

    ``texts`` has (id, text).  The first stage is at most ``first`` rows, so it is broadcast and the
    texts are read once and not shuffled.
    """
    hits = texts.select(id, "text").join(F.broadcast(ranked(vectors, query, first, id, embedding)), id)
    best = reranked(hits, question, scorer).limit(last)
    return best.select(id, "text", "distance", "reranker", F.row_number().over(Window.orderBy(F.desc("reranker"), "rank")).alias("rnk"))


def prompt(hits: DataFrame, question: str, rank: str, header: str = "Context:", id: str = "doc_id") -> DataFrame:
    """(prompt, n_tokens): the hits' texts in rank order, without line ends at their ends, and the question."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n+$", "")
    part = F.concat(F.lit('[[CHUNK (ID: "'), F.col(id).cast("string"), F.lit('")\nTexte:\n'), text, F.lit("\n]]\n\n"))
    parts = hits.agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), part.alias("p")))).alias("parts"))
    whole = F.concat(F.lit(f"{header}\n"), F.array_join(F.transform("parts", lambda x: x["p"]), ""), F.lit(f"Voici les questions :\n{question}"))
    out = parts.select(whole.alias("prompt"))
    return out.select("prompt", token_count(F.col("prompt")).alias("n_tokens"))


def request_json(prompt: Column, model: str) -> Column:
    """The request that a chat service takes, as JSON."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(F.lit(model).alias("model"), F.array(message).alias("messages")))


def answer_of(reply: Column) -> Column:
    """The answer in a chat service's reply; null for none."""
    return F.get_json_object(reply, "$.choices[0].message.content")
