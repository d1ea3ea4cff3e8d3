"""What only larger tables show: rows on the edge of rounding, and steps whose memory must not follow the input."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.functions import html, tokens
from lectern.operators import chunking, collection, keywords, retrieval
from lectern.plans.queries import QUERIES
from lectern.providers import Hashing


def test_projected_values_are_rounded_as_floats(spark, tmp_path):
    """0.105 as a float is just under it, and times 100 as a float it is 10.5."""
    spark.createDataFrame([(1, "The end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [0.105, -0.105, 0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    [row] = QUERIES["projector_labels"](spark, str(tmp_path)).collect()
    assert (row.vector, row.label) == ("11\t-11\t50", "the")


def test_distances_that_round_alike_keep_their_exact_order(spark):
    """Of two rows whose distances agree to 6 digits the nearer is first, though its id is larger."""
    vectors = spark.createDataFrame([(1, [1.0, 0.0005]), (2, [1.0, 0.0])], "doc_id long, embedding array<double>")
    texts = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, text string")
    found = retrieval.two_stage(vectors, [1.0, 0.0], texts, "x").select("doc_id", "distance", "rnk").orderBy("rnk").collect()
    assert [tuple(r) for r in found] == [(2, 0.0, 1), (1, 0.0, 2)]


def test_a_request_ranks_by_the_exact_distance(spark, tmp_path):
    class Near:
        name, version, width = "near", "1", 2

        def embed(self, texts):
            return np.array([[1.0, 0.0005 * t.endswith("far")] for t in texts])

    corpus = collection.Corpus(spark, str(tmp_path), Near()).reset()
    corpus.add(corpus.embeddings(spark.createDataFrame([("a.md", "is far"), ("b.md", "is near")], "source_file string, text string")))
    prompt = corpus.request("q", "m").first().prompt
    assert 0 < prompt.index("b-1") < prompt.index("a-1")


def test_an_embedder_is_given_slices_of_a_batch(spark, tmp_path):
    seen = tmp_path / "seen"

    class Sized(Hashing):
        def embed(self, texts):
            with seen.open("a") as f:
                f.write(f"{sum(map(len, texts))}\n")
            return super().embed(texts)

    docs = spark.range(0, 40, 1, 1).select("id", F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 100_000).alias("text"))
    out = sorted(collection.embed(docs, Sized(4)).select("id", "embedding").collect())
    assert max(map(int, seen.read_text().split())) <= tokens.SLICE
    assert [r.embedding for r in out] == [pytest.approx(Hashing(4).embed([f"w{i}"])[0].tolist(), abs=1e-6) for i in range(40)]


def peak(work) -> float:
    """MB that Python and numpy held at most."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(mb: int) -> pa.Array:
    """Texts of 100 KB with new words, as many MB."""
    return pa.array([" ".join(f"word{i * 10_000 + k}" for k in range(9_000)) for i in range(10 * mb)], pa.string())


def test_memory_for_phrases_does_not_follow_the_batch():
    assert peak(lambda: keywords._best(batch(1), 8, keywords.QUOTES)) > 0.6 * peak(lambda: keywords._best(batch(4), 8, keywords.QUOTES))


def test_phrases_get_their_texts_in_blocks_ended_by_bytes(spark):
    rows = [Row(text=t) for t in ("x" * 700_000, None, "y" * 700_000, "", "z" * 3_000_000, None)]
    found = [*tokens.gathered(iter(rows))]
    assert [len(some) for some in found] == [3, 2, 1] and [r for some in found for r in some] == rows and [*tokens.gathered(iter([]))] == []
    docs = spark.createDataFrame([("b", 'alpha "beta gamma"'), ("a", None), (None, "alpha"), ("b", "")], "name string, text string")
    best = keywords.key_phrases(docs, 1, 2, id="name")
    assert "ArrowEvalPython" not in best._jdf.queryExecution().executedPlan().toString()
    assert best.dtypes == [("name", "string"), ("rnk", "int"), ("phrase", "string"), ("score", "double")]
    assert sorted(map(tuple, best.collect()), key=str) == [("b", 1, "beta gamma", 3.75), ("b", 2, "alpha beta gamma", 1.5), (None, 1, "alpha", 1.0)]


def test_memory_for_terms_does_not_follow_the_batch():
    small, large = (pa.RecordBatch.from_arrays([pa.array(range(len(t))), t], ["doc_id", "text"]) for t in (batch(1), batch(4)))
    assert peak(lambda: [*retrieval._term_counts(iter([small]), ["word1"])]) > 0.6 * peak(lambda: [*retrieval._term_counts(iter([large]), ["word1"])])


def test_terms_are_counted_row_by_row_without_python(spark, tmp_path):
    texts = ["", None, "the", " the. ", "...", "İstanbul THE that É÷x trash", "the\n\nthe that\r", "a𝒳b ÀÖØ the þÿ×", "the the"]
    docs, query = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), ["the", "that", "the", "àöø"]
    low = pa.RecordBatch.from_pylist([{"doc_id": r.doc_id, "text": r.t} for r in docs.select("doc_id", F.lower("text").alias("t")).collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    want = [tuple(r.values()) for b in retrieval._term_counts(iter([low]), query) for r in b.to_pylist()]
    assert sorted(map(tuple, retrieval.term_counts(docs, query).collect())) == want
    assert "InArrow" not in retrieval.bm25(docs, query, 5)._jdf.queryExecution().executedPlan().toString()


def test_memory_for_pages_does_not_follow_the_batch():
    pages = batch(8)
    assert peak(lambda: html._each(pages, lambda page: page[:9])) < 4
    assert html._each(pa.array(["a", None, ""]), str.upper).to_pylist() == ["A", None, ""]


def test_slices_have_every_row_once_and_keep_nulls():
    texts = pa.array(["x" * 700_000, None, "y" * 700_000, "", "z" * 3_000_000, None])
    found = [(at, some.to_pylist()) for at, some in tokens.slices(texts)]
    assert [at for at, _ in found] == [0, 2, 4, 5] and [t for _, some in found for t in some] == texts.to_pylist()


def test_phrases_are_shuffled_without_a_tasks_vocabulary_to_partitions_by_size(spark):
    docs = spark.range(0, 40, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("the "), 120_000), F.lit('"alpha beta" delta')).alias("text"))
    for found, want in ((keywords.document_frequency(docs), 40), (keywords.specificity(docs), 1.25 + 2.5)):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.index("Aggregate") < plan.index("MapInArrow") and "Aggregate" not in plan[plan.index("Repartition" if "Repartition" in plan else "Exchange") :]
        assert found.rdd.getNumPartitions() == 1 + 40 * 480_000 // keywords.GATHERED
        rows = {tuple(r) for r in found.collect()}
        assert ("alpha beta", want) in rows and {p for p, _ in rows} == {"alpha", "beta", "delta", "alpha beta", "beta delta", "alpha beta delta"}


def test_headings_of_all_levels_share_one_sort(spark):
    r = random.Random(5)
    rows = [(d, n, r.choice(["# a", "## b", "### c", "###### f", "x", "#", ""]) + str(n)) for d in range(3) for n in range(60)]
    found = chunking.with_headings(spark.createDataFrame(rows, "doc_id int, line_no int, line string"), "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    want, held = [], {}
    for d, n, line in rows:
        held = {} if n == 0 else held
        if line.startswith("#") and " " in line:
            level = line.index(" ")
            held = {k: t for k, t in held.items() if k < level} | {level: line[level:].strip()}
        want.append((d, n, *(held.get(k) for k in range(1, 7)), "; ".join(held.values())))
    assert sorted(map(tuple, found.select("doc_id", "line_no", *(f"h{k}" for k in range(1, 7)), "full_headings").collect())) == want


def test_a_bucket_of_many_terms_is_written_by_several_tasks(spark, tmp_path):
    docs = spark.range(0, 300, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("x "), 10_000), F.lit("y"), F.col("id") % 7).alias("text"))
    index = retrieval.Postings(spark, f"file://{tmp_path}/index").build(docs, 1)
    assert len([*(tmp_path / "index/postings/bucket=0").glob("*.parquet")]) == 2
    assert [tuple(r) for r in index.search(["y3", "x"], 20).collect()] == [tuple(r) for r in retrieval.bm25(docs, ["y3", "x"], 20).collect()]


def test_chunks_are_made_once_and_a_collections_rows_written_once(spark, tmp_path):
    corpus = collection.Corpus(spark, f"file://{tmp_path}/corpus", buckets=4).reset()
    md = spark.createDataFrame([(f"{c}.md", f"# T\nalpha {c}") for c in "abcdefgh"], "source_file string, text string")
    made = corpus.embeddings(md)
    assert "EvalPython" not in made._jdf.queryExecution().sparkPlan().toString()
    files = lambda: {p.name for p in (tmp_path / "corpus/chunks").rglob("*.parquet")}
    assert corpus.add(made) == 8 and corpus.total() == 8
    first = files()
    assert corpus.add(made.where("chunk_id = 'a-1'")) == 1 and first < files() and corpus.total() == 9
    assert corpus.add(made.where("chunk_id = 'a-1'"), "replace") == 1 and corpus.total() == 8
    assert corpus.purge("?") == 8 and corpus.total() == 0 and not [*(tmp_path / "corpus").glob("staged*")]
