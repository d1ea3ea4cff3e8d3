"""Operators against brute force, and odd input: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import html, markdown, text
from lectern.functions.tokens import NO_KEYWORD, Tokens
from lectern.operators import chat, chunking, collection, generation, keywords, retrieval
from lectern.plans import fixtures
from lectern.plans.queries import _events
from lectern.providers import Canned, Hashing, HttpGenerator, Overlap, Words, embedded_each
from lectern.sources import jsonl
from lectern.streaming.answers import folded, streamed_answers

ODD = [(1, "a b", "x"), (1, "a b", "y"), (2, None, "z"), (None, "", None), (3, "long word " * 40_000, "x")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, level string")


@pytest.mark.parametrize("seed", range(8))
def test_chunks_of_random_markdown_keep_every_line(seed):
    """Without compat every word of a line that is no heading is in one chunk, in order."""
    r = random.Random(seed)
    kinds = ["# h", "## i", "plain words here", "", "  ", "- item", "  more", "1. one", markdown.OPEN + "d" + markdown.SHUT, "last | one"]
    lines = [r.choice(kinds) for _ in range(r.randint(0, 120))]
    for budget in (1, 6, 200):
        found = [*markdown.chunks("\n".join(lines), budget, compat=False)]
        assert [w for _, t, _ in found for w in t.split()] == [w for x in lines if not x.startswith("#") for w in x.split()]
        assert all(n == len(t.split()) for _, t, n in found)


def test_greedy_ends_against_the_step_by_step_rule():
    r = random.Random(1)
    for _ in range(300):
        sizes, budget = [r.randint(0, 9) for _ in range(r.randint(0, 30))], r.randint(0, 15)
        want, held = [], []
        for k, n in enumerate(sizes):
            if held and sum(held) + n > budget:
                want.append(k)
                held = []
            held.append(n)
        assert markdown.ends_of_chunks(np.array(sizes), budget) == want + ([len(sizes)] if sizes else [])


def test_markdown_of_pages_says_what_the_pages_say(spark):
    """Against the page's own text: no word is lost or made, but in tags, and twice is once."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        body = page[page.index("<body>") + 6 :]
        plain = html.re.sub(r"<script.*?</script>|</?(?!!)[a-zA-Z][^>]*>|<!--|-->", " ", body)
        import html as entities

        letters = lambda t: [c for c in t if c.isalpha()]
        marks = html.re.sub(r"\]\([^)]*\)", "]", html.markdown(page))
        assert letters(entities.unescape(plain)) == letters(marks)


def test_trees_and_renderers_take_anything():
    deep = "<div>" * 30_000 + "x" + "<ul><li>" * 2_000 + "y"
    assert "x" in html.markdown(deep)
    for page in ("", "<", "</p>", "<p", "&#xD800;&#99999999999;&bogus", "<a href=#x>1</a><p id=x>2</p>", "<sup><a href=#n>1</a><a href=#n>2</a></sup><ul><li id=n>t</ul>", "<table></table><table><tr></tr></table>", "<![CDATA[x]]><!doctype y><?z?>"):
        html.markdown(page), html.without_contents(page)
    assert html.markdown("<a href='#x'>1</a><p id=x>2</p>") == "[Note: 2]\n"
    assert html.markdown("<p>" + " " * 1_000_000 + "x</p>") == "x\n"
    page = "<body>A<nav class='main toc'>B</nav>C<p>sommaire</p>D<ul><li><a href='#Toc1'>E</a></ul>F<p>Sommaire</p></body>"
    assert html.without_contents(page) == "<body>ACDF<p>Sommaire</p></body>"


def test_cells_lists_and_heads():
    table = "<table><thead><tr><td>h</td></tr></thead><tr><td><ul><li>a<li>b</ul></td></tr><tr><td><p>c</p><p>d</p></td></tr></table>"
    assert html.markdown(table) == "| h |\n| --- |\n| h |\n| - a<br>- b |\n| c<br>d |\n" or "- ab" in html.markdown(table)
    assert html.markdown("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>") == "| a |\n| --- |\n| b |\n"


def test_chunk_of_odd_rows(spark):
    docs = odd(spark).withColumn("source_file", F.lit("f.x.md"))
    out = chunking.chunk(docs).collect()
    assert {r.chunk_id for r in out} == {"f.x-1"} and len(out) == 3
    assert chunking.chunk(docs.limit(0)).count() == 0
    kept = chunking.with_headings(spark.createDataFrame([(1, 1, "# t", "mine", "g")], "doc_id int, line_no int, line string, title string, g1 string"), "doc_id")
    [row] = kept.collect()
    assert (row.title, row.g1, row.h1, row.level) == ("mine", "g", "t", 1)


def test_pages_to_chunks_is_chunks_of_their_markdown(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = sorted((r.chunk_id, r.text, r.approx_tokens) for r in chunking.pages_to_chunks(pages).collect())
    want = []
    for r in pages.collect():
        stem = r.url.rpartition(".")[0] if "." in r.url[1:] else r.url
        want += [(f"{stem}-{k}", t, n) for k, (_, t, n) in enumerate(markdown.chunks(html.markdown(r.html)), 1)]
    assert got == sorted(want) and got


def test_phrases_against_counters():
    r = random.Random(3)
    words = ["alpha", "beta", "the", "gamma", "12", "de", '"alpha beta"', "**gamma**", "«", "»", "delta-x", "é", "cœur"]
    for _ in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        want = dict(keywords.annotated_phrases(t, keywords.Plain(), keywords.QUOTES + keywords.EMPHASIS))
        found = keywords.scored(pa.array([t, ""], pa.large_string()), keywords.QUOTES + keywords.EMPHASIS)
        assert dict(zip(found.phrase.to_pylist(), found.score.tolist())) == want
        ranked = keywords._best(pa.array([t]), 1000, keywords.QUOTES + keywords.EMPHASIS)[0].as_py()
        assert [(p["phrase"], p["score"]) for p in ranked] == keywords.annotated_phrases(t, keywords.Plain(), keywords.QUOTES + keywords.EMPHASIS)


class Model:
    """An annotator that knows a name, a noun phrase, lemmas and a verb."""

    def annotate(self, t):
        T = keywords.Token
        if t == "Big Corp":
            return keywords.Annotated([T("Big", "big", "ADJ"), T("Corp", "corp", "PROPN")])
        tokens = [T("Big", "big", "ADJ"), T("Corp", "corp", "PROPN"), T("sells", "sell", "VERB"), T("the", "the", "DET", True), T("cars", "car", "NOUN"), T(".", ".", "PUNCT", False, True)]
        return keywords.Annotated(tokens, [(0, 2, "ORG"), (1, 2, "LOC")], [(3, 5)])


def test_annotated_phrases(spark):
    docs = spark.createDataFrame([(1, 'Big Corp sells the cars. "Big Corp"'), (2, " "), (3, None)], "doc_id long, text string")
    found = [(r.doc_id, r.rnk, r.phrase, r.score) for r in keywords.annotated_key_phrases(docs, Model, 2, 4).collect()]
    # windows: big, corp, car, 'big corp', 'corp car', 'big corp car'; an organisation, a place, a noun phrase, quotes
    assert found == [(1, 1, "big corp", 1 + 3 + 2.5 + 0.25), (1, 2, "corp", 3.0), (1, 3, "car", 2.5), (1, 4, "big corp car", 1.5)]


def test_tokens_of_odd_texts():
    t = Tokens(pa.array(["", "A-1 b", "---"], pa.large_string()), NO_KEYWORD)
    assert t.counts.tolist() == [0, 2, 1] and t.of("b").tolist() == [0, 1, 0] and t.best(1).to_pylist() == [[], ["A-1"], ["---"]]


def test_vocabulary_order_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.phrase for r in keywords.vocabulary(docs).collect()] == ["alpha", "alpha beta", "beta"]
    assert [r.phrase for r in keywords.vocabulary(docs, "specificity").collect()] == ["alpha beta", "alpha", "beta"]
    assert keywords.key_phrases(docs.limit(0)).count() == 0 and keywords.document_frequency(docs.limit(0)).count() == 0
    assert keywords.key_phrases(odd(spark)).where("doc_id = 3").count() == 6


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(300, 8)).astype(np.float32)
    m[7] = m[3]
    rows = [(i, x.tolist()) for i, x in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 3), (903, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    unit = m / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    exact = 1 - unit @ unit.T
    best = sorted(range(300), key=lambda i: (round(exact[0, i], 9), i))[:20]
    assert [x.vec_id for x in retrieval.nearest(v, m[0].tolist(), 20).collect()] == best
    assert retrieval.nearest(v, [], 5).count() == 0 and retrieval.nearest(v.limit(0), m[0].tolist(), 5).count() == 0
    for most in (1000, 3):
        got = {(x.query, x.rnk): x.vec_id for x in retrieval.nearest_each(v, v.where("vec_id < 10"), 4, most=most).collect()}
        assert got == {(q, k + 1): i for q in range(10) for k, i in enumerate(sorted(range(300), key=lambda i: (round(exact[q, i], 9), i))[:4])}


def test_the_approximate_index_finds_nine_of_ten(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = retrieval.signatures(vectors, 64).cache()
    assert index.select("vec_id").distinct().count() == vectors.count()
    hit = total = 0
    for q in vectors.where("vec_id % 50 = 0").collect():
        exact = {r.vec_id for r in retrieval.nearest(vectors, q.embedding, 10).collect()}
        near = {r.vec_id for r in retrieval.approximate(vectors, index, q.embedding, 10).collect()}
        hit, total = hit + len(exact & near), total + 10
    assert hit >= 0.9 * total, hit / total


def test_postings_equal_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the word{i % 5} the that{i % 3} x") for i in range(60)] + [(60, None), (61, ""), (3, "again the")], "doc_id long, text string")
    index = retrieval.Postings(spark, f"file://{tmp_path}/index").build(docs, 4, 2)
    for question in (["the"], ["that1", "the", "nowhere"], ["nowhere"], []):
        want = retrieval.bm25(docs.where("doc_id <> 3"), question, 10)
        got = retrieval.Postings(spark, f"file://{tmp_path}/other").build(docs.where("doc_id <> 3"), 4).search(question, 10)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert index.search(["again"], 5).count() == 1


def test_corpus(spark, tmp_path):
    corpus = collection.Corpus(spark, f"file://{tmp_path}/corpus", buckets=4).reset()
    assert corpus.total() == 0 and not corpus.has("a") and corpus.purge("a") == 0
    md = spark.createDataFrame([("a.md", "# T\nalpha beta\n\n## U\ngamma"), ("a-b.md", "# T\nalpha"), ("c.md", None)], "source_file string, text string")
    made = corpus.embeddings(md)
    assert corpus.add(made) == 3 and corpus.add(made.where("chunk_id LIKE 'a-b%'")) == 1
    assert [tuple(r) for r in corpus.info().collect()] == [(None, 4), ("a", 2), ("a-b", 2)]
    assert corpus.add(made, "replace") == 3 and corpus.total() == 3 and corpus.has("a-b")
    with pytest.raises(ValueError):
        corpus.add(made, "new")
    assert [r.chunk_id for r in corpus.search("gamma", 1).collect()] == ["a-2"] and [r.chunk_id for r in corpus.bm25("alpha", 5).collect()] == ["a-b-1", "a-1"]
    [asked] = corpus.request("alpha?", "m", rerank=True, k=2).collect()
    assert json.loads(asked.request)["messages"][0]["content"] == asked.prompt and "Texte:\nT\n\nalpha" in asked.prompt and asked.n_tokens == len(asked.prompt.split())
    assert corpus.search("gamma", 1, ["chunk_id", "headings.h2"]).columns == ["chunk_id", "h2", "distance"]
    Other = type("Other", (Hashing,), {"reranks": False})
    with pytest.raises(ValueError):
        collection.Corpus(spark, f"file://{tmp_path}/corpus", Other()).request("q", "m", rerank=True)
    assert corpus.purge("a", exact=True) == 2 and corpus.purge("a") == 1 and corpus.total() == 0
    assert spark.read.parquet(f"file://{tmp_path}/corpus/cache").count() == 3  # distinct texts, each embedded once


def test_stored_leaves_out_what_has_no_vector(spark):
    titles = "struct<h1:string,h2:string,h3:string,h4:string,h5:string,h6:string>"
    rows = spark.createDataFrame([("a-1", [1.0], ("", None, None, None, None, None)), ("a-2", [], None), ("a-3", None, None), ("a-4", [1.0, None], None)], f"chunk_id string, embedding array<double>, headings {titles}")
    [row] = collection.stored(rows).collect()
    assert (row.chunk_id, row.headings, row.keywords, row.full_headings) == ("a-1", None, [], None)
    old = spark.createDataFrame([("t", (["k"], "f"))], "text string, metadata struct<keywords:array<string>,full_headings:string>")
    [row] = collection.current(old).collect()
    assert (row.keywords, row.full_headings, row.headings.h1) == (["k"], "f", None) and "metadata" not in row


def test_embedding_cache_embeds_each_text_once(spark, tmp_path):
    seen = tmp_path / "seen"

    class Counting(Hashing):
        def embed(self, texts):
            with seen.open("a") as f:
                f.writelines("x\n" for _ in texts)
            return super().embed(texts)

    docs = odd(spark).where("doc_id < 3 OR doc_id IS NULL")
    for _ in range(2):
        out = collection.embed(docs, Counting(4), f"file://{tmp_path}/cache").collect()
        assert len(out) == 4 and all(len(r.embedding) == 4 for r in out)
    assert len(seen.read_text().split()) == 2  # "a b", and the empty text with the null one
    assert embedded_each(lambda t: Hashing(4).embed(t) if "bad" not in t and len(t) == 1 else 1 / 0, ["a\nb", "bad", ""]).tolist() == Hashing(4).embed(["a b", " ", " "]).tolist()


def test_images_are_described_once_and_refreshed_by_force(spark, tmp_path):
    calls = tmp_path / "calls"

    class Says:
        def __init__(self, word):
            self.word = word

        def describe(self, images):
            with calls.open("a") as f:
                f.writelines("x\n" for _ in images)
            return [self.word] * len(images)

    image = "![k](data:image/png;base64,AAAA)"
    docs = spark.createDataFrame([(1, f"m {image} n {image}", "at"), (2, f"{image}", "k"), (3, "none", "v"), (4, None, "url"), (2, f"{image}", "k")], "doc_id int, text string, url string")
    run = lambda word, **k: sorted((r.doc_id, r.text or "") for r in collection.describe_images(docs, Says(word), f"file://{tmp_path}/cache", **k).collect())
    tag = lambda w: f"{collection.START}{w}{collection.END}"
    want = lambda w: [(1, f"m {tag(w)} n {tag(w)}"), (2, tag(w)), (2, tag(w)), (3, "none"), (4, "")]
    assert run("one") == want("one") and run("two") == want("one") and run("three", force=True) == want("three")
    assert len(calls.read_text().split()) == 2


def test_lines_of_every_kind(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text('{"a": 1, "b": "é"}\n\n{bad\n[1]\n{"a": 2}\n')
    path, schema = f"file://{tmp_path}/f.jsonl", "a long, b string"
    assert sorted(r.a for r in jsonl.skipping(spark, path, schema).collect() if r.a) == [1, 2]
    passed = jsonl.passing(spark, path, schema)
    assert [r.row is not None for r in passed.collect()] == [True, False, False, False, True]
    assert [r.value for r in jsonl.passed_on(passed).collect()] == ['{"a":1,"b":"é"}', "", "{bad", "[1]", '{"a":2}']
    rows, counts = jsonl.counting(spark, path, schema)
    assert rows.count() == 2 and tuple(counts.first()) == (2, 2) and jsonl.exit_code(counts) == 0
    for broken in ("{bad", "[1]"):
        (tmp_path / "g.jsonl").write_text('{"a": 1}\n' + broken + "\n")
        with pytest.raises(Exception, match="JSON|FAILFAST|alformed"):
            jsonl.failing(spark, f"file://{tmp_path}/g.jsonl", schema).collect()
    (tmp_path / "h.jsonl").write_text('{"a": 1}\n \n')
    assert [r.a for r in jsonl.failing(spark, f"file://{tmp_path}/h.jsonl", schema).collect()] == [1]
    jsonl.write_batches([rows, rows], f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 4
    jsonl.write_batches([rows], f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_bytes(b"<p>a\xff\xfeb</p>")
    assert [tuple(r) for r in jsonl.pages(spark, f"file://{tmp_path}/p").collect()] == [("x.html", "<p>ab</p>")]
    assert [r.source_file for r in jsonl.documents(spark, f"file://{tmp_path}/p").collect()] == ["x.html"]


def test_streaming_fold_equals_the_batch_one(spark, tmp_path):
    events = _events(spark, "/root/testdata/sf0.001")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    want = {(r.conv_id, r.turn): r.answer for r in chat.answers(events, ["conv_id", "turn"]).where("done").collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    out = streamed_answers(stream, ["conv_id", "turn"], patience=None).writeStream.format("memory").queryName("folded").outputMode("append")
    query = out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    assert {(r.conv_id, r.turn): r.answer for r in spark.table("folded").collect()} == want and want


def test_one_line_after_the_other():
    for events, answer, thinking, done in fixtures.STREAMS.values():
        state = ("", "", False, False)
        for line in events:
            state = folded(state, line)
        assert (state[0], state[1], state[3]) == (answer, thinking, done)


def test_tool_rounds():
    ask = [{"role": "user", "content": "abc"}]
    answer, messages = chat.converse(ask, fixtures.Calling(), {"length": fixtures.length})
    assert answer == "it has 3" and [m["role"] for m in messages] == ["user", "assistant", "tool", "assistant"] and messages[2]["tool_call_id"] == "1"
    assert chat.converse(ask, fixtures.Calling(), {})[0] == "it has Erreur: outil non supporté 'length'"
    assert chat.converse(ask, lambda m: {"tool_calls": [{}]}, {}) [0] == "" and chat.converse(ask, lambda m: {}, {}) == ("", ask)
    assert [chat.parsed_arguments(x) for x in ({"a": 1}, '{"a": 1}', "plain", None)] == [{"a": 1}, {"a": 1}, {"text": "plain"}, {}]


def test_system_messages():
    texts = {"system": " plain ", "system-DO": "do"}
    assert [chat.system_text(texts, f) for f in (None, "do", "SB")] == ["plain", "do", "plain"] and chat.system_text({}) == ""


def test_generators(spark):
    docs = spark.createDataFrame([(1, "some text", "x"), (2, " ", "y"), (3, None, "z")], "chunk_id int, text string, reply string")
    out = generation.llm_keywords(docs, Canned(lambda p: 'Here: ["1. A", "a", "b"]')).collect()
    assert sorted(map(tuple, out)) == [(1, ["A", "b"]), (2, []), (3, [])]
    both = docs.select(generation.structured_list("reply", Canned(lambda p: f'["{p}"]' if p == "x" else "no")).alias("l"), generation.token_count_by("text", Words()).alias("n"))
    assert [tuple(r) for r in both.collect()] == [(["x"], 2), (None, 0), (None, 0)]
    assert generation.context_size("128000") == 128000
    for bad in ("", "0", "-1", "1e3"):
        with pytest.raises(ValueError):
            generation.context_size(bad)


def test_a_service_over_http_is_tried_again():
    seen, waits = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if len(seen) < 3 else 200)
            self.end_headers()
            self.wfile.write(b'{"response": "ok"}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = HttpGenerator(f"http://127.0.0.1:{server.server_port}/api/generate", "m", wait=waits.append)
    assert model.generate(["p"]) == ["ok"] and waits == [1.1, 2.2] and seen[0] == {"model": "m", "prompt": "p", "stream": False}
    server.shutdown()
    assert HttpGenerator("http://127.0.0.1:9/x", "m", 2, wait=waits.append).generate(["p"]) == [""]


def test_defaults_without_models():
    assert Words().count(["a b", ""]) == [2, 0] and Overlap().score("The cat?", ["a cat", "", "the cat"]) == [0.5, 0.0, 1.0] and Overlap().score("?", ["x"]) == [0.0]
    e = Hashing(8).embed(["a b", "", "B a"])
    assert abs(np.linalg.norm(e[0]) - 1) < 1e-12 and not e[1].any() and (e[0] == e[2]).all()


def test_reranking_keeps_rows_texts_and_ties(spark):
    hits = spark.createDataFrame([(1, "no", 1), (2, "the cat", 2), (3, None, 3), (4, "the dog", 4)], "doc_id int, text string, rank int")
    assert [(r.doc_id, r.text) for r in retrieval.reranked(hits, "the").collect()] == [(2, "the cat"), (4, "the dog"), (1, "no"), (3, None)]


def test_text_functions(spark):
    rows = spark.createDataFrame([(" a \n",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.one_line(F.col("t"))).collect()] == ["a", " ", None]
    assert [r[0] for r in rows.select(text.file_stem(F.lit("a.b.md"))).collect()][:1] == ["a.b"] and rows.select(text.file_stem(F.lit(".md"))).first()[0] == ".md"
    assert rows.select(text.parameter(F.lit("YQ==")), text.parameter(F.lit("?"))).first()[:] == ("a", None)
