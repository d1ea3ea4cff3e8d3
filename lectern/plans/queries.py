"""The registered queries: each applies an operator to whole tables, or to the hand-derived fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.html import html_to_markdown, strip_contents
from lectern.functions.text import image_text_only, normalized_space, one_line, parameter, shell_quoted, token_count
from lectern.functions.vectors import cosine_distance, similarity
from lectern.operators import chat, chunking, collection, generation, keywords, retrieval
from lectern.plans import fixtures
from lectern.plans.oracles import ORACLE_SQL  # noqa: F401  the two belong together
from lectern.providers import Canned, Hashing
from lectern.sources import jsonl
from lectern.storage import scratch

QUESTION = "the that trash"
MODEL, VERSION = "hashing", "1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vector(vectors: DataFrame, vec_id: int) -> list[float]:
    """One stored vector, a query's."""
    found = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in found.embedding] if found else []


def knn_top50(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return retrieval.nearest(vectors, _vector(vectors, 0), 50)


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every hundredth vector among all."""
    vectors = table(spark, d, "embeddings")
    return retrieval.nearest_each(vectors, vectors.where("vec_id % 100 = 0"), 5)


def knn_approximate(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest by the index of all vectors."""
    vectors = table(spark, d, "embeddings")
    query = _vector(vectors, 0)
    return retrieval.approximate(vectors, retrieval.signatures(vectors, len(query)), query, 10)


def result_overlap(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    one, two = (retrieval.nearest(vectors, _vector(vectors, i), 50).select("vec_id") for i in (0, 10))
    return one.intersect(two)


def pair_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the next."""
    v = table(spark, d, "embeddings")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    pairs = a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", F.round(cosine_distance(F.col("x"), F.col("y")), 6).alias("distance"))
    return pairs.select("a", "b", "distance", F.round(similarity(F.col("distance")), 6).alias("similarity"))


def distance_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark text against the next, embedded by three models."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    texts = items.alias("a").join(items.alias("b"), F.col("a.item_id") + 1 == F.col("b.item_id")).select(F.col("a.item_id").alias("item_id"), F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    each = [F.round(cosine_distance(collection.embedding_of("x", Hashing(w)), collection.embedding_of("y", Hashing(w))), 6).alias(f"d{w}") for w in (16, 64, 256)]
    return texts.select("item_id", *each)


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("approx_tokens"))


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sized_lines(table(spark, d, "documents")).select("doc_id", "line_no", "n_tokens")


def spaces_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalized_space(F.col("text")).alias("text"), F.length(one_line(F.col("text"))).alias("one_line"))


def keywords_top5(spark: SparkSession, d: str) -> DataFrame:
    return chunking.top_keywords(table(spark, d, "documents")).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


def _outline(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines, of which every third is made a heading, of level 1 to 3 by its length."""
    rows = chunking.lines(table(spark, d, "documents"))
    line = F.when(F.col("line_no") % 3 == 1, F.concat(F.repeat(F.lit("#"), (F.length("line") % 3 + 1).cast("int")), F.lit(" x"), F.col("line"))).otherwise(F.col("line"))
    return rows.select("doc_id", "line_no", line.alias("line"))


def heading_context(spark: SparkSession, d: str) -> DataFrame:
    return chunking.with_headings(_outline(spark, d), "doc_id").select("doc_id", "line_no", "h1", "h2", "h3", "full_headings")


def heading_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = _outline(spark, d).withColumn("level", chunking.heading_level(F.col("line"))).where("level > 0")
    return chunking.numbered(rows, "doc_id").select("doc_id", "line_no", "numbering")


def section_pack(spark: SparkSession, d: str) -> DataFrame:
    """The outline's lines packed within each section: a heading flushes."""
    rows = _outline(spark, d).withColumn("head", chunking.heading_level(F.col("line")) > 0)
    rows = rows.withColumn("section", F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no"))).where("NOT head")
    rows = rows.withColumn("n_tokens", token_count(F.col("line")))
    out = chunking.packed(rows, ["doc_id", "section"], "line_no", 20)
    return out.select("doc_id", "section", "chunk_no", "approx_tokens", F.col("n_blocks").alias("n_lines"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Each document as Markdown with its source and language for headings."""
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n\n"), F.col("text"))
    return table(spark, d, "documents").select(F.concat(F.lit("doc."), F.col("doc_id"), F.lit(".md")).alias("source_file"), text.alias("text"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.chunk(_markdown(spark, d), 50)
    return out.select("chunk_id", "text", "headings.h1", "headings.h2", F.col("heading.h1").alias("deepest1"), F.col("heading.h2").alias("deepest2"), "full_headings", "approx_tokens", F.array_join("keywords", "|").alias("keywords"))


def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html_to_markdown("html").alias("markdown"))


def contents_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Pages without a table of contents; these have none in front of which one is put."""
    contents = F.lit('<div class="toc"><p>x</p></div><p class="MsoToc2">y</p><ul><li><a href="#_Toc1">z</a></li></ul><p> Table  of\ncontents</p>')
    html = F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), contents))
    return table(spark, d, "pages").select("page_id", strip_contents(html).alias("html"))


def pages_to_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pages_to_chunks(table(spark, d, "pages")).select("chunk_id", "text", "full_headings", "approx_tokens")


def md_table_text(spark: SparkSession, d: str) -> DataFrame:
    """Each region's nations as a Markdown table, parsed."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("| "), F.col("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" | more |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "\n")
    text = rows.groupBy(F.col("r_name").alias("region")).agg(F.concat(F.lit("| key | name |\n|---|:---:|\n"), body).alias("text"))
    return chunking.chunk(text.select(F.col("region").alias("source_file"), "text"), 1000).select(F.split_part("chunk_id", F.lit("-"), F.lit(1)).alias("region"), "text")


def relation_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("region"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return chunking.table_text(rows, ["region"], ["key", "name"], "key")


def add_title(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("h1"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.col("lang"), F.lit(" "))).otherwise(" ").alias("h2"))
    return chunking.add_title(docs, ["h1", "h2"]).select("doc_id", "text")


def _chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("chunk_id"))


def corpus_info(spark: SparkSession, d: str) -> DataFrame:
    return collection.info(_chunk_ids(spark, d))


def corpus_purge(spark: SparkSession, d: str) -> DataFrame:
    return collection.chunks_per_file(collection.purged(_chunk_ids(spark, d), "src1?"))


def corpus_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """All documents chunked, embedded and added, one file added again, some purged, and what is left."""
    corpus = collection.Corpus(spark, scratch(spark, "corpus")).reset()
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("."), F.col("doc_id"), F.lit(".md")).alias("source_file"), "text")
    embedded = corpus.embeddings(docs)
    corpus.add(embedded)
    corpus.add(embedded.where(collection.file_of(F.col("chunk_id")).endswith("7")), "replace")
    gone = corpus.purge("src1?.*")
    return corpus.info().select("file", "n", F.lit(gone).cast("long").alias("purged"))


def corpus_request(spark: SparkSession, d: str) -> DataFrame:
    """The request for a question over the embedded benchmark items."""
    corpus = collection.Corpus(spark, scratch(spark, "request")).reset()
    items = table(spark, d, "benchmark").select(F.concat(F.lit("item."), F.col("item_id"), F.lit(".md")).alias("source_file"), F.concat(F.lit("# item\n"), F.col("text")).alias("text"))
    corpus.add(corpus.embeddings(items, 100_000))
    return corpus.request(QUESTION, "some-model", rerank=True, k=5).select("n_tokens", F.get_json_object("request", "$.model").alias("model"), F.get_json_object("request", "$.messages[0].content").alias("prompt"))


def bm25_top50(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(table(spark, d, "documents"), retrieval.re_terms(QUESTION), 50)


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same from an index, which is built first."""
    return retrieval.Postings(spark, scratch(spark, "postings")).build(table(spark, d, "documents")).search(retrieval.re_terms(QUESTION), 50)


def _two_stage(spark: SparkSession, d: str, last: int) -> DataFrame:
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    query = _vector(table(spark, d, "embeddings"), 0)
    return retrieval.two_stage(vectors, query, table(spark, d, "documents"), QUESTION, last=last)


def two_stage_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _two_stage(spark, d, 50).select("doc_id", "distance", "reranker", "rnk")


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.prompt(_two_stage(spark, d, 10), QUESTION, "rnk")


def request_json(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "benchmark").select("item_id", retrieval.request_json(F.col("text"), "some-model").alias("request"))
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("item_id").cast("string").alias("content")).alias("message"))).alias("choices")))
    return out.select("item_id", F.get_json_object("request", "$.messages[0].content").alias("content"), F.get_json_object("request", "$.model").alias("model"), retrieval.answer_of(reply).alias("answer"))


def map_reduce_answers(spark: SparkSession, d: str) -> DataFrame:
    """A question asked of each turn of a conversation, and then of the answers; the generator says how long its prompt is."""
    parts = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("part"), "text")
    return generation.answered(parts, "Who?", Canned(lambda p: str(len(p))), ["conv_id"])


def embed_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", collection.cache_key(F.col("text"), MODEL, VERSION).alias("k"))


def embed_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    cached = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select(collection.cache_key(F.col("text"), MODEL, VERSION).alias("k"))
    found = collection.cache_misses(docs, cached, MODEL, VERSION).agg(F.count("*").alias("n_miss"), F.countDistinct("k").alias("n_distinct_miss"))
    return found.crossJoin(docs.agg(F.count("*").alias("n_total")))  # one row each


def embed_docs(spark: SparkSession, d: str) -> DataFrame:
    out = collection.embed(table(spark, d, "documents").select("doc_id", "text"), Hashing(8), scratch(spark, "cache"))
    return out.select("doc_id", *(F.round(F.get("embedding", F.lit(i)), 5).cast("double").alias(f"e{i}") for i in range(8)), F.col("model.name").alias("model"), F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("dated"))


def vocab_docfreq(spark: SparkSession, d: str) -> DataFrame:
    return keywords.document_frequency(table(spark, d, "documents"))


def vocab_specificity(spark: SparkSession, d: str) -> DataFrame:
    return keywords.specificity(table(spark, d, "documents"))


def phrases_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return keywords.key_phrases(table(spark, d, "documents"))


def quoted_spans(spark: SparkSession, d: str) -> DataFrame:
    return keywords.marked_spans(table(spark, d, "documents"))


def keyword_list_parse(spark: SparkSession, d: str) -> DataFrame:
    """A reply with a list of each part's words, marked and repeated in capitals, read back."""
    words = F.split("p_name", " ")
    quoted = F.concat(F.transform(words, lambda w, i: F.concat(F.lit('"'), F.element_at(F.array(*map(F.lit, ["1. ", "- ", "• ", "Keyword: ", "(", " · "])), i % 6 + 1), w, F.lit(' ."'))), F.transform(words, lambda w: F.concat(F.lit('"'), F.upper(w), F.lit('"'))))
    reply = F.concat(F.lit("Sure: ["), F.array_join(quoted, ", "), F.lit("] done"))
    found = table(spark, d, "part").select("p_partkey", F.posexplode(keywords.listed_keywords(reply)).alias("at", "keyword"))
    return found.select("p_partkey", (F.col("at") + 1).alias("pos"), "keyword")


def llm_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords that a generator gives: the first three words of each text."""
    docs = table(spark, d, "documents")
    answer = Canned(lambda p: '["' + '", "'.join(p.removeprefix(generation.ASK_KEYWORDS).split()[:3]).replace("\\", "") + '"]')
    return generation.llm_keywords(docs.select("doc_id", F.translate("text", '"\\', "").alias("text")), answer, "doc_id").select("doc_id", F.size("keywords").alias("n"))


def projector_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    # as floats: with an integer the product is a double, which rounds otherwise beside a half
    scaled = F.transform("embedding", lambda x: F.round(x * F.lit(100).cast("float")).cast("int"))
    return jsonl.projector(docs.withColumn("embedding", scaled), "the")


def image_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text with an image before and after it, described by a constant."""
    text = F.concat(F.lit("![k](data:image/png;base64,AAAA) "), F.col("text"), F.lit(" ![](data:image/gif;base64,BB==)"))
    return table(spark, d, "documents").select("doc_id", image_text_only(text).alias("text"))


class _Sized:
    """Describes an image by the length of its URL."""

    def describe(self, images: list[str]) -> list[str]:
        return [f"an image of {len(x)} signs" for x in images]


def images_described(spark: SparkSession, d: str) -> DataFrame:
    """Every third text with its own image in front, described once for each distinct one, through a cache."""
    image = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("![a](data:image/png;base64,"), F.repeat(F.lit("A"), (F.col("doc_id") % 50 + 1).cast("int")), F.lit(") "))).otherwise("")
    docs = table(spark, d, "documents").select("doc_id", F.concat(image, "text").alias("text"))
    return collection.describe_images(docs, _Sized(), scratch(spark, "images"))


def chat_last_user(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_requests(table(spark, d, "conversations"))


def chat_templates(spark: SparkSession, d: str) -> DataFrame:
    """The unfiltered templates, for all conversations and one of which there is only a raw body."""
    turns = table(spark, d, "conversations")
    bodies = turns.select("conv_id", F.lit("raw").alias("body")).distinct().unionByName(spark.sql("SELECT -1L AS conv_id, 'only a body' AS body"))
    return chat.last_requests(turns, unfiltered=("A {REQUEST}!", "no place"), variables={"FILTER": "none"}, bodies=bodies)


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return chat.history(turns, "Answer from the context.", chat.last_requests(turns))


def chat_context(spark: SparkSession, d: str) -> DataFrame:
    """Histories with a pair of turns that carries context."""
    turns = table(spark, d, "conversations")
    context = turns.groupBy("conv_id").agg(F.concat(F.lit("of "), F.count("*")).alias("text"))
    return chat.augmented(chat.history(turns, "", chat.last_requests(turns)), context)


def _said(spark: SparkSession, d: str) -> DataFrame:
    """The turns, even ones as commands: /SET with a name and every other time a value."""
    value = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  v"), F.col("turn"))).otherwise("")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" /SET name"), F.col("turn") % 3, value)).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", text.alias("text"))


def chat_slash(spark: SparkSession, d: str) -> DataFrame:
    return chat.commands(_said(spark, d), "text").select("conv_id", "turn", "cmd", "arg1", "arg2", "open")


def chat_variables(spark: SparkSession, d: str) -> DataFrame:
    found = chat.variables(chat.commands(_said(spark, d), "text"), ["conv_id"], "turn")
    return chat.shown(found, ["conv_id"])


def chat_client_history(spark: SparkSession, d: str) -> DataFrame:
    return chat.client_history(_said(spark, d), ["conv_id"], "turn").select("conv_id", "turn", "role", "text")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a stream: a word an event, by one of five shapes, thinking first, a tool call with its
    end at the beginning of every third, noise in between, and an end, which every fifth lacks."""
    turns = table(spark, d, "conversations").where("text IS NOT NULL")
    words = turns.select("conv_id", "turn", F.posexplode(F.split("text", "(?<= )")).alias("seq", "w"))
    j = lambda shape: F.to_json(shape)
    content = F.struct(F.col("w").alias("content"))
    shapes = [
        j(F.struct(content.alias("message"))), j(F.struct(F.struct(content.alias("delta")).alias("message"))), j(F.struct(content.alias("delta"))),
        j(F.struct(F.col("w").alias("response"))), j(content),
    ]
    n = F.col("seq") % 5
    event = F.when(n == 0, shapes[0]).when(n == 1, shapes[1]).when(n == 2, shapes[2]).when(n == 3, shapes[3]).otherwise(shapes[4])
    pieces = words.select("conv_id", "turn", (F.col("seq") * 2 + 10).alias("seq"), event.alias("event"))
    noise = words.select("conv_id", "turn", (F.col("seq") * 2 + 11).alias("seq"), F.lit("no json {").alias("event"))
    of = lambda seq, event, where="true": turns.where(where).select("conv_id", "turn", F.lit(seq).alias("seq"), F.lit(event).alias("event"))
    start = of(0, '{"messages":[]}').unionByName(of(1, '{"message":{"content":"","thinking":"hm"}}'))
    tool = of(2, '{"message":{"content":"","tool_calls":[{}]}}', "turn % 3 = 0").unionByName(of(3, '{"done":true}', "turn % 3 = 0"))
    ends = of(1 << 30, '{"done":true}', "turn % 5 > 0").unionByName(of((1 << 30) + 1, '{"message":{"content":"late"}}', "turn % 5 > 0"))
    return pieces.unionByName(noise).unionByName(start).unionByName(tool).unionByName(ends)


def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    return chat.answers(_events(spark, d), ["conv_id", "turn"])


def stream_terminated(spark: SparkSession, d: str) -> DataFrame:
    """Every stream's last event once those without an end have one."""
    ended = chat.terminated(_events(spark, d).where("turn % 3 > 0"), ["conv_id", "turn"])
    return ended.groupBy("conv_id", "turn").agg(F.max_by("event", "seq").alias("event"))


def tool_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Turns asked of a model that first calls a tool, by text for odd lengths and JSON for even ones."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return chat.conversed(turns, fixtures.Calling, {"length": fixtures.length}).select("conv_id", "turn", "answer", "n_messages")


def jsonl_modes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as lines, with a broken one after every fifth, and read in each way."""
    path, schema = scratch(spark, "lines"), "conv_id long, turn long, text string"
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    turns.select(F.explode(F.when(F.col("turn") % 5 == 0, F.array(line, F.lit("{broken"), F.lit(""))).otherwise(F.array(line))).alias("value")).write.text(path)
    good = jsonl.skipping(spark, path, schema).agg(F.count("*").alias("skipping"), F.sum("turn").alias("turns"))
    _, counts = jsonl.counting(spark, path, schema)
    passed = jsonl.passed_on(jsonl.passing(spark, path, schema)).agg(F.count("*").alias("passing"), F.count_if(F.col("value") == "{broken").alias("broken"))
    return good.crossJoin(counts).crossJoin(passed)  # one row each


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Parameters, quoting and hashes of the benchmark's texts."""
    out = table(spark, d, "benchmark").select("item_id", parameter(F.base64(F.encode("text", "utf-8"))).alias("text"), shell_quoted(F.col("text")).alias("quoted"), F.sha1("text").alias("sha1"))
    return out


def _ordered(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return fixtures.QUERIES[name](spark)

    query.__name__ = name
    return query


QUERIES = {
    f.__name__: f
    for f in (
        knn_top50, knn_batch, knn_approximate, result_overlap, pair_distance, distance_by_model, token_estimate, line_blocks, spaces_normalized, keywords_top5, heading_context,
        heading_numbers, section_pack, chunks, html_markdown, contents_stripped, pages_to_chunks, md_table_text, relation_text, add_title, corpus_info, corpus_purge,
        corpus_lifecycle, corpus_request, bm25_top50, bm25_postings, two_stage_rerank, prompt_context, request_json, map_reduce_answers, embed_cache_key, embed_cache_miss, embed_docs,
        vocab_docfreq, vocab_specificity, phrases_per_doc, quoted_spans, keyword_list_parse, llm_keywords, projector_labels, image_text, images_described,
        chat_last_user, chat_templates, chat_history, chat_context, chat_slash, chat_variables, chat_client_history, stream_fold, stream_terminated, tool_rounds, jsonl_modes, text_functions,
        *map(_ordered, fixtures.QUERIES),
    )
}
