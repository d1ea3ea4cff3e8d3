"""Small inputs with results that were derived by hand from the operators' definitions, as queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.html import html_to_markdown
from lectern.functions.text import image_text_only
from lectern.functions.vectors import cosine_distance
from lectern.operators import chat, chunking, collection, keywords


def length(arguments: dict) -> str:
    """A tool: how long its text is."""
    return str(len(arguments["text"]))


class Calling:
    """A model that asks for the length of the question, and then tells it."""

    def __call__(self, messages: list[dict]) -> dict:
        import json

        if messages[-1]["role"] == "tool":
            return {"content": f"it has {messages[-1]['content']}"}
        text = messages[-1]["content"]
        raw = {"text": text} if len(text) % 2 == 0 else json.dumps({"text": text})
        return {"content": "", "tool_calls": [{"id": "1", "function": {"name": "length", "arguments": raw}}]}


_IMAGE = "<IMAGE DESCRIPTION START>d<IMAGE DESCRIPTION END>"
#: name: (budget, text, chunks as (text, tokens, full_headings))
CHUNKS = {
    "F1": (200, "# A\n\np1 w w\n\n## B\ntext", [("p1 w w", 3, "A"), ("text", 1, "A; B")]),
    "F2": (200, "# A\n\n## B\n\nx", [("", 0, "A"), ("x", 1, "A; B")]),
    "F3": (3, "# A\n\na b c d\n\ne", [("", 0, "A"), ("a b c d", 4, "A"), ("e", 1, "A")]),
    "F4": (200, "# A\n\np1\n\np2\n\n- x\n  y\n\n- z\n\nend", [("p1\n\np2\n\n- x\n  y\n\n- z\n\nend", 8, "A")]),
    "F4b": (1, "# A\n\np1\n\np2\n\n- x\n  y\n\n- z\n\nend", [("", 0, "A"), ("p1\n\np2\n\n- x\n  y\n\n- z", 7, "A"), ("end", 1, "A")]),
    "F5": (1, "# A\npara\n- item", [("para", 1, "A"), ("- item", 2, "A")]),
    "F6": (200, f"P2\n\nP1\n\n{_IMAGE}", [(f"P2\n\nP2\nP1\n{_IMAGE}", 8, "")]),
    "F7": (200, "| a | b |\n| --- | --- |\n| 1 | 2 |\n| | 3 | 4 |", [("TABLE:\na: 1; b: 2\nb: 3; col3: 4", 9, "")]),
    "F7b": (200, "| a | b |\n| --- | --- |", [("TABLE:\na | b", 4, "")]),
    "F8": (1, "| a |\n| --- |\n| 1 |", [("| a |", 3, ""), ("| --- |", 3, ""), ("| 1 |", 3, "")]),
    "F9": (1, "p\n\n<table>\n<tr><td>1</td></tr>\n</table> tail", [("p\n\n<table>\n<tr><td>1</td></tr>\n</table> tail", 5, "")]),
    "gap": (200, "# A\n### C\nx\n## B\ny", [("x", 1, "A; C"), ("y", 1, "A; B")]),
    "none": (200, "", []),
}
MARKDOWN = {
    "F19": ("<h1>T</h1><p>a <b>b</b></p><ul><li>x<ul><li>y</li></ul></li></ul>", "# 1 T\n\na **b**\n\n- x\n    - y\n"),
    "F20": ('<p>a<sup><a href="#fn1">[1]</a></sup></p><ol><li id="fn1">note <a href="#footnote-ref-1">^</a></li></ol>', "a [Note: note]\n"),
    "F21": ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr></table>", "| a | b |\n| --- | --- |\n| a | b |\n| 1 | x\\|y |\n"),
    "F18": ("<h1>a</h1><h2>b</h2><h2>c</h2><h1>d</h1><h3>e</h3>", "# 1 a\n\n## 1.1 b\n\n## 1.2 c\n\n# 2 d\n\n### 2.1 e\n"),
    "quote": ("<blockquote>a<br>b</blockquote><hr><pre>x\n  y\n</pre><div>d <b>e</b></div>", "> a\n> b\n\n---\n\n```\nx\n  y\n```\n\nd e\n"),
    "ordered": ('<ol start="3"><li>a</li><li value="7">b</li><li>c</li></ol><!-- ad --><p><a href="u">t</a> <img src="s" alt=" k "><code>c</code></p>', "3. a\n7. b\n8. c\n\nad\n\n[t](u) ![k](s)`c`\n"),
}
STREAMS = {
    "F16": (['{"message":{"content":"Hel"}}', "garbage", '{"message":{"content":"lo"}}', '{"done":true}'], "Hello", "", True),
    "F17": (['{"message":{"content":"","tool_calls":[{}]}}', '{"done":true}', '{"message":{"content":"x"}}', '{"done":true}'], "x", "", True),
    "think": (['{"message":{"thinking":"a"}}', '{"thinking":"b"}', '{"response":"c"}', '{"message":{"thinking":"d"}}'], "c", "d", False),
    "last": (['{"done":true,"message":{"content":"all"}}', '{"response":"late"}'], "all", "", True),
    "empty": (['{"message":{"content":"","tool_calls":[]}}', '{"done":true}', '{"response":"late"}'], "", "", True),
}
REPLIES = {
    "F15": ('Sure: ["1. Foo", "foo", "- Bar baz ", ""] bye', ["Foo", "Bar baz"]),
    "marks": ('["Mots-clés : (un  deux)", "• trois", "· {quatre}", "Keyword: 5) cinq", "[six]."]', ["un deux", "trois", "quatre", "cinq", "six"]),
    "none": ("no list here", []),
}


def fixture_chunks(spark: SparkSession) -> DataFrame:
    out = None
    for budget in sorted({b for b, _, _ in CHUNKS.values()}):
        rows = spark.createDataFrame([(k, t) for k, (b, t, _) in CHUNKS.items() if b == budget], "source_file string, text string")
        found = chunking.chunk(rows, budget).select("chunk_id", "text", "approx_tokens", "full_headings")
        out = found if out is None else out.unionByName(found)
    return out


def fixture_markdown(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, h) for k, (h, _) in MARKDOWN.items()], "name string, html string").select("name", html_to_markdown("html").alias("markdown"))


def fixture_streams(spark: SparkSession) -> DataFrame:
    rows = [(k, i, e) for k, (events, *_) in STREAMS.items() for i, e in enumerate(events)]
    return chat.answers(spark.createDataFrame(rows, "name string, seq int, event string"), ["name"])


def fixture_replies(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(k, r) for k, (r, _) in REPLIES.items()], "name string, reply string")
    return rows.select("name", F.array_join(keywords.listed_keywords(F.col("reply")), "|").alias("keywords"))


def fixture_keywords(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("F10", "Forge forge outil --- 12 CI/CD cœur outil x")], "name string, text string")
    return chunking.top_keywords(rows, id="name").select("name", F.array_join("keywords", "|").alias("keywords"))


def fixture_titles(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("F11", "t", "A", None, " C "), ("none", "t", " ", None, None)], "name string, text string, h1 string, h2 string, h3 string")
    return chunking.add_title(rows, ["h1", "h2", "h3"]).select("name", "text")


def fixture_distances(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("F12", [1.0, 0.0], [0.6, 0.8]), ("zero", [1.0, 0.0], [0.0, 0.0]), ("opposite", [1.0, 1.0], [-2.0, -2.0])], "name string, a array<double>, b array<double>")
    return rows.select("name", F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def fixture_collection(spark: SparkSession) -> DataFrame:
    """files with the total, and what purges leave."""
    ids = spark.createDataFrame([("a.b-6",), ("a-b-12",), ("nope",)], "chunk_id string")
    three = spark.createDataFrame([("a-1",), ("a-b-3",), ("ab-1",)], "chunk_id string")
    left = lambda label, df: df.select(F.concat(F.lit(label), "chunk_id").alias("file"), F.lit(1).cast("long").alias("n"))
    return collection.info(ids).unionByName(left("purged ", collection.purged(three, "a"))).unionByName(left("exact ", collection.purged(three, "a", True)))


def fixture_variables(spark: SparkSession) -> DataFrame:
    """two variables are set, and one is deleted by a set without a value."""
    rows = [("x", 0, "/set B 2"), ("x", 1, "/set A 1"), ("x", 2, "/set B"), ("y", 0, "/set"), ("y", 1, "/ SET q  w "), ("y", 2, "plain /set z 1")]
    found = chat.variables(chat.commands(spark.createDataFrame(rows, "k string, at int, said string"), "said"), ["k"], "at")
    return chat.shown(found, ["k"])


def fixture_images(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F22", "m ![k](data:image/png;base64,AAAA) n")], "name string, text string").select("name", image_text_only(F.col("text")).alias("text"))


def _quoted(x: object) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)}) AS v({columns})"


QUERIES = {
    f.__name__: f
    for f in (
        fixture_chunks, fixture_markdown, fixture_streams, fixture_replies, fixture_keywords, fixture_titles, fixture_distances, fixture_collection, fixture_variables, fixture_images,
    )
}
EXPECTED = {
    "fixture_chunks": _values([(f"{k}-{i}", *c) for k, (_, _, found) in CHUNKS.items() for i, c in enumerate(found, 1)], "chunk_id, text, approx_tokens, full_headings"),
    "fixture_markdown": _values([(k, m) for k, (_, m) in MARKDOWN.items()], "name, markdown"),
    "fixture_streams": _values([(k, *rest) for k, (_, *rest) in STREAMS.items()], "name, answer, thinking, done"),
    "fixture_replies": _values([(k, "|".join(w)) for k, (_, w) in REPLIES.items()], "name, keywords"),
    "fixture_keywords": _values([("F10", "forge|outil|---")], "name, keywords"),
    "fixture_titles": _values([("F11", "C\n\nt"), ("none", "t")], "name, text"),
    "fixture_distances": "SELECT name, distance::DOUBLE AS distance FROM (VALUES ('F12', 0.4), ('zero', 1.0), ('opposite', 2.0)) AS v(name, distance)",
    "fixture_collection": "SELECT file, n::BIGINT AS n FROM (VALUES ('a.b', 1), ('a-b', 1), (NULL, 3), ('purged ab-1', 1), ('exact a-b-3', 1), ('exact ab-1', 1)) AS v(file, n)",
    "fixture_variables": _values([("x", "A=1"), ("y", "q=w")], "k, listing"),
    "fixture_images": _values([("F22", "m <IMAGE DESCRIPTION START>pas de description<IMAGE DESCRIPTION END> n")], "name, text"),
}
