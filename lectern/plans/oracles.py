"""DuckDB SQL that gives the queries' rows.  It shares no constant with the operators: words, patterns and
formulas are written here again."""

from __future__ import annotations

from lectern.plans.fixtures import EXPECTED

_STOP = ", ".join(
    f"'{w}'"
    for w in (
        "the and for with that this these those are was were has have had but not you your yours from they their them a an in on of to is it as be by or if we our us at can "
        "could should would may might will shall do does did so than then there here also into out up down le la les un une des du de d au aux et ou mais ne pas plus pour par "
        "dans sur ce cet cette ces se sa son ses leur leurs qui que quoi dont où quand comme ainsi est sont étaient était été être ont avait avec sans entre vers chez sous après avant"
    ).split()
)
_TOKENS = """list_filter(regexp_extract_all(lower({0}), '[A-Za-zÀ-ÖØ-öø-ÿ0-9\\-]+'), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN (""" + _STOP + "))"
_COUNT = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"
_LINES = f"""
    s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    t AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM s),
    lines AS (SELECT doc_id, i AS line_no, a[i] AS line, {_COUNT.format("a[i]")} AS n_tokens FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM t))
"""
_OUTLINE = f"""{_LINES}, o AS (
    SELECT doc_id, line_no, CASE WHEN line_no % 3 = 1 THEN length(line) % 3 + 1 ELSE 0 END AS level, CASE WHEN line_no % 3 = 1 THEN rtrim('x' || line) END AS title, n_tokens FROM lines)
"""
_COSINE = "CASE WHEN list_cosine_similarity({0}, {1}) IS NULL THEN 1.0 ELSE 1 - greatest(-1.0, least(1.0, list_cosine_similarity({0}, {1}))) END"
_DISTANCE = _COSINE.format("v.embedding::DOUBLE[]", "q.embedding::DOUBLE[]")
_NEAR = f"(SELECT v.vec_id, round({_DISTANCE}, 6) AS distance, row_number() OVER (ORDER BY round({_DISTANCE}, 12), v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id = {{0}} QUALIFY rank <= {{1}})"
_ASKED = ("the", "that", "trash")
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_ASKED))
_SCORE = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(3))
_BM25 = f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS dl, {_TF} FROM w),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3))} FROM c)
    SELECT doc_id, round({_SCORE}, 6) AS score FROM c, st WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0 ORDER BY score DESC, doc_id LIMIT 50
"""
_RERANK = f"""
    hits AS (SELECT doc_id, text, distance, rank FROM documents JOIN {_NEAR.format(0, 500)} ON doc_id = vec_id),
    scored AS (SELECT *, round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ0-9]+')), ['the', 'that', 'trash'])) / 3, 6) AS reranker FROM hits),
    best AS (SELECT doc_id, text, distance, reranker, row_number() OVER (ORDER BY reranker DESC, rank) AS rnk FROM scored)
"""
_QUOTES = ('"([^"\\n]{2,})"', "“([^”\\n]{2,})”", "«\\s*([^»\\n]{2,})\\s*»")
_EMPHASIS = ("\\*\\*([^*\\n]{2,})\\*\\*", "\\*([^*\\n]{2,})\\*", "__([^_\\n]{2,})__", "_([^_\\n]{2,})_")


def _spans(patterns: tuple[str, ...]) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, unnest(x) AS raw, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS x FROM documents)" for k, p in enumerate(patterns))
    return f"""
        raw AS ({each}),
        spans AS (SELECT doc_id, k, i, array_to_string(w, ' ') AS phrase, len(w) AS words FROM (SELECT doc_id, k, i, {_TOKENS.format("raw")} AS w FROM raw) WHERE len(w) BETWEEN 1 AND 3)
    """


def _phrases(patterns: tuple[str, ...]) -> str:
    return f"""
        t AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents), {_spans(patterns)},
        p AS (SELECT doc_id, n AS words, array_to_string(t[i : i + n - 1], ' ') AS phrase, 1.0 AS weight, n::BIGINT * 1000000000 + i AS seen
              FROM (SELECT doc_id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i FROM t, (SELECT unnest([1, 2, 3]) AS n))
              UNION ALL SELECT doc_id, words, phrase, 2.5, k * 100000000 - 900000000 + i FROM spans),
        sc AS (SELECT doc_id, phrase, sum(weight) + 0.25 * (any_value(words) - 1) AS score, min(seen) AS seen FROM p WHERE length(replace(phrase, ' ', '')) >= 3 GROUP BY doc_id, phrase)
    """


_USER = """
    u AS (SELECT conv_id, count(*) AS n_user, arg_max(text, turn) AS request FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
    pr AS (SELECT conv_id, n_user, CASE WHEN n_user <= 1 THEN 1 ELSE 2 END AS template,
                  CASE WHEN n_user <= 1 THEN 'First question: ' ELSE 'Next question: ' END || request AS prompt FROM u)
"""
_KEPT = f"""{_USER}, k AS (
    SELECT c.conv_id, turn, role, CASE WHEN turn = max(turn) FILTER (role = 'user' AND text IS NOT NULL) OVER (PARTITION BY c.conv_id) THEN coalesce(prompt, text) ELSE text END AS content
    FROM conversations c LEFT JOIN pr ON pr.conv_id = c.conv_id WHERE role IN ('user', 'assistant'))
"""
_SAID = """
    said AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN ' /SET name' || turn % 3 || CASE WHEN turn % 4 = 0 THEN '  v' || turn ELSE '' END ELSE text END AS text FROM conversations)
"""
_GREEDY = """
    SELECT l.doc_id, l.section, l.i, CASE WHEN f.tok + l.n_tokens > {0} THEN f.chunk_no + 1 ELSE f.chunk_no END,
           CASE WHEN f.tok + l.n_tokens > {0} THEN l.n_tokens ELSE f.tok + l.n_tokens END
    FROM f JOIN b l ON l.doc_id = f.doc_id AND l.section = f.section AND l.i = f.i + 1
"""


def _chunked(blocks: str, budget: int) -> str:
    """Greedy chunks of blocks b (doc_id, section, i from 1, n_tokens) as f (doc_id, section, i, chunk_no, tok)."""
    return f"""
        {blocks}, f AS (
            SELECT doc_id, section, i, 1 AS chunk_no, n_tokens AS tok FROM b WHERE i = 1
            UNION ALL {_GREEDY.format(budget)})
    """


_SPACE = "' ' || chr(10) || chr(9) || chr(13)"
_CHUNKS = _chunked(f"""{_LINES}, b AS (SELECT doc_id, 1 AS section, line_no + 1 AS i, line, n_tokens FROM lines UNION ALL SELECT doc_id, 1, 1, '', 0 FROM documents)""", 50)


def _hashed(text: str, key: str, source: str, width: int) -> str:
    """(key, e): the unit vectors of signed feature hashing."""
    h = "('0x' || left(md5(w), 8))::BIGINT"
    return f"""
        (SELECT {key}, list(v / CASE WHEN size = 0 THEN 1 ELSE size END ORDER BY j) AS e FROM (
            SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS size FROM (
                SELECT d.{key}, j, coalesce(sum(CASE WHEN h % 2 = 1 THEN 1.0 ELSE -1.0 END) FILTER (h IS NOT NULL), 0.0)::DOUBLE AS v
                FROM (SELECT {key}, unnest(generate_series(0, {width} - 1)) AS j FROM {source}) d
                LEFT JOIN (SELECT {key}, {h} AS h FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-zà-öø-ÿ0-9]+')) AS w FROM {source})) x
                ON x.{key} = d.{key} AND h // 2 % {width} = j GROUP BY d.{key}, j)) GROUP BY {key})
    """


_MODELS = ", ".join(f"round({_COSINE.format(f'a{w}.e', f'b{w}.e')}, 6) AS d{w}" for w in (16, 64, 256))
_MODEL_TABLES = " ".join(
    f"JOIN h{w} a{w} ON a{w}.item_id = i.item_id JOIN h{w} b{w} ON b{w}.item_id = i.item_id + 1" for w in (16, 64, 256)
)

ORACLE_SQL = {
    "knn_top50": f"SELECT vec_id, distance FROM {_NEAR.format(0, 50)}",
    "knn_batch": f"""
        SELECT q.vec_id AS query, v.vec_id, round({_DISTANCE}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DISTANCE}, 12), v.vec_id) AS rnk
        FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY rnk <= 5
    """,
    "result_overlap": f"SELECT vec_id FROM {_NEAR.format(0, 50)} INTERSECT SELECT vec_id FROM {_NEAR.format(10, 50)}",
    "pair_distance": f"SELECT v.vec_id AS a, q.vec_id AS b, round({_DISTANCE}, 6) AS distance, round(1 - round({_DISTANCE}, 6), 6) AS similarity FROM embeddings v JOIN embeddings q ON v.vec_id + 1 = q.vec_id",
    "distance_by_model": f"""
        WITH {", ".join(f"h{w} AS {_hashed('text', 'item_id', 'benchmark', w)}" for w in (16, 64, 256))}
        SELECT i.item_id, {_MODELS} FROM benchmark i {_MODEL_TABLES}
    """,
    "token_estimate": f"SELECT doc_id, {_COUNT.format('text')}::INT AS approx_tokens FROM documents",
    "line_blocks": f"WITH {_LINES} SELECT doc_id, line_no, n_tokens FROM lines",
    "spaces_normalized": """
        SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, greatest(length(trim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ' || chr(9))), 1)::INT AS one_line FROM documents
    """,
    "keywords_top5": f"""
        WITH t AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
        e AS (SELECT doc_id, t[i] AS token, i FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM t)),
        c AS (SELECT doc_id, token, count(*) AS n, min(i) AS first FROM e GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS r FROM c)
        SELECT doc_id, string_agg(token, '|' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY doc_id
    """,
    "heading_context": f"""
        WITH {_OUTLINE}, g AS (
            SELECT *, max(CASE WHEN level BETWEEN 1 AND 1 THEN line_no END) OVER w AS p1, max(CASE WHEN level BETWEEN 1 AND 2 THEN line_no END) OVER w AS p2,
                   max(CASE WHEN level BETWEEN 1 AND 3 THEN line_no END) OVER w AS p3 FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        x AS (SELECT g.doc_id, g.line_no, a.title AS h1, CASE WHEN b.level = 2 THEN b.title END AS h2, CASE WHEN c.level = 3 THEN c.title END AS h3
              FROM g LEFT JOIN o a ON a.doc_id = g.doc_id AND a.line_no = p1 LEFT JOIN o b ON b.doc_id = g.doc_id AND b.line_no = p2 LEFT JOIN o c ON c.doc_id = g.doc_id AND c.line_no = p3)
        SELECT *, concat_ws('; ', h1, h2, h3) AS full_headings FROM x
    """,
    "heading_numbers": f"""
        WITH {_OUTLINE}, h AS (SELECT * FROM o WHERE level > 0),
        g AS (SELECT *, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        n AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS n1, sum((level = 2)::INT) OVER (PARTITION BY doc_id, g2 ORDER BY line_no)::INT AS n2,
                     sum((level = 3)::INT) OVER (PARTITION BY doc_id, g3 ORDER BY line_no)::INT AS n3 FROM g)
        SELECT doc_id, line_no, concat_ws('.', nullif(n1, 0), CASE WHEN level > 1 THEN nullif(n2, 0) END, CASE WHEN level > 2 THEN nullif(n3, 0) END) AS numbering FROM n
    """,
    "section_pack": f"""
        WITH RECURSIVE {_OUTLINE}, r AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS section FROM o),
        {_chunked("b AS (SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS i, n_tokens FROM r WHERE level = 0)", 20)}
        SELECT doc_id, section, chunk_no, max(tok)::INT AS approx_tokens, count(*)::INT AS n_lines FROM f GROUP BY doc_id, section, chunk_no
    """,
    "chunks": f"""
        WITH RECURSIVE {_CHUNKS},
        c AS (SELECT f.doc_id, chunk_no + 1 AS no, trim(string_agg(line, chr(10) ORDER BY f.i), {_SPACE}) AS text, sum(n_tokens)::INT AS approx_tokens FROM f JOIN b USING (doc_id, section, i) GROUP BY f.doc_id, chunk_no
              UNION ALL SELECT doc_id, 1, '', 0 FROM documents),
        ct AS (SELECT doc_id, no, {_TOKENS.format("text")} AS t FROM c),
        e AS (SELECT doc_id, no, t[i] AS token, i FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM ct)),
        k AS (SELECT doc_id, no, token, count(*) AS n, min(i) AS first FROM e GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY n DESC, first) AS r FROM k),
        w AS (SELECT doc_id, no, string_agg(token, '|' ORDER BY r) AS keywords FROM r WHERE r <= 5 GROUP BY doc_id, no)
        SELECT 'doc.' || c.doc_id || '-' || c.no AS chunk_id, c.text, source AS h1, CASE WHEN c.no > 1 THEN lang END AS h2, CASE WHEN c.no = 1 THEN source END AS deepest1, CASE WHEN c.no > 1 THEN lang END AS deepest2,
               source || CASE WHEN c.no > 1 THEN '; ' || lang ELSE '' END AS full_headings, approx_tokens, coalesce(keywords, '') AS keywords
        FROM c JOIN documents d ON d.doc_id = c.doc_id LEFT JOIN w ON w.doc_id = c.doc_id AND w.no = c.no
    """,
    "contents_stripped": "SELECT page_id, html FROM pages",
    "md_table_text": """
        SELECT r_name AS region, 'TABLE:' || chr(10) || string_agg('key: ' || n_nationkey || '; name: ' || n_name || '; col3: more', chr(10) ORDER BY n_nationkey) AS text
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    """,
    "relation_text": """
        SELECT r_name AS region, 'TABLE:' || chr(10) || string_agg('key: ' || n_nationkey || CASE WHEN n_name <> '' THEN '; name: ' || n_name ELSE '' END, chr(10) ORDER BY n_nationkey) AS text
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    """,
    "add_title": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END || chr(10) || chr(10) || text AS text FROM documents",
    "corpus_info": "SELECT source AS file, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT NULL, count(*) FROM documents",
    "corpus_purge": "SELECT source AS file, count(*) AS n FROM documents WHERE source NOT LIKE 'src1_' GROUP BY source",
    "corpus_lifecycle": f"""
        WITH RECURSIVE {_chunked(f"{_LINES}, b AS (SELECT doc_id, 1 AS section, line_no AS i, n_tokens FROM lines)", 200)},
        n AS (SELECT source || '.' || d.doc_id AS file, max(chunk_no) AS n, source LIKE 'src1_' AS gone FROM f JOIN documents d ON d.doc_id = f.doc_id GROUP BY ALL),
        g AS (SELECT coalesce(sum(n) FILTER (gone), 0)::BIGINT AS purged FROM n)
        SELECT file, n::BIGINT AS n, purged FROM n, g WHERE NOT gone UNION ALL SELECT NULL, sum(n)::BIGINT, any_value(purged) FROM n, g WHERE NOT gone
    """,
    "bm25_top50": _BM25,
    "bm25_postings": _BM25,
    "two_stage_rerank": f"WITH {_RERANK} SELECT doc_id, distance, reranker, rnk FROM best WHERE rnk <= 50",
    "prompt_context": f"""
        WITH {_RERANK}, p AS (SELECT 'Context:' || chr(10) || string_agg('[[CHUNK (ID: "' || doc_id || '")' || chr(10) || 'Texte:' || chr(10) || rtrim(text, chr(10)) || chr(10) || ']]' || chr(10) || chr(10), '' ORDER BY rnk)
            || 'Voici les questions :' || chr(10) || 'the that trash' AS prompt FROM best WHERE rnk <= 10)
        SELECT prompt, {_COUNT.format("prompt")}::INT AS n_tokens FROM p
    """,
    "request_json": "SELECT item_id, text AS content, 'some-model' AS model, item_id::VARCHAR AS answer FROM benchmark",
    "map_reduce_answers": """
        WITH a AS (SELECT conv_id, turn, (length('Who?' || chr(10) || 'Answer in full detail from the following text alone, without a summary:' || chr(10)) + length(coalesce(text, '')))::VARCHAR AS a FROM conversations)
        SELECT conv_id, (length('Who?' || chr(10) || 'Answer in full detail from the following text alone:' || chr(10)) + length(string_agg(a, chr(10) ORDER BY turn)))::VARCHAR AS answer FROM a GROUP BY conv_id
    """,
    "embed_cache_key": "SELECT doc_id, sha256('hashing' || chr(10) || '1' || chr(10) || text) AS k FROM documents",
    "embed_cache_miss": """
        WITH known AS (SELECT text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)),
        m AS (SELECT count(*) AS n_miss, count(DISTINCT text) AS n_distinct_miss FROM documents WHERE text NOT IN (SELECT text FROM known))
        SELECT n_miss, n_distinct_miss, (SELECT count(*) FROM documents) AS n_total FROM m
    """,
    "embed_docs": f"""
        SELECT doc_id, {", ".join(f"round(e[{i + 1}]::FLOAT, 5)::DOUBLE AS e{i}" for i in range(8))}, 'hashing' AS model, true AS dated FROM {_hashed("text", "doc_id", "documents", 8)}
    """,
    "vocab_docfreq": f"WITH {_phrases(_QUOTES + _EMPHASIS)} SELECT phrase, count(*) AS df FROM sc GROUP BY phrase",
    "vocab_specificity": f"WITH {_phrases(_QUOTES + _EMPHASIS)} SELECT phrase, max(score)::DOUBLE AS score FROM sc GROUP BY phrase",
    "phrases_per_doc": f"""
        WITH {_phrases(_QUOTES)}
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(phrase) DESC, seen)::INT AS rnk, phrase, score::DOUBLE AS score FROM sc QUALIFY rnk <= 8
    """,
    "quoted_spans": f"WITH {_spans(_QUOTES + _EMPHASIS)} SELECT doc_id, phrase FROM spans",
    "keyword_list_parse": """
        WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a FROM part),
        e AS (SELECT p_partkey, i, a[i] AS keyword FROM (SELECT p_partkey, a, unnest(generate_series(1, len(a))) AS i FROM w)),
        d AS (SELECT p_partkey, i, keyword, row_number() OVER (PARTITION BY p_partkey, lower(keyword) ORDER BY i) AS nth FROM e WHERE keyword <> '')
        SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i)::INT AS pos, keyword FROM d WHERE nth = 1 QUALIFY pos <= 20
    """,
    "projector_labels": """
        SELECT array_to_string(list_transform(embedding, lambda x: round(x * 100)::INT), chr(9)) AS vector, CASE WHEN lower(text) LIKE '%the%' THEN 'the' ELSE 'autre' END AS label
        FROM documents JOIN embeddings ON doc_id = vec_id
    """,
    "image_text": """
        SELECT doc_id, '<IMAGE DESCRIPTION START>pas de description<IMAGE DESCRIPTION END> ' || text || ' <IMAGE DESCRIPTION START>pas de description<IMAGE DESCRIPTION END>' AS text FROM documents
    """,
    "images_described": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<IMAGE DESCRIPTION START>an image of ' || (22 + doc_id % 50 + 1) || ' signs<IMAGE DESCRIPTION END> ' ELSE '' END || text AS text FROM documents
    """,
    "chat_last_user": f"WITH {_USER} SELECT * FROM pr",
    "chat_templates": f"""
        WITH {_USER}, c AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT c.conv_id, coalesce(n_user, 0) AS n_user, CASE WHEN coalesce(n_user, 0) <= 1 THEN 1 ELSE 2 END AS template,
               CASE WHEN coalesce(n_user, 0) <= 1 THEN 'A ' || coalesce(request, 'raw') || '!' ELSE request END AS prompt FROM c LEFT JOIN u USING (conv_id)
        UNION ALL SELECT -1, 0, 1, 'A only a body!'
    """,
    "chat_history": f"""
        WITH {_KEPT}, a AS (SELECT DISTINCT conv_id, -1 AS turn, 'system' AS role, 'Answer from the context.' AS content FROM k UNION ALL SELECT * FROM k)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS pos, role, content FROM a
    """,
    "chat_context": f"""
        WITH {_KEPT}, n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS pos, role, content FROM k),
        e AS (SELECT n.conv_id, max(pos) AS e, any_value(many) AS many FROM n JOIN (SELECT conv_id, count(*) AS many FROM conversations GROUP BY conv_id) USING (conv_id) GROUP BY n.conv_id)
        SELECT * FROM n UNION ALL SELECT conv_id, e + 1, 'user', 'Context: of ' || many FROM e UNION ALL SELECT conv_id, e + 2, 'assistant', 'Understood.' FROM e
    """,
    "chat_slash": """
        SELECT conv_id, turn, 'set' AS cmd, 'name' || turn % 3 AS arg1, CASE WHEN turn % 4 = 0 THEN 'v' || turn END AS arg2, false AS open FROM conversations WHERE turn % 2 = 0
    """,
    "chat_variables": """
        WITH l AS (SELECT conv_id, turn % 3 AS n, max(turn) AS turn FROM conversations WHERE turn % 2 = 0 GROUP BY ALL)
        SELECT conv_id, string_agg('name' || n || '=v' || turn, ';' ORDER BY n) AS listing FROM l WHERE turn % 4 = 0 GROUP BY conv_id
    """,
    "chat_client_history": f"""
        WITH {_SAID} SELECT conv_id, turn, role, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM said)
        WHERE role IN ('user', 'assistant') AND text <> '' AND NOT (turn = last AND trim(text) LIKE '/%')
    """,
    "stream_fold": """
        SELECT conv_id, turn, text AS answer, CASE WHEN text = '' THEN 'hm' ELSE '' END AS thinking, turn % 5 > 0 AS done FROM conversations WHERE text IS NOT NULL
    """,
    "stream_terminated": """
        SELECT conv_id, turn, CASE WHEN turn % 5 > 0 THEN '{"message":{"content":"late"}}' ELSE '{"done":true}' END AS event FROM conversations WHERE text IS NOT NULL AND turn % 3 > 0
    """,
    "tool_rounds": "SELECT conv_id, turn, 'it has ' || length(coalesce(text, '')) AS answer, 4 AS n_messages FROM conversations",
    "jsonl_modes": """
        SELECT count(*) AS skipping, sum(turn)::BIGINT AS turns, count(*) AS processed, count(*) FILTER (turn % 5 = 0) AS errors,
               count(*) + 2 * count(*) FILTER (turn % 5 = 0) AS passing, count(*) FILTER (turn % 5 = 0) AS broken FROM conversations
    """,
    "text_functions": """SELECT item_id, text, '''' || replace(text, '''', '''"''"''') || '''' AS quoted, sha1(text) AS sha1 FROM benchmark""",
    **EXPECTED,
}
