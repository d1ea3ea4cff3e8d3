"""Key phrases, vocabularies and keyword lists.

Runs of 1 to 3 content tokens are candidates; a run in quotes or emphasis, an entity or a noun
phrase adds to its score.  A document's candidates are worked out where the document is, so only
phrases with their partial counts are shuffled, once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from lectern.functions.text import STOPWORDS, cleaned_keyword, parsed_list
from lectern.functions.tokens import NO_KEYWORD, Tokens, by_slice, gathered, parts

QUOTES = (r'"([^"\n]{2,})"', r"“([^”\n]{2,})”", r"«\s*([^»\n]{2,})\s*»")
EMPHASIS = (r"\*\*([^*\n]{2,})\*\*", r"\*([^*\n]{2,})\*", r"__([^_\n]{2,})__", r"_([^_\n]{2,})_")
LONGEST, LEAST_SIGNS = 3, 3
QUOTED, NOUNS, ENTITY, NAMED, LONGER = 2.5, 1.5, 2.0, 3.0, 0.25
NAMES = frozenset(("ORG", "PRODUCT", "WORK_OF_ART", "MISC"))
CONTENT = frozenset(("NOUN", "PROPN", "ADJ"))

_MARKS = re.compile('["“«*_]')
_TOKEN = re.compile(NO_KEYWORD)
_STOP = frozenset(STOPWORDS)


def content_tokens(text: str) -> list[str]:
    """The content tokens of one text, as ``Tokens.content`` finds them for many."""
    return [t for t in _TOKEN.split(text.lower()) if len(t) >= 3 and t not in _STOP and not (t.isascii() and t.isdigit())]


def _signs(phrase: str) -> int:
    return len(phrase) - phrase.count(" ")


def marked(text: str, patterns: Iterable[str], tokens: Callable[[str], list[str]] = content_tokens) -> Iterator[str]:
    """What stands between marks, as 1 to 3 content tokens; by pattern, then by place."""
    for pattern in patterns if _MARKS.search(text) else ():
        for m in re.finditer(pattern, text):
            raw = m[1].strip()
            words = tokens(raw) if len(raw) > 1 else []
            if 0 < len(words) <= LONGEST and _signs(phrase := " ".join(words)) >= LEAST_SIGNS:
                yield phrase


class Scored(NamedTuple):
    """A batch's candidates, a row for each of a document's phrases."""

    row: np.ndarray
    phrase: pa.Array
    score: np.ndarray
    seen: np.ndarray  # the order in which a document's phrases come up


def _candidates(texts: pa.Array, patterns: tuple[str, ...], places: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(row, which, score, seen, phrases) for the candidates of 1 to LONGEST tokens; ``which`` indexes ``phrases``, the distinct ones.

    Content tokens have LEAST_SIGNS signs, so every run has enough of them.
    """
    low = pa.array([t.lower() for t in texts.to_pylist()], pa.large_string())
    spans: list[tuple[int, str, int]] = []
    if patterns:
        some = pc.match_substring_regex(texts, _MARKS.pattern).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(some).tolist():
            spans += [(i, phrase, k) for k, phrase in enumerate(marked(texts[i].as_py(), patterns))]
    begin = max((k for _, _, k in spans), default=0) + 1
    tokens = Tokens(low, NO_KEYWORD).content(STOPWORDS)
    for n, row, which, count, first, phrases in tokens.phrases(LONGEST, places):
        score, order = count + LONGER * (n - 1), begin + n * len(tokens.code) + first  # no order without places
        mine = [s for s in spans if s[1].count(" ") == n - 1]
        if mine:
            code = pc.index_in(pa.array([s[1] for s in mine], phrases.type), value_set=phrases).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(row * len(phrases) + which, np.array([s[0] for s in mine]) * len(phrases) + code)
            np.add.at(score, at, QUOTED)
            if places:
                np.minimum.at(order, at, np.array([s[2] for s in mine]))
        yield row, which, score, order, phrases


def scored(texts: pa.Array, patterns: tuple[str, ...]) -> Scored:
    """All candidates of some texts: a point for each run, QUOTED for each that stands between marks."""
    rows, names, scores, seen = [np.zeros(0, np.int64)], [pa.array([], pa.large_string())], [np.zeros(0)], [np.zeros(0, np.int64)]
    for row, which, score, order, phrases in _candidates(texts, patterns):
        rows.append(row)
        names.append(phrases.take(pa.array(which)))
        scores.append(score)
        seen.append(order)
    return Scored(np.concatenate(rows), pa.concat_arrays(names), np.concatenate(scores), np.concatenate(seen))


#: Bytes of texts whose phrases are counted together: larger slices have fewer partial counts.
COUNTED = 4 << 20
#: Bytes of texts whose phrases, some 300,000 a MB, make a partition.
GATHERED = 8 << 20


def _partial(docs: DataFrame, kind: str, count: Callable[[pa.Array], Iterator[tuple[pa.Array, np.ndarray]]]) -> DataFrame:
    """(phrase, n): what ``count`` says of each slice's phrases, once for each slice, in partitions by phrase.

    Nearly every phrase of three words is new, so counts are not put together again before they are shuffled:
    that would hold a task's whole vocabulary and shuffle as much.  There are as many partitions as
    the texts, whose bytes are counted first, have phrases for.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in parts(batch.column(0), COUNTED):
                for phrases, n in count(texts):
                    yield pa.RecordBatch.from_arrays([phrases.cast(pa.string()), pa.array(n)], ["phrase", "n"])

    texts = docs.select("text").where("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    return texts.mapInArrow(each, f"phrase string, n {kind}").repartition(1 + size // GATHERED, "phrase")


def document_frequency(docs: DataFrame, patterns: tuple[str, ...] = QUOTES + EMPHASIS) -> DataFrame:
    """(phrase, df): in how many rows each phrase is; rows of equal texts count one by one.

    What stands between marks is a run of tokens anyway, so ``patterns`` change nothing.
    """

    def count(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for _, which, _, _, phrases in _candidates(texts, (), False):
            yield phrases, np.bincount(which, minlength=len(phrases)).astype(np.int64)

    return _partial(docs, "long", count).groupBy("phrase").agg(F.sum("n").alias("df"))


def specificity(docs: DataFrame, patterns: tuple[str, ...] = QUOTES + EMPHASIS) -> DataFrame:
    """(phrase, score): each phrase's best score in any document."""

    def best(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for _, which, score, _, phrases in _candidates(texts, patterns, False):
            most = np.zeros(len(phrases))
            np.maximum.at(most, which, score)
            yield phrases, most

    return _partial(docs, "double", best).groupBy("phrase").agg(F.max("n").alias("score"))


def vocabulary(docs: DataFrame, order: str = "freq") -> DataFrame:
    """All phrases in order: by 'freq' in how many documents they are, by 'specificity' their best score;
    longer ones first among equals, and then by themselves."""
    found, by = {"freq": (document_frequency, "df"), "specificity": (specificity, "score")}[order]
    return found(docs).orderBy(F.desc(by), F.desc(F.length("phrase")), "phrase")


_RANKED = "array<struct<phrase:string,score:double>>"
_RANKED_TYPE = pa.list_(pa.struct([("phrase", pa.string()), ("score", pa.float64())]))


def _best(texts: pa.Array, most: int, patterns: tuple[str, ...]) -> pa.Array:
    out = []
    for _, part in parts(texts):
        found = scored(part, patterns)
        length = pc.utf8_length(found.phrase).to_numpy(zero_copy_only=False)
        order = np.lexsort((found.seen, -length, -found.score, found.row))
        row = found.row[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < most
        order = order[keep]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(part)))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([found.phrase.take(pa.array(order)).cast(pa.string()), pa.array(found.score[order])], ["phrase", "score"])
        out.append(pa.ListArray.from_arrays(pa.array(bounds), pairs))
    return pa.concat_arrays(out) if out else pa.array([], _RANKED_TYPE)


def key_phrases(docs: DataFrame, least: int = 6, most: int = 8, patterns: tuple[str, ...] = QUOTES, id: str = "doc_id") -> DataFrame:
    """(id, rnk, phrase, score): each document's best phrases, ``most`` of them, or ``least`` if that is more.

    By score, then length, then first occurrence.  A document without candidates has no row.

    Spark gives rows to Python in blocks that it ends by their bytes, some MB, while an Arrow batch
    holds 10,000 texts or 64 MB of them; so a worker's memory follows neither a task's texts nor their size.
    """
    many = max(least, most)
    kept = docs.select(F.col(id).alias("id"), "text")

    def best(rows: Iterable[Row]) -> Iterator[tuple]:
        for some in gathered(rows):
            ranked = _best(pa.array([r.text for r in some], pa.string()), many, patterns).to_pylist()
            for row, phrases in zip(some, ranked, strict=True):
                for at, p in enumerate(phrases):
                    yield row.id, at + 1, p["phrase"], p["score"]

    schema = StructType([StructField(id, kept.schema["id"].dataType), StructField("rnk", IntegerType()), StructField("phrase", StringType()), StructField("score", DoubleType())])
    return docs.sparkSession.createDataFrame(kept.rdd.mapPartitions(best), schema, verifySchema=False)


def marked_spans(docs: DataFrame, patterns: tuple[str, ...] = QUOTES + EMPHASIS, id: str = "doc_id") -> DataFrame:
    """(id, phrase): a row for each span in quotes or emphasis that has 1 to 3 content tokens."""

    def spans(texts: pa.Array) -> pa.Array:
        return by_slice(texts, lambda some: pa.array([[*marked(t or "", patterns)] for t in some], pa.list_(pa.string())))

    return docs.select(id, F.explode(F.arrow_udf(spans, "array<string>")("text")).alias("phrase"))


class Token(NamedTuple):
    """A token as a language model annotates it."""

    text: str
    lemma: str = ""
    pos: str = "NOUN"
    stop: bool = False
    apart: bool = False  # white space, punctuation, a quote, or like a number


class Annotated(NamedTuple):
    tokens: list[Token]
    entities: list[tuple[int, int, str]] = []  # from token, to token, label
    nouns: list[tuple[int, int]] = []


class Annotator(Protocol):
    """A language model, made once for each task and given whole texts."""

    def annotate(self, text: str) -> Annotated: ...


class Plain:
    """The annotator without a model: content tokens are nouns, and there are neither entities nor noun phrases."""

    def annotate(self, text: str) -> Annotated:
        return Annotated([Token(t) for t in content_tokens(text)])


def normalized(tokens: Iterable[Token]) -> list[str]:
    """Lower-case lemmas of the tokens that carry content."""
    kept = (t for t in tokens if not t.apart and not t.stop and (t.pos in CONTENT or t.text.isalpha()))
    return [w for t in kept if (w := (t.lemma or t.text).strip().lower())]


def annotated_phrases(text: str, annotator: Annotator, patterns: tuple[str, ...]) -> list[tuple[str, float]]:
    """(phrase, score) of one text, best first, with entities and noun phrases."""
    if not text.strip():
        return []
    a, weights = annotator.annotate(text), {}

    def add(words: list[str], weight: float) -> None:
        if 0 < len(words) <= LONGEST and _signs(phrase := " ".join(words)) >= LEAST_SIGNS:
            weights[phrase] = weights.get(phrase, 0.0) + weight

    content = lambda tokens: [t for t in tokens if t.pos in CONTENT and not t.stop and not t.apart]
    for begin, end, label in a.entities:
        add(normalized(a.tokens[begin:end]), NAMED if label.upper() in NAMES else ENTITY)
    for begin, end in a.nouns:
        add(normalized(content(a.tokens[begin:end]))[:LONGEST], NOUNS)
    for phrase in marked(text, patterns, lambda raw: normalized(annotator.annotate(raw).tokens)):
        add(phrase.split(" "), QUOTED)
    tokens = content(a.tokens)
    for n in range(1, LONGEST + 1):
        for at in range(len(tokens) - n + 1):
            add(normalized(tokens[at : at + n]), 1.0)
    scored = [(p, w + LONGER * p.count(" ")) for p, w in weights.items()]
    return sorted(scored, key=lambda x: (-x[1], -len(x[0])))


def annotated_key_phrases(docs: DataFrame, annotator: Callable[[], Annotator], least: int = 6, most: int = 8, patterns: tuple[str, ...] = QUOTES, id: str = "doc_id") -> DataFrame:
    """``key_phrases`` with an annotator, which is made once for each batch of Arrow data."""
    many = max(least, most)

    def best(texts: pa.Array) -> pa.Array:
        model = annotator()
        return pa.array([[{"phrase": p, "score": s} for p, s in annotated_phrases(t or "", model, patterns)[:many]] for t in texts.to_pylist()], _RANKED_TYPE)

    return docs.select(id, F.posexplode(F.arrow_udf(best, _RANKED)("text")).alias("at", "p")).select(id, (F.col("at") + 1).alias("rnk"), "p.phrase", "p.score")


def listed_keywords(reply: Column, most: int = 20) -> Column:
    """The list within a reply, cleaned, without repeats in any case, at most ``most``; empty without a list."""
    cleaned = F.filter(F.transform(parsed_list(reply), cleaned_keyword), lambda k: k != "")
    # of each lower-case form the first stays; a reply's list is short
    pairs = F.transform(cleaned, lambda k: F.struct(k.alias("k"), F.lower(k).alias("low")))
    first = F.aggregate(
        pairs, F.expr("cast(array() as array<struct<k:string,low:string>>)"),
        lambda done, x: F.when(F.exists(done, lambda y: y["low"] == x["low"]) | (F.size(done) >= most), done).otherwise(F.concat(done, F.array(x))),
    )
    return F.coalesce(F.transform(first, lambda x: x["k"]), F.expr("cast(array() as array<string>)"))
