"""Personal data: transducers that undo disguises and remember where every character came from.

A text goes through three transducers, each of which rewrites some spans and composes its
offsets with those of the one before:

1. look-alikes: full-width and styled letters, digits of any script, Cyrillic and Greek letters
   that look Latin become ASCII; zero-width signs vanish;
2. addresses: "(at)", "[dot]", " at ", " dot " and the like become '@' and '.', where they stand
   within an address;
3. spelled digits: runs of at least three digit words (English, French, German, Spanish) become
   digits.

Identifiers are found in the result, and their spans are mapped back to the source's characters.
Texts that hold none of the signs that an identifier or a disguise needs are not rewritten.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, picked, positional, restored
from .kernel import Words, as_string, slices, word_hash

_LATIN = dict(zip("аеорсухіјѕԁһԛԝѵАВЕКМНОРСТУХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwvABEKMHOPCTYXIJSaopvikABEZHIKMNOPTYX"))
_GONE = "­​‌‍⁠﻿"


@cache
def look_alikes() -> tuple[re.Pattern, dict[int, str]]:
    """A pattern of the characters that the first transducer rewrites, and what they become."""
    table = {ord(a): b for a, b in _LATIN.items()} | {ord(c): "" for c in _GONE}
    for i in range(128, sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Nd":
            table[i] = str(unicodedata.digit(c))
        elif kind[0] in "LNPS" and i not in table:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii() and plain != c and c not in "ªº":
                table[i] = plain
    codes = sorted(table)
    cut = [k for k in range(len(codes)) if not k or codes[k] != codes[k - 1] + 1] + [len(codes)]
    ranges = "".join(f"\\U{codes[a]:08x}-\\U{codes[b - 1]:08x}" for a, b in zip(cut, cut[1:]))
    return re.compile(f"[{ranges}]"), table


_DIGITS = {
    word: str(d)
    for d, words in enumerate(
        (
            "zero oh zéro null cero", "one un une eins ein uno una", "two deux zwei zwo dos", "three trois drei tres", "four quatre vier cuatro",
            "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve",
        )
    )
    for word in words.split()
}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_BETWEEN = r"[\s,.\-]{1,3}"
#: What makes a short spelled number one that identifies: such a word, one to three words before it.
_CUE = (
    r"(?:call|phone|telephone|tel|dial|text|fax|ext|extension|pin|code|passcode|password|numéro|téléphone|appelez|composez|mot de passe|"
    r"nummer|telefon|ruf|rufen|kennwort|número|teléfono|llama|llame|marque|clave|contraseña)"
)
_SPELLED = re.compile(rf"(?:\b(?P<cue>{_CUE})\b(?:[\s:,.\-]{{1,3}}[^\W\d_]+){{0,2}}?[\s:,.\-]{{1,3}})?\b(?P<digits>{_WORD}(?:{_BETWEEN}{_WORD}){{2,}})\b", re.I)
_EACH = re.compile(_WORD, re.I)

# Each pattern begins with a sign or a word, and white space around it is taken along afterwards:
# a pattern that began with white space would try every place within a long run of it.
_DOT_WORDS = r"(?:dot|point|punkt|punto|\.)"
_AT = re.compile(r"(?P<sure>[\[({<]\s*(?:at|arroba|chez|@)\s*[\])}>])|(?P<bare>(?<=[\s_\-])at(?=[\s_\-]))|(?P<plain>@)", re.I)
_DOT = re.compile(rf"(?P<sure>[\[({{<]\s*{_DOT_WORDS}\s*[\])}}>])|(?P<bare>(?<=\s)dot(?=\s))|(?P<plain>\.)", re.I)
#: A label after a plain stop must follow at once, or the next sentence would join the domain.
_DOMAIN = re.compile(rf"[a-z0-9\-]+(?:(?:\s*[\[({{<]\s*{_DOT_WORDS}\s*[\])}}>]\s*|\s+dot\s+|\.)[a-z0-9\-]+)+", re.I)

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERNS = [
    ("EMAIL", re.compile(r"(?<![\w.+\-])[\w+\-][\w.+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")),
    ("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("CARD", re.compile(r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)")),
    ("IP", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)")),
    ("SSN", re.compile(r"(?<![\d\-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d\-])")),
    ("PHONE", re.compile(r"(?<![\d+])\+\d{1,3}[\s.\-]?(?:\(\d{1,4}\)[\s.\-]?)?\d(?:[\s.\-]?\d){5,12}(?!\d)|(?<!\d)\(\d{3}\)[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\d)|(?<![\d\-.])\d{3}([\-. ])\d{3}\1\d{4}(?![\d\-])")),
]
#: Digits of a telephone number: seven without an area, and at most fifteen by E.164.
TELEPHONE = range(7, 16)


def spelled_kind(digits: str, cue: bool) -> str | None:
    """What a spelled number is: a telephone number by its length, a longer one an account's, a shorter one only after a cue."""
    if len(digits) in TELEPHONE:
        return "PHONE"
    return "NUMBER" if cue or len(digits) >= TELEPHONE.stop else None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, value: str) -> bool:
    if kind == "CARD":
        digits = re.sub(r"\D", "", value)
        return len(set(digits)) > 1 and luhn(digits)
    if kind == "IBAN":
        plain = value.replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


class Rewritten:
    """A text and, of each of its characters, the span of the source that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.begin: np.ndarray | None = None  # none: nothing was rewritten
        self.end: np.ndarray | None = None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint ascending spans; every character of a replacement stands for all of its span."""
        if not edits:
            return
        if self.begin is None:
            self.begin, self.end = np.arange(len(self.text)), np.arange(1, len(self.text) + 1)
        at, texts, begins, ends = 0, [], [], []
        for a, b, new in edits:
            texts += [self.text[at:a], new]
            begins += [self.begin[at:a], np.full(len(new), self.begin[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        self.text = "".join([*texts, self.text[at:]])
        self.begin, self.end = np.concatenate([*begins, self.begin[at:]]), np.concatenate([*ends, self.end[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (int(self.begin[a]), int(self.end[b - 1]))


def _plain_letters(r: Rewritten) -> None:
    pattern, table = look_alikes()
    r.rewrite([(m.start(), m.end(), table[ord(m[0])]) for m in pattern.finditer(r.text)])


def _around(text: str, m: re.Match) -> tuple[int, int]:
    """The span of a match with the white space around it; a bare word may have a '_' or '-' there instead."""
    a, b = m.span()
    if m["bare"] and not text[a - 1].isspace():
        a -= 1
    else:
        while a and text[a - 1].isspace():
            a -= 1
    if m["bare"] and not text[b].isspace():
        b += 1
    else:
        while b < len(text) and text[b].isspace():
            b += 1
    return a, b


def _word_begin(text: str, end: int) -> int:
    while end and (text[end - 1].isalnum() or text[end - 1] in "_+-"):
        end -= 1
    return end


def _addresses(r: Rewritten) -> None:
    text = r.text
    edits: list[tuple[int, int, str]] = []
    dots: dict[int, int] | None = None  # where the disguised and plain dots end, and begin
    for m in _AT.finditer(text):
        at, after = _around(text, m)
        domain = _DOMAIN.match(text, after)
        if not domain:
            continue
        inner = [(d.span() if d["plain"] else _around(text, d), d["plain"]) for d in _DOT.finditer(text, after, domain.end())]
        if m["bare"] and all(plain for _, plain in inner):
            continue
        if dots is None:
            dots = {}
            for d in _DOT.finditer(text):
                a, b = d.span() if d["plain"] else _around(text, d)
                dots[b] = a
        low = edits[-1][1] if edits else 0
        begin, before = _word_begin(text, at), []
        if begin == at or at <= low:
            continue
        while begin in dots and dots[begin] >= low and (word := _word_begin(text, dots[begin])) < dots[begin]:
            before.append((dots[begin], begin))
            begin = word
        edits += [(a, b, ".") for a, b in reversed(before) if text[a:b] != "."]
        if text[at:after] != "@":
            edits.append((at, after, "@"))
        edits += [(*span, ".") for span, plain in inner if not plain]
    r.rewrite(edits)


def _spelled(r: Rewritten) -> list[tuple[int, int, str]]:
    """Rewrites runs of digit words; where they are in the result, and what they are."""
    runs, edits, moved = [], [], 0
    for m in _SPELLED.finditer(r.text):
        a, b = m.span("digits")
        new = "".join(_DIGITS[w[0].lower()] for w in _EACH.finditer(m["digits"]))
        edits.append((a, b, new))
        if kind := spelled_kind(new, bool(m["cue"])):
            runs.append((a + moved, a + moved + len(new), kind))
        moved += len(new) - (b - a)
    r.rewrite(edits)
    return runs


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, begin, end, value) of the identifiers in a text, disjoint and ascending.

    Positions count the source's characters; ``value`` is the identifier without disguise.
    """
    r = Rewritten(text)
    if not text.isascii():
        _plain_letters(r)
    _addresses(r)
    runs = _spelled(r)
    found = []
    for rank, (kind, pattern) in enumerate(_PATTERNS):
        found += [(m.start(), -m.end(), rank, kind) for m in pattern.finditer(r.text) if _valid(kind, m[0])]
    found += [(a, -b, len(_PATTERNS), kind) for a, b, kind in runs]
    out, at = [], 0
    for a, b, _, kind in sorted(found):
        if a >= at:
            at = -b
            out.append((kind, *r.source(a, at), r.text[a:at]))
    return out


def masked(text: str) -> str:
    """The text with each identifier replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b, _ in find(text):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]]) if at else text


@cache
def _hashes(words: str) -> np.ndarray:
    return np.sort(np.array([word_hash(w) for w in words.split()], np.uint64))


#: White space beyond ASCII.
_WIDE = re.compile(r"[^\S\x00-\x7f]")
_SIGNS, _BRACKETS = (np.isin(np.arange(256), [*map(ord, x)]) for x in ("0123456789@", "[({<"))


def suspects(texts: pa.Array) -> np.ndarray:
    """Of each text whether it has any sign of an identifier; of one that hasn't, ``find`` finds nothing.

    Signs: a digit or '@'; three digit words in a row; the word "dot"; a word for '@' and a
    bracket; a character that the first transducer rewrites; white space beyond ASCII, which the
    patterns take for a separator and ``Words`` for a part of a word.
    """
    out = np.zeros(len(texts), bool)
    low = as_string(texts, lower=True)
    digit, at, dot = _hashes(" ".join(_DIGITS)), _hashes("at arroba chez"), _hashes("dot")
    for a, b, data, rows in slices(low):
        w = Words(data, rows)
        h = w.hashes
        has = lambda table: np.isin(h, table)
        text = np.repeat(np.arange(b - a), w.counts)
        per = lambda hit: np.bincount(text[hit], minlength=b - a) > 0
        count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[rows]) > 0
        d = has(digit)
        three = np.zeros(len(h), bool)
        if len(h) > 2:
            three[2:] = d[2:] & d[1:-1] & d[:-2] & (text[2:] == text[:-2])
        out[a:b] = count(_SIGNS) | per(three) | per(has(dot)) | (per(has(at)) & count(_BRACKETS))
        beyond = np.flatnonzero(~out[a:b] & (np.diff(np.concatenate([[0], np.cumsum(data >= 128)])[rows]) > 0))
        for i in beyond:
            whole = texts[int(a + i)].as_py()
            out[a + i] = bool(look_alikes()[0].search(whole) or _WIDE.search(whole))
    return out


_FOUND = "array<struct<kind:string,begin:int,end:int,value:string>>"
_STRUCT = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def _find_all(texts: pa.Array) -> pa.Array:
    rows = [[dict(zip(("kind", "begin", "end", "value"), f)) for f in find(texts[i].as_py())] if s else [] for i, s in enumerate(suspects(texts))]
    return pa.array(rows, _STRUCT)


def _mask_all(texts: pa.Array) -> pa.Array:
    at = np.flatnonzero(suspects(texts))
    if not len(at):
        return texts
    new = pa.array([masked(texts[int(i)].as_py()) for i in at], texts.type)
    which = np.zeros(len(texts), bool)
    which[at] = True
    return pc.replace_with_mask(texts, pa.array(which), new)


def private_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, begin, end, value): a row for each identifier in each document.

    begin and end are character offsets in the source text, end exclusive.  Null and empty texts
    have none; time is linear in the text, however long its runs of white space.  Rows that repeat a doc_id or a text each have their own.
    """

    def spans(texts: pa.Array) -> pa.Array:
        return _find_all(texts)

    rows = picked(docs, doc_id="doc_id", text="text")
    found = rows.select("doc_id", F.explode(F.arrow_udf(spans, _FOUND)("text")).alias("s"))
    return found.select("doc_id", "s.kind", "s.begin", "s.end", "s.value")


def without_private(docs: DataFrame) -> DataFrame:
    """The documents with identifiers masked, columns as they were; n_chars, if any, follows the text.

    Null texts stay null; texts without identifiers stay as they are, character by character.
    """

    def mask(texts: pa.Array) -> pa.Array:
        return _mask_all(texts)

    at = f"c{column(docs, 'text')}"
    out = positional(docs).withColumn("masked", F.arrow_udf(mask, "string")(at))
    changed = ~F.col("masked").eqNullSafe(F.col(at))
    if "n_chars" in map(str.lower, docs.columns):
        n = f"c{column(docs, 'n_chars')}"
        out = out.withColumn(n, F.when(changed, F.length("masked").cast(out.schema[n].dataType)).otherwise(F.col(n)))
    return restored(out.withColumn(at, F.col("masked")), docs)
