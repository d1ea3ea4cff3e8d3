"""Words of whole batches of texts at once: codes, counts, runs of words, over Arrow arrays and numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row

#: What parts keyword tokens, and search terms, of a lower-case text.
NO_KEYWORD, NO_TERM = "[^A-Za-zÀ-ÖØ-öø-ÿ0-9\\-]+", "[^a-zà-öø-ÿ0-9]+"
#: Texts are worked through in slices of about so many bytes, whatever a batch holds: what is made of a slice takes many times its bytes.
SLICE = 1 << 20


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts): slices of a batch, each of one text or of at most ``most`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        start = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, start + most, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def parts(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """``slices`` in which null counts as an empty text."""
    for at, some in slices(texts, most):
        yield at, pc.fill_null(some.cast(pa.large_string()), "")


def by_slice(texts: pa.Array, change: Callable[[list[str | None]], pa.Array]) -> pa.Array:
    """What ``change`` makes of a batch's texts, slice by slice."""
    out = [change(some.to_pylist()) for _, some in slices(texts)]
    return pa.concat_arrays(out) if out else change([])


def gathered(rows: Iterable[Row], most: int = SLICE) -> Iterator[list[Row]]:
    """Rows with a text, in lists whose texts have about ``most`` signs: a list ends with the row that reaches it."""
    held: list[Row] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.text or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, where each number is first): equal keys have equal numbers, from 0 in order of their first places."""
    number = pa.array(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.empty(int(number.max(initial=-1)) + 1, np.int64)
    first[number[::-1]] = np.arange(len(keys))[::-1]  # the first is written last
    return number, first


class Tokens:
    """The tokens of some texts: ``code`` of each, an index into ``words``, and the ``row`` that it is in."""

    def __init__(self, texts: pa.Array, separator: str):
        lists = pc.split_pattern_regex(texts, separator)
        flat = lists.flatten().dictionary_encode()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.rows = len(texts)
        self.words: pa.Array = flat.dictionary
        code, row = flat.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(self.rows), n)
        self.code, self.row = code.astype(np.int64), row
        self.only(pc.greater(pc.binary_length(self.words), 0).to_numpy(zero_copy_only=False))

    def only(self, keep: np.ndarray) -> None:
        """Leaves the tokens whose word is to be kept; codes stay as they are."""
        some = keep[self.code] if len(self.code) else np.zeros(0, bool)
        self.code, self.row = self.code[some], self.row[some]

    def content(self, stopwords: tuple[str, ...]) -> Tokens:
        """Leaves tokens of three signs or more that are neither stopwords nor all digits."""
        w = self.words
        digits = pc.match_substring_regex(w, "^[0-9]+$")
        stop = pc.is_in(w, value_set=pa.array(stopwords, w.type))
        good = pc.and_not(pc.and_not(pc.greater_equal(pc.utf8_length(w), 3), digits), stop)
        self.only(good.to_numpy(zero_copy_only=False))
        return self

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def of(self, word: str) -> np.ndarray:
        """How often each text has the word."""
        at = pc.index(self.words, pa.scalar(word, self.words.type)).as_py()
        return np.bincount(self.row[self.code == at], minlength=self.rows) if at >= 0 else np.zeros(self.rows, np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, how often, first place among all tokens) of each text's distinct words, by row and code."""
        many = max(1, len(self.words))
        key, first, count = np.unique(self.row * many + self.code, return_index=True, return_counts=True)
        return key // many, key % many, count, first

    def best(self, n: int) -> pa.Array:
        """Each text's ``n`` most frequent words, ties by first place."""
        row, code, count, first = self.distinct()
        order = np.lexsort((first, -count, row))
        row, code = row[order], code[order]
        begin = np.searchsorted(row, np.arange(self.rows))
        keep = np.arange(len(row)) - begin[row] < n
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=self.rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), self.words.take(pa.array(code[keep])).cast(pa.string()))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first token, key) of each run of ``n`` tokens within a text; equal keys, equal runs."""
        at = np.arange(max(0, len(self.code) - n + 1))
        at = at[self.row[at] == self.row[at + n - 1]] if len(at) else at
        key = self.code[at] if len(at) else at
        for k in range(1, n):
            key = numbered(key * max(1, len(self.words)) + self.code[at + k])[0]
        return self.row[at], at, key

    def phrases(self, longest: int, places: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(words, row, which, how often, first token, phrases) for runs of 1 to ``longest`` tokens.

        ``which`` indexes ``phrases``, the distinct ones; each text has each of its phrases once, by
        row and ``which``.  Without ``places`` there are no first tokens.
        """
        for n in range(1, longest + 1):
            row, at, key = self.runs(n)
            if not len(key):
                continue
            which, first = numbered(key)
            text = [self.words.take(pa.array(self.code[at[first] + k])) for k in range(n)]
            text = pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string())) if n > 1 else text[0]
            pairs = row * len(first) + which
            pair, count = np.unique(pairs, return_counts=True)
            where = np.zeros(0, np.int64)
            if places:
                where = np.empty(len(pair), np.int64)
                where[np.searchsorted(pair, pairs)[::-1]] = at[::-1]  # the first is written last
            yield n, pair // len(first), pair % len(first), count, where, text
