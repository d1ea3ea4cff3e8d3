"""Markdown into blocks that stay whole, and blocks into chunks of a token budget, over Arrow batches.

A line is, in this order: a heading, the beginning of an HTML table, of an image description, of a
Markdown table, of a list, or a block by itself.  Lists, HTML tables and image descriptions take up
to two paragraphs before them along, so that what introduces them stays with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.tokens import by_slice

BUDGET = 200
OPEN, SHUT = "<IMAGE DESCRIPTION START>", "<IMAGE DESCRIPTION END>"

_HEADING = re.compile(r"(#{1,6})\s.")
_RULE = re.compile(r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$")  # of a stripped line
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
_INDENTED = re.compile(r"\s{2,}\S|\t")
_TABLE = re.compile(r"\s*<table\b", re.I)
_TABLES = re.compile(r"(<table\b)|</table\s*>", re.I)


def cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip().strip("|").split("|")]


def table_text(rows: list[str]) -> str:
    """A Markdown table's rows, the first its header, as 'name: value' lists; empty values are left out.

    A value beyond the header is named by its column's number; a table without values is its header.
    """
    names, out = cells(rows[0]), []
    for row in rows[1:]:
        pairs = [f"{names[k] if k < len(names) else f'col{k + 1}'}: {v}" for k, v in enumerate(cells(row)) if v]
        if pairs:
            out.append("; ".join(pairs))
    return "\n".join(["TABLE:", *(out or [" | ".join(names)])])


class Blocks:
    """The sections of a text: ``sections`` gives (titles in force by level, blocks) for each."""

    def __init__(self, text: str, compat: bool = True):
        self.lines, self.compat = text.splitlines(), compat
        self.blank = [not x or x.isspace() for x in self.lines]
        self.buffer: list[str] = []
        # where the paragraph of each line begins, and the last line with text before each line
        self.begin, self.text_before = [], []
        begin, last = 0, -1
        for i, blank in enumerate(self.blank):
            self.text_before.append(last)
            if blank:
                begin = i + 1
            else:
                last = i
            self.begin.append(begin)

    def sections(self) -> Iterator[tuple[tuple[str | None, ...], list[str]]]:
        titles: list[str | None] = [None] * 6
        at, lines = 0, self.lines
        while at < len(lines):
            line = lines[at]
            if head := _HEADING.match(line):
                if self.buffer:
                    yield tuple(titles), self.buffer
                    self.buffer = []
                level = len(head[1])
                titles[level - 1 :] = [line[level:].strip(), *[None] * (6 - level)]
                at += 1
            elif _TABLE.match(line):
                to = self._html_table(at)
                self._with_paragraphs(at, "\n".join(lines[at:to]))
                at = to
            elif OPEN in line:
                at = self._image(at)
            elif "|" in line and at + 1 < len(lines) and _RULE.match(lines[at + 1].strip()):
                to = at + 2
                while to < len(lines) and "|" in lines[to]:
                    to += 1
                self.buffer.append(table_text([line, *lines[at + 2 : to]]))
                at = to
            elif _ITEM.match(line):
                to = self._list(at)
                self._with_paragraphs(at, "\n".join(lines[at:to]))
                at = to
            else:
                self.buffer.append(line)
                at += 1
        if self.buffer:
            yield tuple(titles), self.buffer

    def _html_table(self, at: int) -> int:
        """The line after the table's last: where as many are shut as were opened, or the end."""
        depth = 0
        for to in range(at, len(self.lines)):
            depth += sum(1 if m[1] else -1 for m in _TABLES.finditer(self.lines[to]))
            if depth <= 0:
                return to + 1
        return len(self.lines)

    def _list(self, at: int) -> int:
        """The line after the list's last; a single blank line is the list's if it goes on after it."""
        goes_on = lambda i: i < len(self.lines) and bool(_ITEM.match(self.lines[i]) or _INDENTED.match(self.lines[i]))
        to = at
        while to < len(self.lines) and (goes_on(to) or (self.blank[to] and goes_on(to + 1))):
            to += 1
        return to

    def _pop_blanks(self) -> int:
        n = len(self.buffer)
        while self.buffer and not self.buffer[-1].strip():
            self.buffer.pop()
        return n - len(self.buffer)

    def _with_paragraphs(self, at: int, block: str) -> None:
        """Adds a block, joined to the one or two paragraphs before it where they are still buffered line by line."""
        ends = self.text_before[at]
        head = lambda i: bool(_HEADING.match(self.lines[i]) or _ITEM.match(self.lines[i]))
        if ends >= 0 and not head(ends):
            begin = self.begin[ends]
            before = self.text_before[begin]
            if before >= 0 and not head(before):
                begin = self.begin[before]
            many, popped = ends + 1 - begin, self._pop_blanks()
            if len(self.buffer) >= many and all(self.buffer[-k] == self.lines[ends + 1 - k] for k in range(1, many + 1)):
                del self.buffer[len(self.buffer) - many :]
                block = "\n".join([*self.lines[begin : ends + 1], *([""] if ends + 1 < at else []), block])
            else:
                self.buffer += [""] * popped
        self.buffer.append(block)

    def _image(self, at: int) -> int:
        """Adds the description that begins on this line, with what stands around it, as one block; the line after it."""
        lines, cut = self.lines, self.lines[at].index(OPEN)
        to, found = at, lines[at].find(SHUT, cut)
        while found < 0 and to + 1 < len(lines):
            to += 1
            found = lines[to].find(SHUT)
        block = "\n".join(lines[at : to + 1])
        popped, near = self._pop_blanks(), self._plain_tail(len(self.buffer))
        if near == len(self.buffer):
            self.buffer += [""] * popped
            self.buffer.append(block)
            return to + 1
        far = near
        while far and not self.buffer[far - 1].strip():
            far -= 1
        gap, far = far, self._plain_tail(far)
        if self.compat:  # a farther paragraph is taken along and yet stays, if blank lines are between
            lead = self.buffer[far:gap] + self.buffer[near:]
            del self.buffer[far if gap == near else near :]
        else:
            lead = self.buffer[far:] + ([""] if popped else [])
            del self.buffer[far:]
        self.buffer.append("\n".join([*lead, block]))
        return to + 1

    def _plain_tail(self, end: int) -> int:
        """Where the plain lines begin that stand before ``end`` in the buffer."""
        while end and self._plain(self.buffer[end - 1]):
            end -= 1
        return end

    @staticmethod
    def _plain(block: str) -> bool:
        low = block.strip().lower()
        return bool(low) and "\n" not in block and not _ITEM.match(block.strip()) and not low.startswith(("table:", "<table")) and OPEN.lower() not in low


def ends_of_chunks(sizes: np.ndarray, budget: int) -> list[int]:
    """Where greedy chunks of blocks end: each before the block that would take it over ``budget``, if it has any."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out, at = [], 0
    while at < len(sizes):
        at = max(at + 1, int(np.searchsorted(total, total[at] + budget, "right")) - 1)
        out.append(at)
    return out


def chunks(text: str, budget: int = BUDGET, compat: bool = True, empty: bool = True) -> Iterator[tuple[tuple[str | None, ...], str, int]]:
    """(titles by level, text, tokens) of a text's chunks, none of which crosses a heading."""
    for titles, blocks in Blocks(text, compat).sections():
        at = 0
        for to in ends_of_chunks(np.array([len(b.split()) for b in blocks]), budget):
            chunk = "\n".join(blocks[at:to]).strip()
            at = to
            if chunk or empty:
                yield titles, chunk, len(chunk.split())


_CHUNKS = "array<struct<titles:array<string>,text:string,tokens:int>>"
_TYPE = pa.list_(pa.struct([("titles", pa.list_(pa.string())), ("text", pa.string()), ("tokens", pa.int32())]))


def chunked(text: Column | str, budget: int = BUDGET, compat: bool = True, empty: bool = True) -> Column:
    """The chunks of each text in order; null for null, none for an empty text."""

    def each(texts: pa.Array) -> pa.Array:
        rows = lambda some: [None if t is None else [{"titles": h, "text": x, "tokens": n} for h, x, n in chunks(t, budget, compat, empty)] for t in some]
        return by_slice(texts, lambda some: pa.array(rows(some), _TYPE))

    return F.arrow_udf(each, _CHUNKS)(text)


def cuts(sizes: Column | str, budget: int = BUDGET) -> Column:
    """For each array of block sizes its greedy chunks, as an array of (tokens, blocks); null for null."""

    def each(lists: pa.Array) -> pa.Array:
        out: list[list[dict] | None] = []
        for x in lists.to_pylist():
            if x is None:
                out.append(None)
                continue
            ends = np.array([0, *ends_of_chunks(np.array(x, np.int64), budget)])
            total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[ends]
            out.append([{"tokens": t, "blocks": n} for t, n in zip(np.diff(total).tolist(), np.diff(ends).tolist())])
        return pa.array(out, pa.list_(pa.struct([("tokens", pa.int32()), ("blocks", pa.int32())])))

    return F.arrow_udf(each, "array<struct<tokens:int,blocks:int>>")(sizes)
