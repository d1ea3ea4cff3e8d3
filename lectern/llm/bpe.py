"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the tokenizer's pattern, in whole slices at once.  Each piece that
isn't known yet is merged over a segment tree of its adjacent pairs: a leaf holds the pair's rank
and position, an inner node the least below it, so the root is the leftmost pair of lowest rank.
A merge changes three leaves, and each change climbs to the root in logarithmic time, until the
root says that no mergeable pair is left.  Pieces of like length climb side by side in one array;
a long piece has a tree of its own.

Ids of pieces met before are looked up by hash.  What a slice encodes to is decoded and compared
with its bytes; should two pieces ever share a hash, the slice is merged again without lookup.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked
from .kernel import as_string, range_hashes, slices

#: A vocabulary of token bytes and ranks, a pair to a line; its place is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest piece, in bytes, that is merged side by side with others.
SIDE_BY_SIDE = 256
#: Pieces that a worker remembers; beyond it starts anew.  It bounds memory and changes no result.
REMEMBERED = 400_000

_NONE = np.iinfo(np.int64).max


@cache
def _classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    table = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, name in ((0, "White_Space"), (1, "L"), (2, "N")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            table[a:b] = value
    return table


def pieces(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pieces of these texts begin, as byte positions, ascending.

    The pattern: an English contraction; a run of letters, of numbers or of other signs, each
    with one space before it; white space, of which a run leaves its last sign to what follows.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    if (data < 128).all():
        code, byte = data, np.arange(len(data))
        first = rows[:-1][np.diff(rows) > 0]
    else:
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        byte = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(byte, rows[:-1][np.diff(rows) > 0])
    n = len(code)
    kind = _classes()[code]
    text = np.zeros(n + 1, bool)
    text[first] = True
    text[n] = True
    run = text.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    at = np.flatnonzero(run[:n])
    end = np.append(at[1:], n)
    gap = kind[at] == 0
    a, b = at[gap], end[gap]
    inner = ~text[b]  # white space that something follows
    a, b = a[inner], b[inner]
    start[b - 1] = True
    joined = code[b - 1] == 32
    start[b[joined]] = False
    quote = np.flatnonzero(start & (code == 39))
    quote = quote[run[quote] & (quote + 1 < n)]
    quote = quote[~text[quote + 1]]
    if len(quote):
        one = code[quote + 1]
        two = np.where((quote + 2 < n) & ~text[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [*map(ord, "stmd")])
        long = ~short & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            q = q[q + size < n] + size
            start[q] = True
    return byte[start]


class Vocabulary:
    """Token bytes by id, and the pairs of ids that merge; an id is also its rank."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, i in ranks.items():
            tokens[i] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        self.single = np.array([ranks[bytes([i])] for i in range(256)])
        self.pairs = {
            (ranks[t[:k]] << 20) | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        # open addressing; a probe is one array look-up for all pairs at once
        self.mask = (1 << int(np.ceil(np.log2(len(self.pairs) * 4)))) - 1
        self.keys, self.merged = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int64)
        self.probes = 1
        for (key, i), p in zip(self.pairs.items(), self._place(np.array([*self.pairs])).tolist()):
            k = 1
            while self.keys[p] >= 0:
                p, k = (p + 1) & self.mask, k + 1
            self.keys[p], self.merged[p] = key, i
            self.probes = max(self.probes, k)

    def _place(self, key):
        return ((key ^ (key >> 20)) * 0x9E3779B1 >> 12) & self.mask

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id that each pair merges to, a very large number for none."""
        key = (left << 20) | right
        at = self._place(key)
        out = np.where(self.keys[at] == key, self.merged[at], _NONE)
        left_over = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(left_over):
                break
            at = at.copy()
            at[left_over] = (at[left_over] + 1) & self.mask
            found = self.keys[at[left_over]]
            hit = found == key[left_over]
            out[left_over[hit]] = self.merged[at[left_over[hit]]]
            left_over = left_over[~hit & (found >= 0)]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        size = np.diff(self.at)[ids]
        end = np.cumsum(size)
        if not len(end):
            return np.zeros(0, np.uint8)
        return self.bytes[np.repeat(self.at[ids] - (end - size), size) + np.arange(end[-1])]


@cache
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)


def merge_long(piece: bytes, v: Vocabulary) -> list[int]:
    """Ids of one piece by a segment tree of its own."""
    ids, n = [int(v.single[b]) for b in piece], len(piece)
    if n < 2:
        return ids
    size = 1 << (n - 1).bit_length()
    none, pairs = 1 << 62, v.pairs
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

    def leaf(i: int) -> int:
        j = after[i]
        r = pairs.get((ids[i] << 20) | ids[j]) if j < n else None
        return none if r is None else r * size + i

    tree = [none] * (2 * size)
    tree[size : size + n] = [leaf(i) for i in range(n)]
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        ids[i], after[i] = rank, after[j]
        if after[j] < n:
            before[after[j]] = i
        tree[size + j] = none
        changed = [j, i]
        tree[size + i] = leaf(i)
        if before[i] >= 0:
            tree[size + before[i]] = leaf(before[i])
            changed.append(before[i])
        for k in changed:
            k = (size + k) >> 1
            while k:
                x, y = tree[2 * k], tree[2 * k + 1]
                least = x if x < y else y
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_many(data: np.ndarray, start: np.ndarray, size: int, length: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in a row, ids per piece), the pieces no longer than ``size``, a power of two.

    Row r of every array belongs to piece r; a tree of 2 * size nodes begins at r * 2 * size.
    """
    n = len(start)
    slot = np.arange(size)
    ids = v.single[data[np.minimum(start[:, None] + slot, len(data) - 1)]].astype(np.int64)
    there = slot < length[:, None]
    tree = np.full((n, 2 * size), _NONE, np.int64)
    rank = v.merge(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
    mergeable = (rank < _NONE) & there[:, 1:]
    tree[:, size : 2 * size - 1] = np.where(mergeable, np.where(mergeable, rank, 0) * size + slot[:-1], _NONE)
    h = size // 2
    while h:
        np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2], out=tree[:, h : 2 * h])
        h //= 2
    tree, ids, there = tree.ravel(), ids.ravel(), there.ravel()
    after = np.tile(slot + 1, n)
    before = np.tile(slot - 1, n)
    live = np.arange(n)

    def settle(base: np.ndarray, leaf: np.ndarray) -> None:
        """Climbs from the changed leaves to the roots."""
        k = leaf >> 1
        for _ in range(size.bit_length() - 1):
            low = base + 2 * k
            tree[base + k] = np.minimum(tree[low], tree[low + 1])
            k >>= 1

    def pair(row: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = j < length[row]
        r = v.merge(ids[row * size + i], ids[row * size + np.minimum(j, size - 1)])
        good = inside & (r < _NONE)
        return np.where(good, np.where(good, r, 0) * size + i, _NONE)

    while True:
        root = tree[live * (2 * size) + 1]
        go = root < _NONE
        live, root = live[go], root[go]
        if not len(live):
            break
        i = root & (size - 1)
        at, base = live * size, live * (2 * size)
        j = after[at + i]
        k = after[at + j]
        ids[at + i] = root // size
        there[at + j] = False
        after[at + i] = k
        more = k < size
        before[at[more] + k[more]] = i[more]
        tree[base + size + j] = _NONE
        tree[base + size + i] = pair(live, i, k)
        settle(base, size + j)
        settle(base, size + i)
        h = before[at + i]
        has = h >= 0
        row, h = live[has], h[has]
        tree[base[has] + size + h] = pair(row, h, i[has])
        settle(base[has], size + h)
    return ids[there], there.reshape(n, size).sum(axis=1)


class Encoder:
    """Encodes slices of texts; remembers the ids of pieces."""

    def __init__(self, path: str = VOCABULARY):
        self.v = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.many = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def _merged(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, many, ids): where in ids each piece's are."""
        begin, many = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        out, total = [], 0
        size, least = 4, 0
        while least < SIDE_BY_SIDE:
            which = np.flatnonzero((length > least) & (length <= size))
            for part in np.array_split(which, max(1, len(which) * size >> 19)):
                if len(part):
                    ids, n = merge_many(data, start[part], size, length[part], self.v)
                    begin[part], many[part] = total + np.cumsum(n) - n, n
                    out.append(ids)
                    total += len(ids)
            size, least = size * 2, size
        for p in np.flatnonzero(length > SIDE_BY_SIDE):
            ids = merge_long(data[start[p] : start[p] + length[p]].tobytes(), self.v)
            begin[p], many[p] = total, len(ids)
            out.append(np.array(ids, np.int64))
            total += len(ids)
        return begin, many, np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these texts in a row, where each text's begin)."""
        start = pieces(data, rows)
        length = np.diff(np.append(start, len(data)))
        h = range_hashes(data)(start, start + length)
        new, first, where = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, new), max(len(self.known) - 1, 0))
        unknown = np.flatnonzero(self.known[at] != new) if len(self.known) else np.arange(len(new))
        if len(unknown):
            begin, many, ids = self._merged(data, start[first[unknown]], length[first[unknown]])
            if len(self.known) + len(unknown) > REMEMBERED and len(self.known):
                self._forget()
                return self.encode(data, rows)
            known = np.concatenate([self.known, new[unknown]])
            order = np.argsort(known, kind="stable")
            self.begin = np.concatenate([self.begin, begin + len(self.ids)])[order]
            self.many = np.concatenate([self.many, many])[order]
            self.known, self.ids = known[order], np.concatenate([self.ids, ids])
            at = np.searchsorted(self.known, new)
        got = at[where] if len(new) else where
        out, ends = self._gathered(self.begin[got], self.many[got], self.ids)
        if not np.array_equal(self.v.decode(out), data):
            begin, many, ids = self._merged(data, start, length)
            out, ends = self._gathered(begin, many, ids)
        bounds = np.concatenate([[0], ends])[np.searchsorted(start, rows)]
        return out, bounds

    @staticmethod
    def _gathered(begin: np.ndarray, many: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        return ids[np.repeat(begin - (ends - many), many) + np.arange(total)], ends


@cache
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder to each worker and vocabulary, so that pieces are remembered across batches."""
    return Encoder(path)


def encoded(texts: pa.Array, path: str = VOCABULARY) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, where each row's begin), covering all rows in order."""
    e = encoder(path)
    for a, b, data, rows in slices(as_string(texts)):
        yield a, b, *e.encode(data, rows)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        null = texts.is_null().to_numpy(zero_copy_only=False)
        for a, b, ids, bounds in encoded(texts, path):
            bounds = pa.array(bounds.astype(np.int32), mask=np.append(null[a:b], False))
            lists = pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], lists], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``: the token ids of its whole text.

    A null text has null ids, an empty one an empty list.  Equal texts have equal ids, and rows
    that repeat a doc_id stay rows of their own.  Bytes that merge with nothing stay single ids,
    so every text can be encoded.
    """
    rows = picked(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda it: _encoded(it, path), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for batch in batches:
        lists = batch.column("ids")
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        data = v.decode(ids).tobytes()
        at = np.concatenate([[0], np.cumsum(np.diff(v.at)[ids])])[np.concatenate([[0], np.cumsum(n)])]
        # ids that end within a character decode to the replacement sign there
        texts = [data[x:y].decode(errors="replace") if ok else None for x, y, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the inverse of ``encode``; null ids give a null text."""
    rows = picked(encoded, doc_id="doc_id", ids="ids").select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(lambda it: _decoded(it, path), "doc_id long, text string")
