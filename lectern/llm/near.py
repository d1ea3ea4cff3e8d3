"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document is its sequence of lower-cased words.  Each of its runs of K words is labelled with
its occurrence number; a sketch takes the ELL labelled runs that are least under one hash and
keeps them in text order, so that two documents share a sketch with a probability that follows
their edit similarity (Marcais, DeBlasio, Pandey and Kingsford, Bioinformatics 35, 2019).

Two documents are near copies if 1 - (word edit distance) / (longer length) >= ``threshold``.
Groups are the connected components of near copies; each keeps the member of least id.

Candidates share a sketch, or are texts of up to ``SHORT`` words, which have too few runs for
sketches, and share one of their rarest words: near copies have all but a quarter of their words in
common, so of each one's words, rarest first, one among the first n - ceil(threshold * n) + 1 is in
both, and no near copy is missed.  All that share one are first aligned with its least member, a pair
each; then, wherever members still lie in different components, every such pair is aligned too,
unless lengths or word counts rule it out, which bound the edit distance from below.  So large
groups of copies cost one alignment per member and sketch, and no candidate is dropped.  A key that
many share is cut into blocks, and pairs of blocks are compared side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, one_of_each, picked, written
from .kernel import Words, as_string, list_array, mix, shingles, slices
from .spans import sieve

K, ELL, SKETCHES, THRESHOLD = 3, 2, 48, 0.75
#: Most words of the texts whose candidates are exact.
SHORT = 32
#: Of a row's runs so many are looked at first when its least are sought; which are found doesn't depend on it.
_LIKELY = 16
#: Members of a key that are compared with each other, or with so many others, in one group of rows.
BLOCK = 2_000
_SEED = np.uint64(0xD6E8FEB86659FD93)


def order_sketches(h: np.ndarray, first: np.ndarray, k: int, ell: int, sketches: int) -> np.ndarray:
    """Order-MinHash sketches of the word sequences ``h`` cut at ``first``: uint64[rows, sketches]."""
    runs, begin = shingles(h, first, k)
    n = np.diff(begin)
    out = np.zeros((len(n), sketches), np.uint64)
    full = n > 0
    if not full.any():
        return out
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((runs, row))
    r, w = runs[order], row[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
    index = np.arange(len(order))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = index - np.maximum.accumulate(np.where(new, index, 0))
    labelled = mix(runs + occurrence * _SEED)
    many = n[full]
    short = np.repeat(np.arange(len(many)), many)  # row among those with runs
    limit = np.where(many > _LIKELY, np.minimum(2.0**64 * _LIKELY / many, 2.0**64 - 4096), 2.0**64 - 4096).astype(np.uint64)
    limit[many <= _LIKELY] = np.iinfo(np.uint64).max
    limit = np.repeat(limit, many)
    for j in range(sketches):
        v = mix(labelled ^ mix(np.array([j + 1], np.uint64) * _SEED))
        at = np.flatnonzero(v <= limit)
        found = np.bincount(short[at], minlength=len(many))
        few = found < np.minimum(ell, many)
        if few.any():
            at = np.flatnonzero((v <= limit) | few[short])
            found = np.bincount(short[at], minlength=len(many))
        at = at[np.lexsort((v[at], short[at]))]
        # a row with fewer than ell runs repeats one of them; its sketch is then all of it
        least = at[(np.cumsum(found) - found)[:, None] + np.minimum(np.arange(ell), found[:, None] - 1)]
        least.sort(axis=1)
        key = np.full(len(many), j, np.uint64)
        for i in range(ell):
            key = mix(key + labelled[least[:, i]])
        out[full, j] = key
    return out


def labelled_words(h: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each row of at most ``most``, told apart by their occurrence, and where each row's begin."""
    n = np.diff(first)
    n = np.where(n <= most, n, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    x = h[np.repeat(first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])]
    order = np.lexsort((x, row))
    x, w = x[order], row[order]
    index = np.arange(len(x))
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (w[1:] != w[:-1])
    occurrence = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(np.uint64)
    return mix(x + (occurrence + np.uint64(1)) * _SEED), bounds


def word_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each row's words fall in each of 256 classes: uint8[rows, 256], 255 for more."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    return np.minimum(np.bincount(row * 256 + (h & np.uint64(255)).astype(np.int64), minlength=n * 256), 255).astype(np.uint8).reshape(n, 256)


def sequences(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each row's word sequence: uint64[rows, 2]."""
    room = np.arange(len(h), dtype=np.uint64)
    place = mix(room - np.repeat(first[:-1], np.diff(first)).astype(np.uint64))
    parts = []
    for seed in (1, 2):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ mix(place + np.uint64(seed))), out=total[1:])
        parts.append(mix(total[first[1:]] - total[first[:-1]] + np.uint64(seed)))
    return np.stack(parts, axis=1)


def _prepared(batches: Iterator[pa.RecordBatch], k: int, ell: int, sketches: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_string(batch.column("text"), lower=True)
        for a, b, data, rows in slices(texts):
            w = Words(data, rows)
            h = w.hashes
            node = sequences(h, w.first).tobytes()
            counts = word_counts(h, w.first).tobytes()
            seq = h.astype(np.uint32).tobytes()
            short, bounds = labelled_words(h, w.first, SHORT)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id")[a:b],
                    batch.column("digest")[a:b],
                    pa.Array.from_buffers(pa.binary(16), b - a, [None, pa.py_buffer(node)]).cast(pa.binary()),
                    pa.array(w.counts.astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((w.first * 4).astype(np.int32)), pa.py_buffer(seq)]),
                    pa.Array.from_buffers(pa.binary(256), b - a, [None, pa.py_buffer(counts)]).cast(pa.binary()),
                    list_array(order_sketches(h, w.first, k, ell, sketches).view(np.int64).ravel(), np.arange(b - a + 1) * sketches),
                    list_array(short.view(np.int64), bounds),
                ],
                ["id", "digest", "node", "words", "seq", "counts", "sketch", "short"],
            )


_PREPARED = "id long, digest binary, node binary, words int, seq binary, counts binary, sketch array<long>, short array<long>"


def prepared(docs: DataFrame, k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> DataFrame:
    rows = picked(docs, id="doc_id", text="text").where("text IS NOT NULL")
    rows = rows.select(F.col("id").cast("long"), "text", fingerprint("text").alias("digest"))
    return rows.mapInArrow(lambda it: _prepared(it, k, ell, sketches), _PREPARED)


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1.

    Alignment within a band of 2 * most + 1 diagonals, whose cells of one row are the bits of
    one integer (bit-parallel after Hyyro 2003).  What both begin and end with is cut off first.
    """
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    # Rows are b's items, bits are a's.  Bits outside the band are never set: they are cut by `mask`.
    where: dict = {}
    for x, item in enumerate(a):
        where[item] = where.get(item, 0) | (1 << x)
    full = (1 << m) - 1
    up, down, score = full, 0, m
    top = 1 << (m - 1)
    if m <= 2 * most + 1:  # the band covers every column
        for item in b:
            eq = where.get(item, 0)
            x = (((eq & up) + up) ^ up) | eq | down
            h_up, h_down = down | ~(x | up), up & x
            if h_up & top:
                score += 1
            elif h_down & top:
                score -= 1
            h_up = (h_up << 1) | 1
            h_down <<= 1
            up, down = (h_down | ~(x | h_up)) & full, h_up & x & full
        return min(score, most + 1)
    width = 2 * most + 1
    mask = (1 << width) - 1
    edge, last = 1 << (width - 1), m - 1
    # The window of row y covers columns y - most .. y + most (0-based); bit t is column y - most + t.
    up, down, score = (mask >> most) << most, 0, most
    for y in range(n):
        shift = y - most
        eq = where.get(b[y], 0)
        eq = (eq >> shift if shift >= 0 else eq << -shift) & mask
        x = (((eq & up) + up) ^ up) | eq | down
        h_up, h_down = down | ~(x | up), up & x
        end = last - shift  # bit of the last column
        if end >= width - 1:  # the window's right edge moves along the diagonal
            if not x & edge:
                score += 1
        else:
            bit = 1 << end
            if end < 0:
                return most + 1
            if h_up & bit:
                score += 1
            elif h_down & bit:
                score -= 1
        x >>= 1
        up, down = (h_down | ~(x | h_up)) & mask, h_up & x & mask
    return min(score, most + 1)


def _allowed(n: int, threshold: float) -> int:
    """Most edits that two documents of which the longer has ``n`` words may be apart."""
    return int((1 - threshold) * n + 1e-9)


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: the words, with their counts, that one sequence alone has."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    if not len(x) or not len(y):
        return max(len(a), len(b))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return max(len(a), len(b)) - int(np.where(y[at] == x, np.minimum(n, m[at]), 0).sum())


def near_copies(a: list, b: list, threshold: float = THRESHOLD) -> bool:
    most = _allowed(max(len(a), len(b)), threshold)
    return banded_distance(a, b, most) <= most


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("sa"), batch.column("sb")
        good = []
        for i in range(len(batch)):
            a = np.frombuffer(left[i].as_buffer(), np.uint32)
            b = np.frombuffer(right[i].as_buffer(), np.uint32)
            good.append(bag_distance(a, b) <= _allowed(max(len(a), len(b)), threshold) and near_copies(a.tolist(), b.tolist(), threshold))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _aligned(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes that are near copies; ``seqs`` are (node, seq)."""
    both = pairs.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("sa")), "a").join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("sb")), "b")
    return both.mapInArrow(lambda it: _verified(it, threshold), "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of the nodes that have edges: the least node of each connected component.

    Labels spread to neighbours and are then followed to their own labels, which halves what is
    left of any path; each round is written, and the last changes nothing.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("near")).agg(F.min("label").alias("least"))
        step = labels.join(seen, labels.node == seen.near).select("node", "label", F.least("label", "least").alias("next"))
        jump = labels.select(F.col("node").alias("of"), F.col("label").alias("beyond"))
        step = step.join(jump, step.next == jump.of, "left").select("node", F.col("label").alias("was"), F.least("next", "beyond").alias("label"))
        step = written(step, f"{name}-labels")
        if step.where("label <> was").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def _possible(counts: np.ndarray, words: np.ndarray, i: int, threshold: float) -> np.ndarray:
    """Of the rows after ``i`` those that may be near copies of row ``i``, by lengths and word counts.

    Each word that one document alone has costs an edit, and merging words into classes, or
    cutting counts, only hides such words.
    """
    longer = np.maximum(words[i], words[i + 1 :])
    most = ((1 - threshold) * longer + 1e-9).astype(np.int64)
    at = np.flatnonzero(longer - np.minimum(words[i], words[i + 1 :]) <= most)
    out = [np.zeros(0, np.int64)]
    for part in np.array_split(at, len(at) // 4096 + 1):
        other = counts[i + 1 + part]
        either = np.maximum(other, counts[i]).sum(axis=1, dtype=np.int64)
        apart = either - np.minimum(other.sum(axis=1, dtype=np.int64), counts[i].sum(dtype=np.int64))
        out.append(part[apart <= most[part]])
    return np.concatenate(out) + i + 1


def _near_first(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of which a is the key's first, whose lengths and word counts allow them to be near copies."""
    for batch in batches:
        words = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("words", "f_words")]
        counts = [np.frombuffer(batch.column(c).cast(pa.binary(256)).buffers()[1], np.uint8)[batch.column(c).offset * 256 :][: len(batch) * 256].reshape(-1, 256) for c in ("counts", "f_counts")]
        longer = np.maximum(*words)
        most = ((1 - threshold) * longer + 1e-9).astype(np.int64)
        good = longer - np.minimum(*words) <= most
        for part in np.array_split(np.flatnonzero(good), len(batch) // 4096 + 1):
            x, y = counts[0][part], counts[1][part]
            apart = np.maximum(x, y).sum(axis=1, dtype=np.int64) - np.minimum(x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64))
            good[part] = apart <= most[part]
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _paired(table: pa.Table, threshold: float) -> pa.Table:
    """The pairs of nodes of different labels in the same cells that may be near copies.

    Rows are (key, i, j, side, node, words, counts, label); a cell (key, i, j) pairs the members of
    block i with those of block j, or a block's with each other.
    """
    table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
    key, one, two, side, node, words, label = (table[c].to_numpy() for c in ("key", "i", "j", "side", "node", "words", "label"))
    counts = np.frombuffer(b"".join(x.as_py() for x in table["counts"]), np.uint8).reshape(-1, 256)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    cut = np.flatnonzero(new)
    for a, b in zip(cut, np.append(cut[1:], len(key))):
        for i in range(b - a - 1):
            j = _possible(counts[a:b], words[a:b], i, threshold)
            j = j[label[a + j] != label[a + i]]
            if one[a] != two[a]:
                j = j[side[a + j] != side[a + i]]
            left.append(np.full(len(j), node[a + i]))
            right.append(node[a + j])
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)}).group_by(["a", "b"]).aggregate([])


def cells(members: DataFrame, block: int) -> DataFrame:
    """``members`` (key, n, node, ...) with i, j and side: a row for each cell that a member's block is in.

    A key of n members has ceil(n / block) blocks; every pair of members is in one cell, and no cell
    has more than two blocks' members.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("own", own)
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return m.select(*members.columns, low.alias("i"), high.alias("j"), (F.col("own") == low).cast("int").alias("side"))


def _pairs(info: DataFrame, threshold: float) -> Callable[[DataFrame, bool], DataFrame]:
    """Pairs for ``clusters`` from ``info`` (node, words, counts)."""

    def pairs(members: DataFrame, stars: bool) -> DataFrame:
        if stars:
            first = info.select(F.col("node").alias("first"), F.col("words").alias("f_words"), F.col("counts").alias("f_counts"))
            rows = members.where("node <> first").select("first", "node").distinct().join(info, "node").join(first, "first")
            rows = rows.select(F.col("first").alias("a"), F.col("node").alias("b"), "words", "f_words", "counts", "f_counts")
            return rows.mapInArrow(lambda it: _near_first(it, threshold), "a long, b long")
        rows = cells(members, BLOCK)
        chunks = max(1, -(-rows.count() // 20_000))
        rows = rows.join(info, "node").withColumn("chunk", F.pmod(F.xxhash64("key", "i", "j"), F.lit(chunks)))
        return rows.groupBy("chunk").applyInArrow(lambda t: _paired(t, threshold), "a long, b long")

    return pairs


def shared(rows: DataFrame, key: str, name: str, **also: Column) -> DataFrame:
    """The rows whose ``key``, a long, others have too, with ``many``, how many have it, and what ``also`` aggregates.

    Counts are combined before they are shuffled, and a filter of bounded size keeps rows whose key
    stands alone from the join, so that no key, however many have it, goes through a single task.
    """
    counts = written(rows.groupBy(key).agg(F.count("*").alias("many"), *(c.alias(a) for a, c in also.items())).where("many > 1"), f"{name}-shared")
    again = sieve(counts.select(key))

    def may(keys: pa.Array) -> pa.Array:
        return pa.array(again(keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return rows.where(F.arrow_udf(may, "boolean")(key)).join(counts.hint("merge"), key)


def clusters(keys: DataFrame, pairs: Callable[[DataFrame, bool], DataFrame], confirmed: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """(node, label) of the nodes that some confirmed pair joins to others; the label is the component's least node.

    ``keys`` are (key, node); nodes that share a key are candidates.  ``pairs(members, stars)``
    gives (a, b), all pairs of a key's members that may be confirmed: with stars, from (key, node,
    first), those of its least node and the others, else, from (key, node, label, n), those of the
    n others that have different labels.  ``confirmed`` keeps those that
    are alike.  The components are those of all confirmed candidates: pairs are left out only
    within what is one component already.
    """
    members = written(shared(keys, "key", name, first=F.min("node")).select("key", "node", "first"), f"{name}-members")
    # distinct: one pair may share many keys
    edges = written(confirmed(written(pairs(members, True).distinct(), f"{name}-stars")), f"{name}-edges")
    label = components(edges, f"{name}-first")
    # What a key's first member has not joined
    of = label.select(F.col("node").alias("of"), "label")
    at = members.where("node <> first").select("key", "node").join(of, F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    at = written(at, f"{name}-labelled")
    several = at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    at = written(at.join(several, "key"), f"{name}-rest")
    more = written(confirmed(written(pairs(at, False).distinct(), f"{name}-more")), f"{name}-edges")
    return label if more.isEmpty() else components(edges.unionByName(more), f"{name}-last")


def _short_keys(nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, node) for ``clusters``: the rarest words of the short texts that can have a near copy."""
    n = F.col("words")
    # a text without room for an edit is near to itself alone
    room = F.floor((1 - threshold) * F.floor(n / threshold + 1e-9) + 1e-9) > 0
    each = nodes.where(room).select(F.col("number").alias("node"), "words", F.explode("short").alias("word"))
    each = shared(each, "word", "short")
    order = "PARTITION BY node ORDER BY many, word"
    each = each.select("*", F.expr(f"row_number() OVER ({order})").alias("nth"), F.expr("count(*) OVER (PARTITION BY node)").alias("shared"))
    # those that no other text has come before all of these
    prefix = n - F.ceil(threshold * n - 1e-9) + 1
    return each.where(n - F.col("shared") + F.col("nth") <= prefix).select(F.col("word").alias("key"), "node")


def named(label: DataFrame, names: DataFrame) -> DataFrame:
    """(node, label) by name for (node, label) by number; ``names`` are (number, name)."""
    label = label.join(names, F.col("node") == F.col("number")).select(F.col("name").alias("node"), "label")
    return label.join(names, F.col("label") == F.col("number")).select("node", F.col("name").alias("label"))


def winners(rows: DataFrame, label: DataFrame) -> DataFrame:
    """(id, digest, n, winner, keep) from (id, digest, node) of all documents and the nodes' labels."""
    label = label.select(F.col("node").alias("of"), "label")
    each = rows.groupBy("id", "digest", "node").agg(F.count("*").alias("n"))
    grouped = each.join(label, F.col("node") == F.col("of"), "left").withColumn("label", F.coalesce("label", "node"))
    # null ids come last; of one id's several texts that of the least digest
    best = grouped.groupBy(F.col("label").alias("group")).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("best"))
    out = grouped.join(best, F.col("label") == F.col("group"))
    keep = F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.digest") == F.col("digest"))
    return out.select("id", "digest", "n", F.col("best.id").alias("winner"), keep.alias("keep"))


def copies(decisions: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id): a row for each row that isn't kept."""
    again = F.col("n") - F.when(F.col("keep"), 1).otherwise(0)
    out = decisions.select("id", "winner", again.alias("again")).where("again > 0")
    return out.select(F.col("id").alias("doc_id"), F.col("winner").alias("kept_doc_id"), F.explode(F.sequence(F.lit(1), F.col("again").cast("int"))).alias("again")).drop("again")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, ell: int = ELL, sketches: int = SKETCHES) -> DataFrame:
    """(id, digest, n, winner, keep): the decision for each id and text among the documents with text.

    Texts without a word are near copies of nothing but texts that equal them in full.
    """
    table = written(prepared(docs, k, ell, sketches), "near-words")
    with_words = table.where("words > 0")
    # distinct word sequences are numbered: numbers move in fewer bytes
    nodes = with_words.select("node", "words", "seq", "counts", "sketch", "short").dropDuplicates(["node"])
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("number"), "*"), "near-nodes")
    keys = nodes.select(F.explode(F.array_distinct("sketch")).alias("key"), F.col("number").alias("node")).unionByName(written(_short_keys(nodes, threshold), "near-short"))
    numbered = nodes.select(F.col("number").alias("node"), "words", "seq", "counts")
    label = clusters(keys, _pairs(numbered.drop("seq"), threshold), lambda pairs: _aligned(pairs, numbered, threshold), "near")
    label = named(label, nodes.select("number", F.col("node").alias("name")))
    one_word = table.select("id", "digest", F.when(F.col("words") > 0, F.col("node")).otherwise(F.col("digest")).alias("node"))
    return written(winners(one_word, label), "near")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **sketch: int) -> DataFrame:
    """(doc_id, kept_doc_id): a row for each document whose group of near copies keeps another.

    Null texts are copies of nothing; texts without a word only of equal texts.  Exact copies are
    near copies.  Of rows with the same doc_id and text all but one are copies, and rows with the
    same doc_id and different texts are different documents.  No documents, no rows.
    """
    return copies(near_groups(docs, threshold, **sketch))


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, **sketch: int) -> DataFrame:
    """One document of each group of near copies, columns as they were; null texts all stay."""
    return one_of_each(docs, near_groups(docs, threshold, **sketch))
