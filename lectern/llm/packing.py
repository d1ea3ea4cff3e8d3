"""Packing by deficit round-robin over source queues.

Each source's documents form a queue of tokens.  In every window each source is credited its
share of the window; what a credit leaves of a token is its deficit and is carried on, so after
any number of windows a source is within one token of its share, and every window is full.  When
a queue runs out, its credit goes to the others in proportion.

Carried deficits have a closed form: after i windows sources 1..s together have had
floor(i * window * (share_1 + ... + share_s)) tokens.  So the state at any window, and hence at
any partition, is known without running the windows before it: the driver works out only the
stretches between two queues' ends, at most a few for each source, and every document finds its
windows by itself.  A queue's positions are prefix sums over the partitions.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY
from .common import fresh_path, same, written
from .tokens import id_type, place, token_files

WINDOW = 8192
#: Of more sources the smallest share queues, so that about so many queues are left.
QUEUES = 1024
#: Default mixture: a source's share goes by this power of its tokens; 1 is the corpus's own mixture.
TEMPER = 0.5
#: Shares are whole numbers of this much.
SHARES = 1 << 16


def had(i, window: int, a: int, b: int, total: int):
    """Tokens that the source with shares a..b of ``total`` has had after ``i`` windows."""
    whole, part = i // total, i % total  # keeps the products small
    return whole * window * (b - a) + part * window * b // total - part * window * a // total


@dataclass
class Stretch:
    """Windows ``first`` .. ``first + many - 1``, in which the same queues are live.

    Of each live queue, ascending: where it is at the beginning, and its shares a..b of total (of a
    single window: its tokens a..b of the window).
    """

    first: int
    many: int
    window: int
    total: int
    live: np.ndarray
    at: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def after(self) -> np.ndarray:
        """Where the queues are at the end."""
        return self.at + had(np.int64(self.many), self.window, self.a, self.b, self.total)


class Turn:
    """A queue's part in a stretch; ``slot`` is its place among the window's queues."""

    def __init__(self, x: Stretch, k: int):
        self.first, self.many, self.window, self.total, self.slot = x.first, x.many, x.window, x.total, k
        self.at, self.a, self.b = int(x.at[k]), int(x.a[k]), int(x.b[k])
        self.end = self.had(self.many)

    def had(self, i: int) -> int:
        """Position in the queue after ``i`` windows of this stretch."""
        return self.at + had(i, self.window, self.a, self.b, self.total)


def turns(stretches: list[Stretch], queue: int) -> list[Turn]:
    at = [int(np.searchsorted(x.live, queue)) for x in stretches]
    return [Turn(x, k) for x, k in zip(stretches, at) if k < len(x.live) and x.live[k] == queue]


def whole_shares(targets: list[float], window: int) -> list[int]:
    """Shares of about SHARES in the proportions of ``targets``, each of a token per window at least.

    Below a token per window the closed form would take tokens back.
    """
    if len(targets) > window:
        raise ValueError(f"a window of {window} tokens has no room for {len(targets)} sources")
    total = sum(targets)
    shares = [round(SHARES * t / total) for t in targets]
    while min(shares) < (least := max(1, -(-sum(shares) // window))):
        shares = [max(least, x) for x in shares]
    return shares


def together(targets: list[float], window: int) -> list[list[int]]:
    """The sources of each queue, a queue's in the order in which they are drained.

    Each has one of its own, unless there are more than QUEUES, or than half the tokens of a window:
    then the smallest share queues, each just large enough for two tokens a window and for QUEUES in all.
    """
    if len(targets) <= min(QUEUES, max(1, window // 2)):
        return [[s] for s in range(len(targets))]
    if sum(targets) <= 0:
        targets = [1.0] * len(targets)
    least = sum(targets) * max(2 / window, 1 / QUEUES)
    queues, held, has = [], [], 0.0
    for s in sorted(range(len(targets)), key=lambda s: targets[s]):
        held.append(s)
        has += targets[s]
        if has >= least:
            queues.append(held[::-1])
            held, has = [], 0.0
    if held:
        queues.append(held[::-1] + (queues.pop() if queues else []))
    return sorted(queues)


def schedule(totals: list[int], targets: list[float], window: int) -> list[Stretch]:
    """The stretches that place all tokens of the queues of ``totals`` tokens."""
    if sum(targets) <= 0:
        targets = [1.0] * len(totals)
    shares = np.array(whole_shares(targets, window) if totals else [], np.int64)
    total_of, at, out, first = np.array(totals, np.int64), np.zeros(len(totals), np.int64), [], 0
    while len(live := np.flatnonzero(at < total_of)):
        bounds = np.concatenate([[0], np.cumsum(shares[live])])
        total, a, b, left = int(bounds[-1]), bounds[:-1], bounds[1:], (total_of - at)[live]
        # most windows that every queue can serve: all at once, by halving
        low, high = np.zeros(len(live), np.int64), left * total // (window * (b - a)) + 2
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = had(middle, window, a, b, total) <= left
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        many = int(low.min())
        if many:
            stretch = Stretch(first, many, window, total, live, at[live], a, b)
        else:  # the window in which a queue runs out
            many = 1
            gets = np.minimum(had(np.int64(1), window, a, b, total), left)
            while (short := int(window - gets.sum())) and (gets < left).any():
                more = gets < left
                asked = np.where(more, -(-short * shares[live] // int(shares[live][more].sum())), 0)
                asked = np.minimum(asked, left - gets)
                gets += np.clip(short - (np.cumsum(asked) - asked), 0, asked)
            ends = np.cumsum(gets)
            stretch = Stretch(first, 1, int(ends[-1]), int(ends[-1]), live, at[live], ends - gets, ends)
        at[live] = stretch.after()
        out.append(stretch)
        first += many
    return out


def segments(own: list[Turn], begin: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(window, slot, first position in the queue, tokens) of the ``n`` tokens of a queue from ``begin``."""
    end = begin + n
    for k in range(bisect_right(own, begin, key=lambda x: x.end), len(own)):
        x = own[k]
        if x.at >= end:
            return
        low = max(0, (begin - x.at) * x.total // max(1, x.window * (x.b - x.a)) - 2)
        while low > 0 and x.had(low) > begin:
            low -= 1
        while x.had(low + 1) <= begin:
            low += 1
        while begin < end and low < x.many:
            to = min(end, x.had(low + 1))
            if to > begin:
                yield x.first + low, x.slot, begin, to - begin
            begin, low = max(begin, to), low + 1


class Slabs:
    """Reads of one file after the other, ahead of what is asked for."""

    def __init__(self, folder: str, size: int = 4 << 20):
        self.fs, self.root = place(folder)
        self.size, self.name, self.file, self.at, self.held = size, None, None, 0, b""

    def read(self, name: str, at: int, n: int) -> bytes:
        if name != self.name:
            self.close()
            self.name, self.file, self.held = name, self.fs.open_input_file(f"{self.root}/{name}.bin"), b""
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, self.size))
        return self.held[at - self.at : at - self.at + n]

    def close(self) -> None:
        if self.file:
            self.file.close()


def _packed(batches: Iterator[pa.RecordBatch], stretches: list[Stretch], sources: dict[str | None, tuple[int, int, int | None]], folder: str, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    slabs, own, size = Slabs(folder), {}, kind.itemsize
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "source", "name", "at", "tokens", "begin")]
        out: list[list] = [[] for _ in types]
        held = 0
        for doc, source, name, at, n, begin in zip(*columns):
            ids = slabs.read(name, at * size, n * size)
            queue, base, turn = sources[source]
            if queue not in own:  # a task meets few of the queues
                own[queue] = turns(stretches, queue)
            for window, slot, first, many in segments(own[queue], base + begin, n):
                a = first - base - begin
                for column, value in zip(out, (window, slot if turn is None else turn, doc, source, a, many, ids[a * size : (a + many) * size])):
                    column.append(value)
            held += len(ids)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], _COLUMNS)
                out, held = [[] for _ in types], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], _COLUMNS)
    slabs.close()


_COLUMNS = ["window", "slot", "doc_id", "source", "begin", "tokens", "ids"]


def pack(docs: DataFrame, window: int = WINDOW, targets: dict[str | None, float] | None = None, temper: float = TEMPER, path: str = VOCABULARY) -> DataFrame:
    """(window, slot, doc_id, source, begin, tokens, ids): the pieces of documents in each window.

    Within a window pieces are ordered by slot, the source's turn, and within a slot by the
    source's queue.  ``ids`` are the piece's token ids as the little-endian unsigned integers of
    the token files; ``begin`` is its first token's number in its document.  Every token of every
    document, with its end id, is in one window, and all windows but the last are full.

    ``targets`` are the sources' proportions, by default the powers ``temper`` of their tokens: 0
    gives all sources alike, 1 the corpus's own mixture, in which all queues last to the end, and
    between them small sources come sooner than they would.  A source without a target, or with one that isn't positive, is left
    to the end: it gets the least share, a token per window.  Null is a source like any other.  Null and empty texts
    are their end id alone; repeated rows are documents of their own.  No documents, no windows.
    Sources are the mixture's components, so one row for each fits the driver.  If there are more
    than QUEUES, or than half a window's tokens, the smallest share queues (``together``): such a queue gets the sum of
    its sources' shares and drains them one after the other, those without a target last.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "packed-tokens")
    rows, _ = token_files(docs, folder, path)
    parts = rows.groupBy("shard", "source").agg(F.sum("tokens").alias("many"))
    before = "OVER (PARTITION BY source ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = written(parts.select("shard", "source", "many", F.expr(f"coalesce(sum(many) {before}, 0)").alias("base")), "packing-bases")
    totals = bases.groupBy("source").agg(F.sum("many").alias("tokens")).orderBy("source").collect()
    aims = [float(r.tokens**temper if targets is None else max(targets.get(r.source, 0), 0)) for r in totals]
    queues, sources, turn = together(aims, window), {}, 0
    for q, members in enumerate(queues):
        base = 0
        for s in members:
            sources[totals[s].source] = (q, base, turn if len(queues) < len(totals) else None)
            base, turn = base + totals[s].tokens, turn + 1
    stretches = schedule([sum(totals[s].tokens for s in x) for x in queues], [sum(aims[s] for s in x) for x in queues], window)
    placed = rows.join(
        bases.select(F.col("shard").alias("b_shard"), F.col("source").alias("b_source"), "base"), (F.col("shard") == F.col("b_shard")) & same(F.col("source"), F.col("b_source"))
    ).select("doc_id", "source", "name", "at", "tokens", (F.col("base") + F.col("of_source")).alias("begin"))
    placed = placed.sortWithinPartitions("name", "at")  # files are read from end to end, however the join was done
    kind = id_type(path)
    schema = "window long, slot int, doc_id long, source string, begin long, tokens int, ids binary"
    return placed.mapInArrow(lambda it: _packed(it, stretches, sources, folder, kind), schema)
