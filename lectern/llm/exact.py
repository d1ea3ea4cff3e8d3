"""Exact dedup against a history: a minimal perfect hash over its distinct digests.

Digests are SHA-256.  The distinct digests of the history are split into buckets of about
``BUCKET`` by hash; each bucket becomes a minimal perfect hash (a cascade of bit levels, in
which a key settles on the first level where it shares its bit with no other) whose slots hold
the full digest and the winner's locator, the least document id.  Incoming distinct digests are
sent to their bucket, looked up, and compared byte by byte with the slot.  Members take the
slot's locator; the rest group among themselves and take their own least id.

Only digests and ids are shuffled, combined on the map side, so a digest that thousands of
documents share is one row by the time it reaches its bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, one_of_each, picked, same, written
from .kernel import mix

BUCKET = 500_000
GAMMA = 1.5


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests, given as uint64[n, 4]."""

    def __init__(self, digests: np.ndarray, locators: np.ndarray):
        n = len(digests)
        self.levels: list[np.ndarray] = []
        self.base: list[int] = []
        left, placed = np.arange(n), 0
        slot = np.empty(n, np.int64)
        while len(left):
            size = max(64, int(GAMMA * len(left)))
            at = self._position(digests[left], len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            alone = bits[at]
            rank = np.cumsum(bits) - 1
            slot[left[alone]] = placed + rank[at[alone]]
            self.levels.append(bits)
            self.base.append(placed)
            placed += int(bits.sum())
            left = left[~alone]
        self.ranks = [np.cumsum(b) - 1 for b in self.levels]
        self.slots = np.empty_like(digests)
        self.slots[slot] = digests
        self.locators = np.empty_like(locators)
        self.locators[slot] = locators

    @staticmethod
    def _position(d: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
        return (mix(d[:, level % 4] ^ mix(d[:, (level + 1) % 4] + seed)) % np.uint64(size)).astype(np.int64)

    def lookup(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each digest whether it is a member, by all of its bytes, and its slot (-1 if none)."""
        slot = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            at = self._position(digests[left], level, len(bits))
            hit = bits[at]
            slot[left[hit]] = self.base[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        member = slot >= 0
        member[member] = (self.slots[slot[member]] == digests[member]).all(axis=1)
        return member, slot


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    a = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], pa.large_binary())
    if not len(a):
        return np.zeros((0, 4), np.uint64)
    o = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[o[0] : o[-1]].view(np.uint64).reshape(-1, 4)


def _looked_up(key: tuple, history: pa.Table, incoming: pa.Table) -> pa.Table:
    """One bucket: every incoming distinct digest with its winner and whether the history has it."""
    has, first = _digests(history["h_digest"]), history["h_id"].combine_chunks()
    table = PerfectHash(has, np.arange(len(has)))
    member, slot = table.lookup(_digests(incoming["digest"]))
    where = pa.array(table.locators[np.where(member, slot, 0)] if len(has) else np.zeros(len(member), np.int64), mask=~member)
    winner = pa.chunked_array([first.take(where) if len(has) else pa.nulls(len(member), pa.int64())])
    own = incoming["least"].combine_chunks()
    return pa.table(
        {
            "digest": incoming["digest"],
            "winner": pc.if_else(pa.chunked_array([pa.array(member)]), winner, own),
            "known": pa.array(member),
            "rows": incoming["rows"],
        }
    )


def slim(docs: DataFrame) -> DataFrame:
    """(id, digest, n): one row for each id and digest of the documents with text, n equal rows."""
    rows = picked(docs, id="doc_id", text="text").where("text IS NOT NULL")
    return rows.select(F.col("id").cast("long"), fingerprint("text").alias("digest")).groupBy("id", "digest").agg(F.count("*").alias("n"))


def digests(docs: DataFrame) -> DataFrame:
    """(digest, id): each distinct text's digest and its least id, to be kept as history for later runs."""
    return slim(docs).groupBy("digest").agg(F.min("id").alias("id"))


def decisions(rows: DataFrame, history: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """(id, digest, n, winner, keep) for ``rows`` as ``slim`` makes them.

    ``history`` has (id, digest) of the documents seen before; those may be among ``rows`` too.
    The winner of a digest is the least id of the history's documents that have it, else the
    least id of the incoming ones; a null id comes after all others.
    """
    if history is None:
        history = rows.limit(0)
    known = history.groupBy(F.col("digest").alias("h_digest")).agg(F.min("id").alias("h_id"))
    distinct = rows.groupBy("digest").agg(F.min("id").alias("least"), F.sum("n").alias("rows"))
    buckets = max(1, math.ceil(rows.count() / bucket))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")
    found = (
        known.select(place("h_digest"), "h_digest", "h_id").groupBy("bucket")
        .cogroup(distinct.select(place("digest"), "digest", "least", "rows").groupBy("bucket"))
        .applyInArrow(_looked_up, "digest binary, winner long, known boolean, rows long")
    )
    more = found.where("rows > 1 OR known").withColumnRenamed("digest", "f_digest")
    joined = rows.join(more, F.col("digest") == F.col("f_digest"), "left")
    return joined.select(
        "id", "digest", "n",
        F.when(F.col("f_digest").isNull(), F.col("id")).otherwise(F.col("winner")).alias("winner"),
        (F.col("f_digest").isNull() | same(F.col("winner"), F.col("id"))).alias("keep"),
    )


def exact_decisions(docs: DataFrame, history_ids: DataFrame | None = None, bucket: int = BUCKET, seen: DataFrame | None = None) -> DataFrame:
    """``decisions`` for whole documents; the history is those whose doc_id is in ``history_ids``, and what ``digests`` gave in earlier runs.

    The digests are written once, so texts are read once.  A doc_id of the history that no
    document has counts for nothing; without ``history_ids`` all documents are incoming.
    """
    rows = written(slim(docs), "digests")
    history = None
    if history_ids is not None:
        ids = picked(history_ids, h="doc_id").where("h IS NOT NULL").distinct()
        history = rows.join(ids, F.col("id") == F.col("h"), "left_semi").select("id", "digest")
    if seen is not None:
        old = picked(seen, id="id", digest="digest").select(F.col("id").cast("long"), "digest")
        history = old if history is None else history.unionByName(old)
    return written(decisions(rows, history, bucket), "exact")


def exact_duplicates(docs: DataFrame, history_ids: DataFrame | None = None, bucket: int = BUCKET, seen: DataFrame | None = None) -> DataFrame:
    """(doc_id, kept_doc_id): a row for each document that repeats another's whole text.

    Null texts repeat nothing; empty texts repeat each other.  Of rows with the same doc_id and
    text all but one are repeats.  No documents, no rows.
    """
    d = exact_decisions(docs, history_ids, bucket, seen)
    again = F.col("n") - F.when(F.col("keep"), 1).otherwise(0)
    return d.select(F.col("id").alias("doc_id"), F.col("winner").alias("kept_doc_id"), again.alias("again")).where("again > 0").select(
        "doc_id", "kept_doc_id", F.explode(F.sequence(F.lit(1), F.col("again").cast("int"))).alias("again")
    ).drop("again")


def exact_dedup(docs: DataFrame, history_ids: DataFrame | None = None, bucket: int = BUCKET, seen: DataFrame | None = None) -> DataFrame:
    """The documents without those repeats, columns as they were; null texts all stay."""
    return one_of_each(docs, exact_decisions(docs, history_ids, bucket, seen))
