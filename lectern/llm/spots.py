"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke, SIGIR 2008).

A spot is a common word, its anchor, and the chain of the next CHAIN content words after it.  A
document's fingerprint is the set of its spots.  Two documents are alike if the Jaccard similarity
of their sets is at least ``threshold``; groups are the components of alike documents.  Documents
without spots are alike if they are the same words, case and punctuation aside.

Candidates are exact.  Sets are partitioned by length, on a scale on which alike sets are in the
same partition or neighbours, and only meet there.  A set's spots are ordered by how many sets
have them, rarest first, and alike sets share one among the first n - ceil(threshold * n) + 1 of
each; spots that one set alone has lead the order and meet nothing, so all but copies drop out
before any comparison.  Lengths prune again, and the rest are intersected in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, picked, written
from .kernel import Words, as_string, list_array, mix, slices, word_hash
from .near import cells, clusters, copies, named, sequences, shared, winners

CHAIN, THRESHOLD = 3, 0.5
#: A set with any spot at all is compared.
LEAST = 1
#: Members of a key in a block; a key's blocks are paired side by side.
BLOCK = 1_000

ANCHORS = "the is was that have le est que dans der ist das und el es los para".split()
STOPWORDS = frozenset(
    "a an and are as at be been but by for from had has he her his i if in into it its not of on or she so than their them then there these they this to we were which "
    "who will with would you la les de des du et un une qui en pour pas sur par au aux plus ce il elle ne se son sa ses nous vous die von zu den mit sich auf für nicht "
    "ein eine als auch an werden aus er hat dass sie dem im am y por con no su al lo como más pero sus o este sí entre del las una uno".split()
) | frozenset(ANCHORS)

_tables: list[np.ndarray] = []


def _known() -> list[np.ndarray]:
    if not _tables:
        _tables[:] = [np.sort(np.array([word_hash(w) for w in words], np.uint64)) for words in (sorted(ANCHORS), sorted(STOPWORDS))]
    return _tables


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def spots(data: np.ndarray, rows: np.ndarray, chain: int, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct spots of each lower-cased text, ascending, and where each text's begin."""
    w = words or Words(data, rows)
    h = w.hashes
    anchors, stops = _known()
    text = np.repeat(np.arange(len(rows) - 1), w.counts)
    content = np.flatnonzero(~_member(h, stops))
    at = np.flatnonzero(_member(h, anchors))
    k = np.searchsorted(content, at, "right")
    inside = k + chain <= len(content)
    at, k = at[inside], k[inside]
    inside = text[content[k + chain - 1]] == text[at]
    at, k = at[inside], k[inside]
    spot = mix(h[at])
    for j in range(chain):
        spot = mix(spot + h[content[k + j]])
    order = np.lexsort((spot, text[at]))
    spot, who = spot[order], text[at][order]
    new = np.ones(len(spot), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (who[1:] != who[:-1])
    return spot[new], np.searchsorted(who[new], np.arange(len(rows)))


def _fingerprints(batches: Iterator[pa.RecordBatch], chain: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_string(batch.column("text"), lower=True)
        for a, b, data, rows in slices(texts):
            w = Words(data, rows)
            spot, bounds = spots(data, rows, chain, w)
            halves = []
            for seed in (21, 22):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(spot + np.uint64(seed)))])
                halves.append(total[bounds[1:]] - total[bounds[:-1]])
            some = np.diff(bounds)[:, None] > 0
            node = np.where(some, np.stack(halves, axis=1), sequences(w.hashes, w.first)).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id")[a:b], batch.column("digest")[a:b], pa.Array.from_buffers(pa.binary(16), b - a, [None, pa.py_buffer(node)]).cast(pa.binary()),
                    pa.array(w.counts.astype(np.int32)), pa.array(np.diff(bounds).astype(np.int32)), list_array(spot.view(np.int64), bounds),
                ],
                ["id", "digest", "node", "words", "n", "spots"],
            )


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(id, digest, node, words, n, spots) for the documents with text.

    Equal sets have equal nodes, and of the documents without spots those of equal words.
    """
    rows = picked(docs, id="doc_id", text="text").where("text IS NOT NULL")
    rows = rows.select(F.col("id").cast("long"), "text", fingerprint("text").alias("digest"))
    return rows.mapInArrow(lambda it: _fingerprints(it, chain), "id long, digest binary, node binary, words int, n int, spots array<long>")


def partition(n: int, threshold: float) -> int:
    """Sets of n >= 1 spots are in the same partition or neighbours if they can be alike."""
    return int(math.log(n) / -math.log(threshold) + 1e-9)


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, node) for ``clusters``: the spots of each set's prefix, in its own and the next partition."""
    each = sets.select("node", "n", F.explode("spots").alias("spot"))
    each = shared(each, "spot", "spots")
    order = "PARTITION BY node ORDER BY many, spot"
    each = each.select("*", F.expr(f"row_number() OVER ({order})").alias("nth"), F.expr("count(*) OVER (PARTITION BY node)").alias("shared"))
    # those that no other set has come before all of these
    prefix = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1
    each = each.where(F.col("n") - F.col("shared") + F.col("nth") <= prefix)
    part = F.floor(F.log("n") / -math.log(threshold) + 1e-9)
    return each.select(F.explode(F.array(F.xxhash64("spot", part), F.xxhash64("spot", part + 1))).alias("key"), "node").distinct()


def _pairs(info: DataFrame, threshold: float) -> Callable[[DataFrame, bool], DataFrame]:
    """Pairs for ``clusters`` from ``info`` (node, n), unless lengths rule them out."""
    fits = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9

    def pairs(members: DataFrame, stars: bool) -> DataFrame:
        if stars:
            first = info.select(F.col("node").alias("first"), F.col("n").alias("m"))
            rows = members.where("node <> first").select("first", "node").distinct().join(info, "node").join(first, "first")
            return rows.where(fits).select(F.col("first").alias("a"), F.col("node").alias("b"))
        rows = cells(members, BLOCK).drop("n").join(info, "node")
        one = rows.select("key", "i", "j", "side", F.col("node").alias("a"), F.col("label").alias("a_label"), "n")
        two = rows.select("key", "i", "j", F.col("side").alias("b_side"), F.col("node").alias("b"), F.col("label").alias("b_label"), F.col("n").alias("m"))
        across = (F.col("i") == F.col("j")) | (F.col("side") != F.col("b_side"))
        return one.join(two, ["key", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("a_label") != F.col("b_label")) & across & fits).select("a", "b")

    return pairs


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    left, right = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("spots").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both >= threshold * (F.col("na") + F.col("nb") - both) - 1e-9).select("a", "b")


def spot_groups(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN) -> DataFrame:
    """(id, digest, n, winner, keep): the decision for each id and text among the documents with text.

    A document without spots is grouped with those of the same words, one without words with equal texts.
    """
    # the sets themselves are written once for each distinct one, numbered: numbers move in fewer bytes
    table = written(fingerprints(docs, chain).drop("spots"), "spots")
    sets = fingerprints(docs, chain).where(F.col("n") >= LEAST).select("node", "n", "spots").dropDuplicates(["node"])
    numbered = written(sets.select(F.monotonically_increasing_id().alias("number"), "*"), "spot-sets")
    sets = numbered.select(F.col("number").alias("node"), "n", "spots")
    label = clusters(_candidates(sets, threshold), _pairs(sets.select("node", "n"), threshold), lambda pairs: _alike(pairs, sets, threshold), "spot")
    label = named(label, numbered.select("number", F.col("node").alias("name")))
    rows = table.select("id", "digest", F.when(F.col("words") > 0, F.col("node")).otherwise(F.col("digest")).alias("node"))
    return written(winners(rows, label), "spot-groups")


def spot_duplicates(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN) -> DataFrame:
    """(doc_id, kept_doc_id): a row for each document whose group holds another of lesser id.

    Null texts are in no group; texts without spots are alike if their lower-cased words are
    the same, and those without words only if equal.  Of rows with the same doc_id and text all but one are duplicates; with different texts they are
    different documents.  No documents, no rows.
    """
    return copies(spot_groups(docs, threshold, chain))
