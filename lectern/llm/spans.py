"""Substring dedup by sliding spans: of sentences, and of words for long passages.

At every sentence a run begins: SENTENCES consecutive ones, and as many more as it takes to reach
WORDS words, since a few short sentences recur by chance in unrelated texts.  Runs are hashed to 128
bits (of their lower-cased words, so case and punctuation don't matter) and met with the same runs
anywhere in the corpus.  Of the places of a repeated run the first stays, by (doc_id, digest of the
text, sentence number); the sentences covered by any other place are removed.

Passages of at least PASSAGE words go wherever they begin and end, however they are cut into
sentences: every run of PASSAGE words that stands elsewhere too is found, and all of its words but
those of its first place are removed.  Each such run takes the least hash among its pieces of PIECE
words (winnowing; Schleimer, Wilkerson and Aiken, SIGMOD 2003), so places of one run take the same piece.

The corpus is read three times and its texts are hardly shuffled.  First the 64-bit hashes of runs
and pieces are counted.  Those that occur more than once make a filter of bounded size, without false
negatives, through which the second reading passes runs on to the exact comparison.  The third
applies what was found; only texts that lose something, by another such filter, are joined.
A text that equals an earlier one repeats it from end to end, so it sends no runs at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, picked, positional, restored, same, written
from .kernel import Words, as_string, mix, powers, slices

SENTENCES, WORDS = 3, 25
#: Words of a passage that goes wherever it begins, and of the pieces by which it is found.
PASSAGE, PIECE = 51, 26
#: Bits of a filter: so many for each key, and at most MOST_BITS, with which it only lets more pass.
BITS, MOST_BITS = 16, 1 << 27
SEGMENTS = 64

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in " \t\r\n\v\f"]] = True


#: The stops 。！？ in UTF-8.
_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in "。！？"]


def plain_stops(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with wide stops as ASCII ones, which no word holds, and where such a stop begins."""
    stops = np.zeros(len(data), bool)
    if len(data) > 2 and (lead := np.flatnonzero((data[:-2] == 0xE3) | (data[:-2] == 0xEF))).size:
        hit = np.zeros(len(lead), bool)
        for c in _WIDE:
            hit |= (data[lead] == c[0]) & (data[lead + 1] == c[1]) & (data[lead + 2] == c[2])
        at = lead[hit]
        if len(at):
            data = data.copy()
            stops[at] = True
            data[at] = data[at + 1] = data[at + 2] = ord(".")
    return data, stops


class Sentences:
    """The sentences of a slice of texts: bounds in words, in bytes, and where each text's begin.

    A sentence ends after a word that is followed by '.', '!' or '?' and white space, by a stop of
    Chinese or Japanese, or by a line's end, before the next word.  Sentences tile their text from the first word's beginning;
    what stands before the first word belongs to the first sentence.  A text without words has none.
    """

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        data, stops = plain_stops(data)
        self.words = w = Words(data, rows)
        n = len(data)
        follows = np.empty(n, bool)
        if n:
            follows[:-1] = _SPACE[data[1:]]
            follows[-1] = True
            follows[rows[1:][rows[1:] > 0] - 1] = True
        ends = np.concatenate([[0], np.cumsum((data == 10) | (_STOP[data] & follows) | stops)])
        new = np.zeros(len(w.start), bool)
        if len(new):
            new[1:] = ends[w.start[1:]] > ends[w.end[:-1]]
            new[w.first[:-1][w.counts > 0]] = True
        self.word = np.append(np.flatnonzero(new), len(w.start))  # first word of each sentence
        self.first = np.searchsorted(self.word[:-1], w.first)  # first sentence of each text
        self.start = w.start[self.word[:-1]].copy()
        has = np.diff(self.first) > 0
        self.start[self.first[:-1][has]] = rows[:-1][has]
        self.end = np.empty_like(self.start)
        if len(self.start):
            self.end[:-1] = self.start[1:]
            self.end[self.first[1:][has] - 1] = rows[1:][has]

    def runs(self, sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of its first sentence, how many, two halves of the hash) of every run."""
        w, h = self.words, self.words.hashes
        m = len(self.word) - 1
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = np.arange(m)
        end = np.maximum(at + sentences, np.searchsorted(self.word, self.word[:-1] + words))
        fits = end <= self.first[text + 1] if m else np.zeros(0, bool)
        text, at, end = text[fits], at[fits], end[fits]
        halves = []
        up, down = powers(m + 1)
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(self.word[:-1], np.diff(self.word)).astype(np.uint64)
        for seed in (11, 12):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h ^ mix(place + np.uint64(seed << 40))), out=total[1:])
            each = mix(total[self.word[1:]] - total[self.word[:-1]]) if m else np.zeros(0, np.uint64)
            chain = np.zeros(m + 1, np.uint64)
            np.cumsum(each * up[:m], out=chain[1:])
            halves.append(mix((chain[end] - chain[at]) * down[at] + np.uint64(seed)))
        return text, at - self.first[text], end - at, *halves


def word_runs(h: np.ndarray, at: np.ndarray, many: int, seed: int) -> np.ndarray:
    """Position-independent hashes of the runs of ``many`` words that begin at ``at``."""
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(seed)) * up[: len(h)], out=total[1:])
    return mix((total[at + many] - total[at]) * down[at])


def taken(h: np.ndarray, first: np.ndarray, passage: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of ``passage`` words: its first word, its piece's first word; and the hashes of pieces by first word."""
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(h)) + passage <= ends)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    pieces = word_runs(h, np.arange(len(h) - piece + 1), piece, 13)
    # pieces across texts are hashed too, but no run has them
    least = np.lib.stride_tricks.sliding_window_view(pieces, passage - piece + 1)
    where = np.concatenate([least[part].argmin(axis=1) for part in np.array_split(at, len(at) // 65536 + 1)])
    return at, at + where, pieces


class Filter:
    """A set of 64-bit hashes with false positives and no false negatives; of bounded size."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits  # none: all pass

    @staticmethod
    def places(h: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
        return x & np.uint64(many - 1), (x >> np.uint64(32)) & np.uint64(many - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        if not len(self.bits):
            return np.zeros(len(h), bool)
        out = np.ones(len(h), bool)
        for at in self.places(h, len(self.bits) * 8):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _bits(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
    """The set bits of a task's hashes, by segment."""
    bits = np.zeros(many >> 3, np.uint8)
    for batch in batches:
        for at in Filter.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), many):
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    packed = bits.reshape(SEGMENTS, -1)
    some = np.flatnonzero(packed.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[k].tobytes() for k in some], pa.binary())], ["segment", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("segment").to_pylist(), batch.column("bits")):
            new = np.frombuffer(b.as_buffer(), np.uint8)
            held[k] = held[k] | new if k in held else new
    yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["segment", "bits"])


def sieve(hashes: DataFrame) -> Filter:
    """The filter of a table's hashes (its only column, long); at most MOST_BITS reach the driver.

    With so many hashes that the filter would let nearly all pass, none is made.
    """
    n = hashes.count()
    if not n:
        return Filter(np.zeros(0, np.uint8))
    if n > MOST_BITS:
        return Filter(None)
    many = min(MOST_BITS, 1 << max(16, (n * BITS - 1).bit_length()))
    tasks = max(1, min(SEGMENTS, n // (1 << 20)))
    parts = hashes.coalesce(tasks).mapInArrow(lambda it: _bits(it, many), "segment int, bits binary")
    if tasks > 1:
        parts = parts.repartition("segment").mapInArrow(_united, "segment int, bits binary")
    bits = np.zeros((SEGMENTS, many // 8 // SEGMENTS), np.uint8)
    for r in parts.toLocalIterator():
        bits[r.segment] |= np.frombuffer(r.bits, np.uint8)
    return Filter(bits.ravel())


class Runs:
    """What of a slice is met with the rest of the corpus: sentence runs, and word runs by their pieces."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, sizes: tuple[int, int, int, int]):
        sentences, words, self.passage, piece = sizes
        self.s = Sentences(data, rows)
        self.w, self.h = self.s.words, self.s.words.hashes
        self.text, self.number, self.many, self.x, self.y = self.s.runs(sentences, words)
        self.at, self.pick, self.pieces = taken(self.h, self.w.first, self.passage, piece)

    def hashes(self) -> np.ndarray:
        """All that is counted: runs and pieces, no piece twice for its place."""
        return np.concatenate([self.x, self.pieces[np.unique(self.pick)] ^ np.uint64(1)])

    def repeated(self, again: Filter) -> tuple[np.ndarray, ...]:
        """(text, kind, where, how many, x, y) of the runs that may repeat."""
        a = np.flatnonzero(again(self.x))
        at = self.at
        if len(at):
            picks, which = np.unique(self.pick, return_inverse=True)
            at = at[again(self.pieces[picks] ^ np.uint64(1))[which]]
        text = np.searchsorted(self.w.first, at, "right") - 1
        halves = [word_runs(self.h, at, self.passage, seed) if len(at) else np.zeros(0, np.uint64) for seed in (14, 15)]
        return (
            np.concatenate([self.text[a], text]), np.repeat([0, 1], [len(a), len(at)]), np.concatenate([self.number[a], at - self.w.first[text]]),
            np.concatenate([self.many[a], np.full(len(at), self.passage)]), np.concatenate([self.x[a], halves[0]]), np.concatenate([self.y[a], halves[1]]),
        )


Sizes = tuple[int, int, int, int]


def _places(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("place").to_numpy(zero_copy_only=False).view(np.uint64)


def _counted(batches: Iterator[pa.RecordBatch], sizes: Sizes, sends: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The hashes of a slice's runs; one that it has more than once comes twice."""
    for batch in batches:
        texts = as_string(batch.column("text"), lower=True).filter(pa.array(sends(_places(batch))))
        for _, _, data, rows in slices(texts):
            h, n = np.unique(Runs(data, rows, sizes).hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(h, np.minimum(n, 2)).view(np.int64))], ["h"])


def _placed(batches: Iterator[pa.RecordBatch], sizes: Sizes, sends: Callable[[np.ndarray], np.ndarray], again: Filter) -> Iterator[pa.RecordBatch]:
    names = ["id", "digest", "kind", "at", "many", "x", "y"]
    for batch in batches:
        send = pa.array(sends(_places(batch)))
        ids, digest = batch.column("id").filter(send), batch.column("digest").filter(send)
        for a, b, data, rows in slices(as_string(batch.column("text"), lower=True).filter(send)):
            text, *numbers, x, y = Runs(data, rows, sizes).repeated(again)
            where = pa.array(a + text)
            arrays = [pa.array(v.astype(t)) for v, t in zip(numbers, (np.int8, np.int32, np.int32))]
            yield pa.RecordBatch.from_arrays([ids.take(where), digest.take(where), *arrays, pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names)


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, text, digest, place) of the rows with text; a place is a doc_id with a text."""
    rows = picked(docs, id="doc_id", text="text").where("text IS NOT NULL")
    rows = rows.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("digest"))
    return rows.withColumn("place", F.xxhash64(F.lit(51), F.coalesce("id", F.lit(-1)), F.col("id").isNull(), "digest"))


def _copies(rows: DataFrame) -> tuple[DataFrame, Callable[[np.ndarray], np.ndarray]]:
    """(id, digest) of the places whose text an earlier id has in full, and a test of place hashes.

    The test is true of every place that isn't such a copy, and of few that are.
    """
    slim = rows.select("id", "digest", "place", F.xxhash64(F.lit(52), "text").alias("other")).distinct()
    first = slim.groupBy("digest", "other").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("digest").alias("f_digest"), F.col("other").alias("f_other"), F.col("first.id").alias("f_id"), F.lit(True).alias("several"))
    on = (F.col("digest") == F.col("f_digest")) & (F.col("other") == F.col("f_other"))
    marked = slim.join(first.hint("merge"), on, "left")
    copy = F.coalesce(F.col("several") & ~same(F.col("id"), F.col("f_id")), F.lit(False))
    marked = written(marked.select("id", "digest", "place", copy.alias("copy")), "span-places")
    copies = sieve(marked.where("copy").select("place"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(copies(_places(batch))))

    # those that the filter takes for copies and that are none
    mistaken = sieve(marked.where("NOT copy").select("place").mapInArrow(passing, "place long")) if copies.bits is None or len(copies.bits) else copies
    return marked.where("copy").select("id", "digest"), lambda h: ~copies(h) | mistaken(h)


_MERGED = "id long, digest long, numbers array<struct<lo:int,hi:int>>, words array<struct<lo:int,hi:int>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites what overlaps or touches; rows come by id, digest, kind, lo, hi, and leave as one for each text."""
    names = ["id", "digest", "kind", "lo", "hi"]
    held: pa.Table | None = None

    def united(t: pa.Table) -> pa.Table:
        keys = pc.fill_null(t["id"], 0).to_numpy(), t["id"].is_null().to_numpy(), t["digest"].to_numpy(), t["kind"].to_numpy()
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        start, end = t["lo"].to_numpy().astype(np.int64), t["hi"].to_numpy().astype(np.int64)
        lift = np.cumsum(new) << np.int64(32)
        reach = np.maximum.accumulate(end + lift)
        island = new.copy()
        island[1:] |= start[1:] + lift[1:] > reach[:-1]
        at = np.flatnonzero(island)
        last = np.append(at[1:], t.num_rows) - 1
        out = t.take(pa.array(at))
        return out.set_column(4, "hi", pa.array((reach[last] - lift[last]).astype(np.int32)))

    def rows(t: pa.Table) -> pa.RecordBatch:
        null, ids, digest, kind = t["id"].is_null().to_numpy(), pc.fill_null(t["id"], 0).to_numpy(), t["digest"].to_numpy(), t["kind"].to_numpy()
        new = np.ones(t.num_rows, bool)
        new[1:] = (ids[1:] != ids[:-1]) | (digest[1:] != digest[:-1]) | (null[1:] != null[:-1])
        at, who = np.flatnonzero(new), np.cumsum(new) - 1
        lists = []
        for k in (0, 1):
            pick = kind == k
            bounds = np.concatenate([[0], np.cumsum(np.bincount(who[pick], minlength=len(at)))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([t[n].combine_chunks().filter(pa.array(pick)) for n in ("lo", "hi")], ["lo", "hi"])
            lists.append(pa.ListArray.from_arrays(pa.array(bounds), pairs))
        first = t.take(pa.array(at))
        return pa.RecordBatch.from_arrays([first["id"].combine_chunks(), first["digest"].combine_chunks(), *lists], ["id", "digest", "numbers", "words"])

    for batch in batches:
        new = pa.Table.from_batches([batch]).select(names)
        t = united(pa.concat_tables([held, new]).combine_chunks() if held is not None else new)
        if not t.num_rows:
            continue
        last = pc.equal(t["digest"], t["digest"][-1])
        last = pc.and_(last, t["id"].is_null() if not t["id"][-1].is_valid else pc.fill_null(pc.equal(t["id"], t["id"][-1]), False)).to_numpy()
        begin = t.num_rows - int(np.argmin(np.append(last[::-1], False)))
        if begin:
            yield rows(t.slice(0, begin))
        held = t.slice(begin)
    if held is not None and held.num_rows:
        yield rows(held)


def repeats(docs: DataFrame, sizes: Sizes = (SENTENCES, WORDS, PASSAGE, PIECE)) -> DataFrame:
    """(id, digest, place, whole, numbers, words): what each text that repeats anything is to lose.

    numbers and words are (lo, hi) of sentences and of words; ``whole``: whatever runs cover.
    """
    rows = _keyed(docs)
    copies, sends = _copies(rows)
    counts = rows.select("text", "place").mapInArrow(lambda it: _counted(it, sizes, sends), "h long").groupBy("h").count()
    again = sieve(written(counts.where("count > 1").select("h"), "span-hashes"))
    places = rows.mapInArrow(lambda it: _placed(it, sizes, sends, again), "id long, digest long, kind byte, at int, many int, x long, y long")
    places = written(places, "span-runs")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "at")
    first = places.groupBy("kind", "x", "y").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # plans are the same at every size: what repeats grows with the corpus and is never broadcast
    later = places.join(first.drop("n").hint("merge"), ["kind", "x", "y"])
    own = same(F.col("id"), F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    # a passage that overlaps its own first place leaves that whole
    begin = F.when(own & (F.col("kind") == 1), F.greatest("at", F.col("first.at") + sizes[2])).otherwise(F.col("at"))
    later = later.where(~(own & (F.col("at") == F.col("first.at")))).select("id", "digest", "kind", begin.alias("lo"), (F.col("at") + F.col("many")).alias("hi")).where("lo < hi")
    by_text = later.repartition(F.xxhash64("id", "digest")).sortWithinPartitions("id", "digest", "kind", "lo", "hi")
    found = by_text.mapInArrow(_merged, _MERGED).withColumn("whole", F.lit(False))
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>")
    found = found.unionByName(copies.select("id", "digest", none.alias("numbers"), none.alias("words"), F.lit(True).alias("whole")))
    found = found.groupBy("id", "digest").agg(F.max("whole").alias("whole"), F.first("numbers", True).alias("numbers"), F.first("words", True).alias("words"))
    return written(found, "span-repeats")


_CUT = "struct<text:string,sentences:int,removed:int>"
_CUT_TYPE = pa.struct([("text", pa.string()), ("sentences", pa.int32()), ("removed", pa.int32())])


def _without(texts: pa.Array, whole: pa.Array, numbers: pa.Array, words: pa.Array, sizes: Sizes) -> pa.Array:
    """Each text less its repeats, its sentences, and how many of them lost words."""
    out: list[tuple[str, int, int]] = []
    low = as_string(texts, lower=False)
    for a, b, data, rows in slices(low):
        s = Sentences(data, rows)
        runs = s.runs(*sizes[:2]) if pc.any(whole.slice(a, b - a)).as_py() else None
        for i in range(a, b):
            k = i - a
            n = int(s.first[k + 1] - s.first[k])
            w = int(s.words.counts[k])
            lost, cut = np.zeros(n + 1, np.int64), np.zeros(w + 1, np.int64)
            if whole[i].as_py():
                mine = runs[0] == k
                np.add.at(lost, runs[1][mine], 1)
                np.add.at(lost, runs[1][mine] + runs[2][mine], -1)
                if w >= sizes[2]:
                    cut[0] = 1
            for spans, step in ((numbers[i], lost), (words[i], cut)):
                if spans.is_valid:
                    np.add.at(step, spans.values.field("lo").to_numpy(), 1)
                    np.add.at(step, spans.values.field("hi").to_numpy(), -1)
            gone = np.cumsum(lost[:-1]) > 0
            if gone.any() or cut.any():
                gone, raw = _cut(s, k, gone, np.cumsum(cut[:-1]) > 0, data)
                out.append((raw.decode(), n, int(gone.sum())))
            else:
                out.append((texts[i].as_py(), n, 0))
    return pa.StructArray.from_arrays([pa.array([o[j] for o in out], t.type) for j, t in enumerate(_CUT_TYPE)], fields=list(_CUT_TYPE))


def _cut(s: Sentences, k: int, gone: np.ndarray, cut: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Which sentences of text ``k`` lose words, and its bytes less the sentences ``gone`` and the words ``cut``.

    A word goes with what stands between it and the next word of its text.
    """
    lo, hi, a, b = s.first[k], s.first[k + 1], s.words.first[k], s.words.first[k + 1]
    sizes = np.diff(s.word[lo : hi + 1])
    cut = np.repeat(gone, sizes) | cut
    touched = np.bitwise_or.reduceat(cut, np.cumsum(sizes) - sizes)
    begin = s.words.start[a:b].copy()
    firsts = s.word[lo:hi] - a
    begin[firsts] = s.start[lo:hi]
    bounds = np.append(begin, s.words.rows[k + 1])
    edges = np.flatnonzero(np.diff(np.concatenate([[True], cut, [True]])))
    return touched, b"".join(data[bounds[x] : bounds[y]].tobytes() for x, y in zip(edges[::2], edges[1::2])).rstrip()


def _applied(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """``docs`` by position with ``cut``, a struct of text, sentences and removed; null for a null text."""
    found = repeats(docs, sizes)
    hit = sieve(found.select(F.xxhash64(F.lit(51), F.coalesce("id", F.lit(-1)), F.col("id").isNull(), "digest").alias("place")))
    at_id, at_text = F.col(f"c{column(docs, 'doc_id')}").cast("long"), F.col(f"c{column(docs, 'text')}")
    p = positional(docs).withColumn("digest", F.xxhash64(at_text))
    place = F.xxhash64(F.lit(51), F.coalesce(at_id, F.lit(-1)), at_id.isNull(), "digest")

    def may_lose(places: pa.Array) -> pa.Array:
        return pa.array(hit(places.to_numpy(zero_copy_only=False).view(np.uint64)))

    def sentences(texts: pa.Array) -> pa.Array:
        out = [np.diff(Sentences(data, rows).first) for _, _, data, rows in slices(as_string(texts))]
        return pa.array(np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32))

    def cut(*columns: pa.Array) -> pa.Array:
        return _without(*columns, sizes)

    p = p.withColumn("may", at_text.isNotNull() & F.arrow_udf(may_lose, "boolean")(place))
    # most texts lose nothing and stay where they are
    as_is = F.struct(at_text.alias("text"), F.arrow_udf(sentences, "int")(at_text).alias("sentences"), F.lit(0).alias("removed"))
    stay = p.where("NOT may").withColumn("cut", as_is)
    lose = found.select(F.col("id").alias("f_id"), F.col("digest").alias("f_digest"), "whole", "numbers", "words")
    met = p.where("may").join(lose.hint("merge"), (F.col("digest") == F.col("f_digest")) & same(at_id, F.col("f_id")), "left")
    met = met.withColumn("cut", F.arrow_udf(cut, _CUT)(at_text, F.coalesce("whole", F.lit(False)), "numbers", "words"))
    return stay.select(*stay.columns[: len(docs.columns)], "cut").unionByName(met.select(*stay.columns[: len(docs.columns)], "cut"))


def substring_dedup(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, text, sentences, removed): every document with its text less the repeats.

    Other columns are left out; ``without_repeats`` keeps them.  ``removed`` counts the sentences
    that lost words; a long passage may begin and end within one, whose other words stay.

    A document of which nothing repeats keeps its text byte for byte; one of which all does is left
    with an empty text, and stays a row.  A null text stays null with 0 sentences.  Texts shorter
    than a run lose nothing.  Rows with one doc_id and the same text are one place and are cut
    alike; with different texts they are different places.  doc_id is taken as a long; null ids
    come last.  No documents, no rows.
    """
    out = _applied(docs, (sentences, words, passage, PIECE))
    return out.select(F.col(f"c{column(docs, 'doc_id')}").cast("long").alias("doc_id"), "cut.text", "cut.sentences", "cut.removed")


def without_repeats(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, passage: int = PASSAGE) -> DataFrame:
    """The documents with their texts less the repeats, columns as they were; n_chars, if any, follows the text."""
    out = _applied(docs, (sentences, words, passage, PIECE))
    at = f"c{column(docs, 'text')}"
    if "n_chars" in [c.lower() for c in docs.columns]:
        n = f"c{column(docs, 'n_chars')}"
        out = out.withColumn(n, F.when(F.col("cut.removed") > 0, F.length("cut.text").cast(out.schema[n].dataType)).otherwise(F.col(n)))
    return restored(out.withColumn(at, F.when(F.col(at).isNotNull(), F.col("cut.text"))), docs)
