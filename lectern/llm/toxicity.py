"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text are rates per word: hits of a seed lexicon and of a lexicon learnt from the
labels, of whole words and of word beginnings; hits near a second-person pronoun; capitals;
punctuation; and signs of obfuscation (digits or symbols standing for letters, drawn-out letters).
All are computed over whole texts, on bytes.

The labelled documents are sampled, at most ``SAMPLE`` of them, by hash of their id, and split by
another hash: half to learn the lexicon, three tenths to grow the trees, the rest to calibrate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, picked, positional, restored, written
from .kernel import Words, as_string, slices, word_hash

SAMPLE, THRESHOLD = 20_000, 0.5
#: A learnt entry has been in so many toxic documents at least, and so many of its documents are toxic.
LEAST_DOCUMENTS, LEAST_SHARE = 6, 0.8
STEMS = (4, 5, 6)
NEAR = 4

SEEDS = (
    "idiot moron stupid clown loser trash scum pathetic worthless disgusting dumb fool jerk hate kill shut garbage vermin filth "
    "ugly coward liar imbecile cretin hideous crap damn bastard bitch "
    "connard salaud crétin débile ordure minable abruti dumm idiotin trottel abschaum widerlich arschloch "
    "estúpido imbécil basura asqueroso inútil patético"
).split()
SECOND_PERSON = "you your yours yourself ya u tu te toi vous votre vos du dich dir dein deine ihr euch usted tú ti vos ustedes tus".split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEET = _LOWER.copy()
for _a, _b in zip("013457$@!|", "oieastsail"):
    _LEET[ord(_a)] = ord(_b)
_IS = {
    name: np.isin(np.arange(256), [*map(ord, chars)])
    for name, chars in {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "loud": "!?", "marks": "#$%&*+/<=>@\\^_|~()[]{};:\"", "digit": "0123456789", "sign": "$@*"}.items()
}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

NAMES = (
    "seed_rate seed_log learnt_rate learnt_log stem_rate stem_log near_second second_rate capitals shouted loud marks "
    "mixed drawn_out hidden_rate words_log"
).split()


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, byte for byte."""
    low = _LOWER[data]
    if len(low) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[at] += 0x20
    return low


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def stem_hashes(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length in STEMS the words that are longer and the hashes of their beginnings."""
    out = []
    for n in STEMS:
        at = np.flatnonzero(w.end - w.start > n)
        out.append((at, w.hash(w.start[at], w.start[at] + n) ^ np.uint64(n)))
    return out


def features(data: np.ndarray, rows: np.ndarray, learnt: np.ndarray, stems: np.ndarray) -> np.ndarray:
    """float64[texts, features]; ``learnt`` and ``stems`` are sorted hashes."""
    low = lowered(data)
    w = Words(low, rows)
    h, n = w.hashes, w.counts
    text = np.repeat(np.arange(len(n)), n)
    per = lambda hit, at=text: np.bincount(at[hit], minlength=len(n)).astype(float)
    words = np.maximum(n, 1)
    seed, know = _member(h, _seeds()), _member(h, learnt)
    begin = np.zeros(len(h), bool)
    for at, x in stem_hashes(w):
        begin[at[_member(x, stems)]] = True
    second = _member(h, _second())
    at = np.flatnonzero(second)
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, np.maximum(at - NEAR, w.first[text[at]]), 1)
    np.add.at(step, np.minimum(at + NEAR + 1, w.first[text[at] + 1]), -1)
    near = np.cumsum(step[:-1]) > 0
    hit = seed | know | begin
    # bytes
    length = np.maximum(np.diff(rows), 1)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[rows]).astype(float)
    letters = np.maximum(count(_LETTER), 1)
    caps = np.concatenate([[0], np.cumsum(_IS["upper"][data])])
    size = w.end - w.start
    shouted = (caps[w.end] - caps[w.start] == size) & (size > 2)
    digits = np.concatenate([[0], np.cumsum(_IS["digit"][data])])
    has = digits[w.end] - digits[w.start]
    mixed = (has > 0) & (has < size)
    drawn = np.zeros(len(data) + 1, np.int64)
    if len(data) > 2:
        drawn[3:] = np.cumsum((low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[low[2:]])
        drawn[:3] = 0
    long_drawn = (size > 2) & (drawn[w.end] - drawn[np.minimum(w.start + 2, w.end)] > 0)
    # what only reads as a lexicon word once digits and symbols are letters
    leet = Words(_LEET[low], rows)
    lh = leet.hashes
    masked = _member(lh, _seeds()) | _member(lh, learnt)
    hidden = np.bincount(np.repeat(np.arange(len(n)), leet.counts)[masked], minlength=len(n)) - per(seed | know)
    return np.stack(
        [
            per(seed) / words, np.log1p(per(seed)), per(know) / words, np.log1p(per(know)), per(begin) / words, np.log1p(per(begin)),
            per(hit & near) / words, per(second) / words, count(_IS["upper"]) / letters, per(shouted) / words, count(_IS["loud"]) / words,
            count(_IS["marks"]) / length, per(mixed) / words, per(long_drawn) / words, np.maximum(hidden, 0) / words, np.log1p(n),
        ],
        axis=1,
    )


_known: dict[str, np.ndarray] = {}


def _hashes(key: str, words: list[str]) -> np.ndarray:
    if key not in _known:
        _known[key] = np.unique(np.array([word_hash(x) for x in words], np.uint64))
    return _known[key]


def _seeds() -> np.ndarray:
    return _hashes("seeds", SEEDS)


def _second() -> np.ndarray:
    return _hashes("second", SECOND_PERSON)


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss; features are cut into at most 64 bins."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    least: float = 1.0  # hessian in a leaf
    l2: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
        # rare hits lie in the top of a quantile grid: give positive values a grid of their own
        for j in range(x.shape[1]):
            some = x[x[:, j] > 0, j]
            if 0 < len(some) < len(x):
                self.edges[j] = np.unique(np.concatenate([[0.0], np.quantile(some, np.linspace(0, 1, 33)[:-1]) * (1 - 1e-12), self.edges[j]]))
        bins = self._bins(x)
        self.trees: list[list[tuple[int, int, float]]] = []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            nodes, at = self._grow(bins, p - y, p * (1 - p))
            self.trees.append(nodes)
            score += np.array([v for _, _, v in nodes])[at]
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        """A full binary tree as (feature, bin, value) by heap position; feature -1: a leaf."""
        size = 2 ** (self.depth + 1) - 1
        nodes: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * size
        at = np.zeros(len(g), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, -1, 0)
            if node < size // 2:
                for j in range(bins.shape[1]):
                    b = bins[rows, j]
                    m = len(self.edges[j]) + 1
                    gl, hl = np.cumsum(np.bincount(b, g[rows], m))[:-1], np.cumsum(np.bincount(b, h[rows], m))[:-1]
                    if not len(gl):
                        continue
                    gain = gl**2 / (hl + self.l2) + (G - gl) ** 2 / (H - hl + self.l2) - G**2 / (H + self.l2)
                    gain[(hl < self.least) | (H - hl < self.least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] < 0:
                nodes[node] = (-1, 0, float(-self.rate * G / (H + self.l2)))
            else:
                nodes[node] = (best[1], best[2], 0.0)
                at[rows] = np.where(bins[rows, best[1]] <= best[2], 2 * node + 1, 2 * node + 2)
        return nodes, at

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        bins = self._bins(x)
        for nodes in self.trees:
            feature, cut, value = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = 2 * at + 1 + (bins[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = np.where(f < 0, at, go)
            out += value[at]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: scores ascending, and the calibrated probability at each.

    Half a success and half a failure are added to each block's count, so that a short
    calibration set doesn't claim certainty.
    """
    at, first = np.unique(score, return_inverse=True)
    weight = np.bincount(first).astype(float)
    total = np.bincount(first, y)
    blocks: list[list[float]] = []  # sum, weight, entries
    for s, w in zip(total, weight):
        blocks.append([s, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    value = np.concatenate([np.full(int(n), (s + 0.5) / (w + 1)) for s, w, n in blocks]) if blocks else np.zeros(0)
    return at, np.maximum.accumulate(value)


@dataclass
class Model:
    learnt: np.ndarray
    stems: np.ndarray
    trees: Trees | None
    at: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(rows) - 1, self.base)
        s = self.trees.score(features(data, rows, self.learnt, self.stems))
        return np.interp(s, self.at, self.value) if len(self.at) else 1 / (1 + np.exp(-s))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and how many other documents each word or stem is."""
    for batch in batches:
        texts, toxic = as_string(batch.column("text")), batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, rows in slices(texts):
            w = Words(lowered(data), rows)
            text = np.repeat(np.arange(b - a), w.counts)
            kinds = [(0, text, w.hashes), *((n, text[at], x) for n, (at, x) in zip(STEMS, stem_hashes(w)))]
            for kind, who, h in kinds:
                order = np.lexsort((who, h))
                h, who = h[order], who[order]
                if not len(h):
                    continue
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])
                h, who = h[new], who[new]
                cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                bad = np.add.reduceat(toxic[a + who], cut)
                many = np.diff(np.append(cut, len(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[cut].view(np.int64)), pa.array(np.full(len(cut), kind, np.int32)), pa.array(bad), pa.array(many - bad)], ["h", "kind", "bad", "good"]
                )


def _featured(batches: Iterator[pa.RecordBatch], learnt: np.ndarray, stems: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, rows in slices(as_string(batch.column("text"))):
            x = features(data, rows, learnt, stems)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part")[a:b], batch.column("toxic")[a:b], *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["part", "toxic", *NAMES]
            )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the documents that ``labels`` (doc_id, toxic) covers.

    A doc_id that is labelled more than once counts as toxic if any label says so; null labels,
    ids and texts are left out.  Without documents of both classes in every part that needs
    them, the model gives all texts the share of toxic labels (0 without labels).
    """
    known = picked(labels, l_id="doc_id", toxic="toxic").where("l_id IS NOT NULL AND toxic IS NOT NULL").groupBy("l_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = picked(docs, id="doc_id", text="text").where("text IS NOT NULL")
    # the sample is bounded, so it can be broadcast; the part is drawn from another hash
    rows = rows.join(F.broadcast(known), F.col("id") == F.col("l_id"))
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(10)).cast("int")
    rows = written(rows.select("text", "toxic", part.alias("part")), "toxic-sample")
    share = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()
    total, bad = sum(r.n for r in share), sum(r.bad for r in share)
    none = np.zeros(0, np.uint64)
    flat = Model(none, none, None, np.zeros(0), np.zeros(0), bad / total if total else 0.0)
    counted = rows.where("part < 5").mapInArrow(_counted, "h long, kind int, bad long, good long")
    words = counted.groupBy("h", "kind").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    words = words.where((F.col("bad") >= LEAST_DOCUMENTS) & (F.col("bad") >= LEAST_SHARE * (F.col("bad") + F.col("good"))))
    words = words.select("h", "kind").toPandas()
    learnt, stems = (np.sort(words.h[pick].to_numpy(np.int64).view(np.uint64)) for pick in (words.kind == 0, words.kind > 0))
    schema = "part int, toxic int, " + ", ".join(f"{n} double" for n in NAMES)
    table = rows.where("part >= 5").mapInArrow(lambda it: _featured(it, learnt, stems), schema).toPandas()
    table = table.sort_values(["part", "toxic", *NAMES])  # the order in which rows arrive is not fixed
    x, y, grow = table[NAMES].to_numpy(), table.toxic.to_numpy(float), (table.part < 8).to_numpy()
    if not 0 < y[grow].sum() < grow.sum():
        return flat
    trees = Trees().fit(x[grow], y[grow])
    calibrate = ~grow if 0 < y[~grow].sum() < (~grow).sum() else grow
    return Model(learnt, stems, trees, *isotonic(trees.score(x[calibrate]), y[calibrate]), flat.base)


def _probability(texts: pa.Array, model: Model) -> pa.Array:
    parts = [model.probability(data, rows) for _, _, data, rows in slices(as_string(texts))]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0), mask=texts.is_null().to_numpy(zero_copy_only=False))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` by position (c0, c1, ...) with ``probability``; only texts go through Python."""

    def probability(texts: pa.Array) -> pa.Array:
        return _probability(texts, model)

    return positional(docs).withColumn("probability", F.arrow_udf(probability, "double")(F.col(f"c{column(docs, 'text')}")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, probability, toxic) for every document.

    A null text has a null probability and is not toxic; an empty one is scored as any other.
    Rows with equal texts get equal scores, whatever their ids.
    """
    out = scored(picked(docs, doc_id="doc_id", text="text"), train(docs, labels, sample))
    return out.select(F.col("c0").alias("doc_id"), F.col("probability"), F.coalesce(F.col("probability") >= threshold, F.lit(False)).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that aren't toxic, columns as they were.

    Null texts stay, empty ones are scored as any other, and rows with equal texts stay or go
    together, each as a row of its own.  No documents, no rows.
    """
    out = scored(docs, train(docs, labels, sample))
    return restored(out.where(F.coalesce(F.col("probability") < threshold, F.lit(True))), docs)
