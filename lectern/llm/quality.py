"""Quality: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers vote good, bad or nothing on every document, from rates over its whole text; several look
at one fault in different ways, and those overlaps tell the model whom to trust.  How often each
combination of votes occurs is counted over the whole corpus; expectation-maximisation on those
counts estimates, for each labeller apart, how it votes on good documents and on bad ones when it
votes at all, and so each combination's posterior of being good.

The posteriors of at most ``SAMPLE`` documents, drawn by hash, train a linear scorer over hashed
features: words, runs of three bytes with their case and signs, and the words' shapes: length, case,
what follows, and whether the word before is the same.  A document's score is the
logistic of a bias and its features' mean weights, so it takes one pass over its bytes.
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

SAMPLE, THRESHOLD = 6_000, 0.5
DIMENSIONS, SHAPES = 1 << 17, 1 << 11
GOOD, NONE, BAD = 2, 1, 0

STOPWORDS = (
    "the of and to in a is that for it was on are with as at be this have from or by not but which you he she they we his her an "
    "le la les de des du et un une que qui dans en est pour pas sur par au aux plus ce il elle ne se son "
    "der die das und ist von zu den mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie dem "
    "el los las y por con no para su al lo como más pero sus o este sí porque entre"
).split()

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_UPPER, _LOWER, _SIGNS, _LOUD, _BARS, _LINES, _STOPS = (
    np.isin(np.arange(256), [*map(ord, x)])
    for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "#$%&*+/<=>@\\^_~[]{}", "!", "|", "\n", ".!?")
)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

LABELLERS = ("length", "stopwords", "signs", "capitals", "loud", "bars", "lines", "variety", "word_length", "sentences", "marks", "drawn", "echo")


def rates(data: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, of each text."""
    low = _LOW[data]
    w = Words(low, rows)
    h, n = w.hashes, w.counts
    text = np.repeat(np.arange(len(n)), n)
    many = np.maximum(n, 1)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[rows])
    stops = np.bincount(text[_member(h)], minlength=len(n))
    letters = np.maximum(count(_UPPER | _LOWER), 1)
    size = w.end - w.start
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][new], minlength=len(n))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    drawn = np.zeros(len(data), bool)
    drawn[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & ~_SPACE[data[2:]]
    for k in (0, 1):  # no run from one text into the next
        drawn[(at := rows[:-1] + k)[at < len(data)]] = False
    # lines, by the hash of all of their bytes
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    cut[1:] |= np.append(data == 10, False)[:-1] if len(data) else False
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(data))
    lh = w.hash(start, end - (data[end - 1] == 10)) if len(start) else np.zeros(0, np.uint64)
    line = np.searchsorted(rows, start, "right") - 1
    keep = end - start > 20
    line, lh = line[keep], lh[keep]
    order = np.lexsort((lh, line))
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (line[order][1:] == line[order][:-1])
    lines = np.bincount(line, minlength=len(n))
    repeats = np.bincount(line[order][again], minlength=len(n))
    return {
        "words": n,
        "stopwords": stops / many,
        "signs": count(_SIGNS) / many,
        "capitals": count(_UPPER) / letters,
        "loud": count(_LOUD) / many,
        "bars": count(_BARS) / many,
        "lines": repeats / np.maximum(lines, 1),
        "variety": distinct / np.sqrt(many),
        "word_length": np.bincount(text, size, len(n)) / many,
        "sentence": many / np.maximum(count(_STOPS), 1),
        "marks": count(_SIGNS) / np.maximum(np.diff(rows), 1),
        "drawn": np.diff(np.concatenate([[0], np.cumsum(drawn)])[rows]) / many,
        "echo": np.bincount(text[same], minlength=len(n)) / many,
    }


def _member(h: np.ndarray, _table: list = []) -> np.ndarray:  # noqa: B006
    if not _table:
        _table.append(np.unique(np.array([word_hash(x) for x in STOPWORDS], np.uint64)))
    t = _table[0]
    return t[np.minimum(np.searchsorted(t, h), len(t) - 1)] == h if len(h) else np.zeros(0, bool)


def votes(r: dict[str, np.ndarray]) -> np.ndarray:
    """uint8[texts, labellers]: GOOD, NONE or BAD; most say nothing of texts of under 20 words."""
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    n = r["words"]
    some = n >= 20
    between = lambda x, low, high: some & (x > low) & (x < high)
    less = lambda name, good, bad: pick(r[name] > bad, some & (r[name] < good))
    return np.stack(
        [
            pick(n < 3, n >= 30),
            pick(some & (r["stopwords"] < 0.08), between(r["stopwords"], 0.15, 0.5)),
            less("signs", 0.02, 0.2),
            pick(some & (r["capitals"] > 0.25), some & (r["capitals"] < 0.06)),
            less("loud", 0.02, 0.15),
            less("bars", 0.02, 0.15),
            less("lines", 0.05, 0.3),
            pick(some & (r["variety"] < 2), r["variety"] > 5),
            pick((r["word_length"] < 2.5) | (r["word_length"] > 14), between(r["word_length"], 4, 7)),
            pick(some & ((r["sentence"] > 80) | (r["sentence"] < 2)), between(r["sentence"], 4, 40)),
            less("marks", 0.01, 0.08),
            pick(some & (r["drawn"] > 0.2), some & (r["drawn"] < 0.02)),
            pick(some & (r["echo"] > 0.1), some & (r["echo"] < 0.02)),
        ],
        axis=1,
    ).astype(np.uint8)


def pattern(v: np.ndarray) -> np.ndarray:
    """One number for each combination of votes."""
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def unpacked(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(labellers)) % 3


@dataclass
class LabelModel:
    """Share of good documents, and what labellers say of each class when they vote: votes[class, labeller, vote].

    An abstention tells nothing: its entry is 1 for both classes.
    """

    good: float
    votes: np.ndarray

    def joint(self, v: np.ndarray) -> np.ndarray:
        """Logarithm of each class's share times the chance of the votes in it: float[rows, class]."""
        logs, at = np.log(self.votes), np.arange(v.shape[1])
        return np.stack([np.log(share) + logs[c][at, v].sum(axis=1) for c, share in enumerate((1 - self.good, self.good))], axis=1)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        joint = self.joint(v)
        return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -500, 500)))

    def likelihood(self, v: np.ndarray, count: np.ndarray) -> float:
        joint = self.joint(v)
        top = joint.max(axis=1)
        return float(((top + np.log(np.exp(joint - top[:, None]).sum(axis=1))) * count).sum())

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeller the chance that a vote is right, as estimated."""
        return self.good * self.votes[1, :, GOOD] + (1 - self.good) * self.votes[0, :, BAD]


def estimate(v: np.ndarray, count: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation from the unanimous start: bad if any labeller says bad.

    A pseudo-count keeps every probability positive; nothing else bounds what is estimated.
    """
    p = np.where((v == BAD).any(axis=1), 0.1, 0.9)
    m, before = LabelModel(0.5, np.full((2, v.shape[1], 3), 1.0)), -np.inf
    for _ in range(rounds):
        q = np.stack([(1 - p) * count, p * count])
        table = np.stack([[np.bincount(v[:, j], w, 3) for j in range(v.shape[1])] for w in q]) + 0.5
        table /= table[:, :, [BAD]] + table[:, :, [GOOD]]
        table[:, :, NONE] = 1
        m = LabelModel(float((q[1].sum() + 1) / (q.sum() + 2)), table)
        p, now = m.posterior(v), m.likelihood(v, count)
        if now - before < tolerance * max(1.0, abs(now)):
            break
        before = now
    return m


def hashed(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(features of words, bounds, features of byte runs, bounds, shapes): indices of weights."""
    w = Words(_LOW[data], rows)
    shape = shapes(data, w)
    half = DIMENSIONS // 2
    words = (w.hashes % np.uint64(half)).astype(np.int32)
    if len(data) < 3:
        return words, w.first, np.zeros(0, np.int32), np.zeros(len(rows), np.int64), shape
    code = data[:-2].astype(np.uint32) * np.uint32(0x01000193) ^ data[1:-1].astype(np.uint32) * np.uint32(0x85EBCA6B) ^ data[2:].astype(np.uint32) * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(13)
    inside = np.ones(len(code), bool)  # no run from one text into the next
    for k in (1, 2):
        at = rows[1:-1] - k
        inside[at[(at >= 0) & (at < len(code))]] = False
    bounds = np.concatenate([[0], np.cumsum(inside)])[np.minimum(rows, len(code))]
    return words, w.first, (half + code[inside] % np.uint32(half)).astype(np.int32), bounds, shape


def shapes(data: np.ndarray, w: Words) -> np.ndarray:
    """A feature of each word, below SHAPES beyond DIMENSIONS: what it looks like and what it stands beside."""
    h = w.hashes
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    size = w.end - w.start
    after = data[np.minimum(w.end, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    kind = np.select([w.end >= len(data), _STOPS[after], after == 44, after == 10, _SIGNS[after], _SPACE[after]], [0, 1, 2, 3, 4, 5], 6)
    code = np.minimum(size, 15) | echo << 4 | _UPPER[data[w.start]].astype(np.int64) << 5 | (upper[w.end] - upper[w.start] == size).astype(np.int64) << 6
    return (DIMENSIONS + (code | kind << 7 | _member(h).astype(np.int64) << 10)).astype(np.int32)


def _mean(weights: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


def score(data: np.ndarray, rows: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    words, first, runs, bounds, shape = hashed(data, rows)
    return 1 / (1 + np.exp(-np.clip(bias + _mean(weights, words, first) + _mean(weights, runs, bounds) + _mean(weights, shape, first), -60, 60)))


def fit(texts: pa.Array, target: np.ndarray, rounds: int = 12, rate: float = 4.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer by logistic regression on soft targets (AdaGrad, batches of 64)."""
    index, value, begin = [], [], [0]
    for _, _, data, rows in slices(as_string(texts)):
        words, first, runs, bounds, shape = hashed(data, rows)
        for i in range(len(rows) - 1):
            parts = [np.unique(x[a[i] : a[i + 1]], return_counts=True) for x, a in ((words, first), (runs, bounds), (shape, first))]
            for f, c in parts:
                index.append(f)
                value.append((c / c.sum()).astype(np.float32))
            begin.append(begin[-1] + sum(len(f) for f, _ in parts))
    index, value, begin = np.concatenate([np.zeros(0, np.int32), *index]), np.concatenate([np.zeros(0, np.float32), *value]), np.array(begin)
    weights, bias = np.zeros(DIMENSIONS + SHAPES), 0.0
    slope, slope_bias = np.full(len(weights), 1e-6), 1e-6
    random = np.random.default_rng(0)
    for _ in range(rounds):
        order = random.permutation(len(target))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            if not len(batch):
                continue
            n = begin[batch + 1] - begin[batch]
            at = np.repeat(begin[batch] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who = np.repeat(np.arange(len(batch)), n)
            f, x = index[at], value[at]
            p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(who, weights[f] * x, len(batch)), -60, 60)))
            error = p - target[batch]
            g = np.bincount(f, error[who] * x, len(weights)) / len(batch)
            slope += g * g
            weights -= rate * g / np.sqrt(slope)
            slope_bias += error.mean() ** 2
            bias -= 0.1 * error.mean() / np.sqrt(slope_bias)
    return weights, bias


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_string(batch.column("text"))
        out = [pattern(votes(rates(data, rows))) for _, _, data, rows in slices(texts)]
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(out))], ["id", "pattern"])


@dataclass
class Quality:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, sample: int = SAMPLE) -> Quality:
    """The model of these documents; null texts are left out, equal rows count as often as they are there."""
    rows = picked(docs, id="doc_id", text="text").where("text IS NOT NULL").select(F.xxhash64("text").alias("id"), "text")
    found = rows.mapInArrow(_patterns, "id long, pattern long")
    seen = written(found, "votes")
    counts = seen.groupBy("pattern").count().orderBy("pattern").toPandas()  # at most 3 to the number of labellers
    v = unpacked(counts.pattern.to_numpy(np.int64), len(LABELLERS)) if len(counts) else np.zeros((0, len(LABELLERS)), np.int64)
    model = estimate(v, counts["count"].to_numpy(float))
    posterior = model.posterior(v)
    by_pattern = dict(zip(counts.pattern.tolist(), posterior.tolist()))
    # the least hashes are a sample that only the texts decide
    chosen = seen.groupBy("id").agg(F.min("pattern").alias("pattern")).orderBy("id").limit(sample)
    chosen = written(chosen.withColumnRenamed("id", "s_id"), "quality-sample")
    texts = rows.join(F.broadcast(chosen), F.col("id") == F.col("s_id")).groupBy("s_id").agg(F.first("text").alias("text"), F.first("pattern").alias("pattern"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("s_id", pa.int64()), ("text", pa.string()), ("pattern", pa.int64())])).sort_by("s_id")
        target = np.array([by_pattern[x] for x in table["pattern"].to_pylist()])
        weights, bias = fit(table["text"].combine_chunks(), target)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([bias])], ["weights", "bias"])

    [best] = texts.coalesce(1).mapInArrow(fitted, "weights binary, bias double").collect() or [None]
    if best is None:
        return Quality(model, np.zeros(DIMENSIONS + SHAPES, np.float32), 0.0)
    return Quality(model, np.frombuffer(best.weights, "<f4"), best.bias)


def scored(docs: DataFrame, model: Quality) -> DataFrame:
    """``docs`` by position (c0, c1, ...) with ``score``."""
    weights, bias = model.weights, model.bias

    def scores(texts: pa.Array) -> pa.Array:
        out = [score(data, rows, weights, bias) for _, _, data, rows in slices(as_string(texts))]
        return pa.array(np.concatenate(out) if out else np.zeros(0), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return positional(docs).withColumn("score", F.arrow_udf(scores, "double")(F.col(f"c{column(docs, 'text')}")))


def quality(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep) for every document.

    A null text has a null score and isn't kept; an empty one is scored by the bias alone.  Equal
    texts have equal scores.  Without any document to learn from, all scores are a half.
    """
    out = scored(picked(docs, doc_id="doc_id", text="text"), train(docs, sample))
    return out.select(F.col("c0").alias("doc_id"), "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("keep"))


def of_quality(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents to keep, columns as they were; null texts go."""
    return restored(scored(docs, train(docs, sample)).where(F.col("score") >= threshold), docs)
