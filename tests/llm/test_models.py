import os

import numpy as np
import pytest

from lectern.llm import quality, toxicity

DATA = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.01")
#: Some hundreds of toxic labels are needed to learn from a part and judge by the rest.
LARGER = "/root/testdata/sf0.1"
ODD = [(1, "plain text of words. " * 10, 1), (1, "plain text of words. " * 10, 2), (2, None, 3), (None, "", 4), (3, "word " * 30_000, 5)]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score int")


def labelled(spark):
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    return (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))


def test_toxicity_on_labels(spark):
    docs, labels = labelled(spark)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    hit = [found[i].toxic for i, t in truth.items() if t]
    false = [found[i].toxic for i, t in truth.items() if not t]
    assert np.mean(hit) > 0.6 and np.mean(false) < 0.05


def plain_features(text, learnt, stems):
    """The features of an ASCII text, from their definitions, a word at a time."""
    import re

    words = [(m[0], m.start()) for m in re.finditer("[0-9A-Za-z]+", text)]
    low = [w.lower() for w, _ in words]
    n, many, t = max(len(words), 1), len(words), toxicity
    leet = str.maketrans("013457$@!|", "oieastsail")
    seed, know = [w in t.SEEDS for w in low], [w in learnt for w in low]
    begin = [any(len(w) > k and w[:k] in stems for k in t.STEMS) for w in low]
    second = [w in t.SECOND_PERSON for w in low]
    near = [any(second[max(0, i - t.NEAR) : i + t.NEAR + 1]) for i in range(many)]
    hit = [a or b or c for a, b, c in zip(seed, know, begin)]
    letters = max(sum(c.isalpha() for c in text), 1)
    hidden = sum(w in t.SEEDS or w in learnt for w in re.findall("[0-9A-Za-z]+", text.lower().translate(leet))) - sum(a or b for a, b in zip(seed, know))
    rate = lambda v: sum(map(bool, v)) / n
    log = lambda v: np.log1p(sum(map(bool, v)))
    return [
        rate(seed), log(seed), rate(know), log(know), rate(begin), log(begin), rate(a and b for a, b in zip(hit, near)), rate(second),
        sum(c.isupper() for c in text) / letters, rate(len(w) > 2 and w.isupper() and w.isalpha() for w, _ in words), sum(c in "!?" for c in text) / n,
        sum(c in "#$%&*+/<=>@\\^_|~()[]{};:\"" for c in text) / max(len(text), 1), rate(any(c.isdigit() for c in w) and not w.isdigit() for w, _ in words),
        rate(re.search(r"([a-zA-Z])\1\1", w.lower()) for w, _ in words), max(hidden, 0) / n, np.log1p(many),
    ]


def test_features_against_a_plain_loop():
    import random

    r = random.Random(8)
    bits = ["you", "are", "an", "idiot", "1d10t", "STUPID", "stuuuupid", "loser!", "word", "other", "your", "##", "a1", "123", "Trash?", "($)", "l0ser", "grumblings", "\n"]
    texts = ["", "!", "you"] + [" ".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(80)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    from lectern.llm.kernel import word_hash

    learnt = np.sort(np.array([word_hash("word")], np.uint64))
    stems = np.sort(np.array([word_hash("grumb") ^ 5], np.uint64))
    got = toxicity.features(data, rows, learnt, stems)
    for i, t in enumerate(texts):
        assert np.allclose(got[i], plain_features(t, {"word"}, {"grumb"})), (t, dict(zip(toxicity.NAMES, got[i])), plain_features(t, {"word"}, {"grumb"}))


def test_toxicity_on_documents_that_it_has_not_seen(spark):
    if not os.path.isdir(LARGER):
        pytest.skip(f"no tables in {LARGER}")
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("pmod(xxhash64(doc_id), 3) > 0"))
    rest = labels.where("pmod(xxhash64(doc_id), 3) = 0").withColumnRenamed("doc_id", "l_id")
    found = toxicity.scored(docs.join(rest, docs.doc_id == rest.l_id), model).select("probability", "c7").toPandas()
    hit = found.probability[found.c7 == 1] >= toxicity.THRESHOLD
    false = found.probability[found.c7 == 0] >= toxicity.THRESHOLD
    print("held out", len(hit), hit.mean(), len(false), false.mean())
    assert hit.mean() > 0.6 and false.mean() < 0.05


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd(spark), labels).collect()
    assert len(out) == len(ODD) and [r.probability for r in out if r.doc_id == 2] == [None]
    assert not any(r.toxic for r in out if r.doc_id == 2)
    kept = toxicity.without_toxic(odd(spark), labels.limit(0))
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == len(ODD)
    clash = odd(spark).selectExpr("doc_id", "text", "score AS probability", "score AS toxic", "score AS c0")
    out = toxicity.without_toxic(clash, labels)
    assert out.columns == clash.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in clash.collect()}
    assert toxicity.toxicity(odd(spark).limit(0), labels).count() == 0


def test_isotonic_calibration_is_monotone_and_keeps_the_mean():
    r = np.random.default_rng(1)
    s = r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-2 * s))).astype(float)
    at, value = toxicity.isotonic(s, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) >= 0).all() and abs(value.mean() - y.mean()) < 0.05


def test_trees_learn_what_no_line_can():
    r = np.random.default_rng(2)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.Trees().fit(x[:1500], y[:1500])
    assert ((trees.score(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_quality_on_labels(spark):
    docs, labels = labelled(spark)
    found = {r.doc_id: r.keep for r in quality.quality(docs).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [found[i] for i, q in truth.items() if q]
    bad = [found[i] for i, q in truth.items() if not q]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1 and len(found) == docs.count()


def test_expectation_maximisation_finds_accuracies():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.7
    accuracy = [0.9, 0.8, 0.85, 0.95]
    v = np.stack([np.where(r.random(len(truth)) < 0.3, quality.NONE, np.where((r.random(len(truth)) < a) == truth, quality.GOOD, quality.BAD)) for a in accuracy], axis=1)
    p, n = np.unique(quality.pattern(v), return_counts=True)
    m = quality.estimate(quality.unpacked(p, 4), n.astype(float))
    assert abs(m.good - 0.7) < 0.05 and np.abs(m.accuracy - accuracy).max() < 0.06


def test_expectation_maximisation_against_direct_likelihood():
    """No small step from the estimate makes the votes likelier, by the sum over every document's two classes."""
    r = np.random.default_rng(5)
    truth = r.random(3000) < 0.8
    v = np.stack([np.where(r.random(3000) < 0.4, 1, np.where((r.random(3000) < a) == truth, 2, 0)) for a in (0.9, 0.6, 0.35, 0.95, 0.8)], axis=1)
    p, n = np.unique(quality.pattern(v), return_counts=True)
    u = quality.unpacked(p, 5)
    m = quality.estimate(u, n.astype(float))
    assert np.abs(m.accuracy - [0.9, 0.6, 0.35, 0.95, 0.8]).max() < 0.06  # one is wrong more often than right

    def direct(good, votes):
        total = 0.0
        for row, many in zip(u, n):
            classes = [1 - good, good]
            for c in (0, 1):
                for j, vote in enumerate(row):
                    classes[c] *= 1.0 if vote == 1 else votes[c, j, vote]
            total += many * np.log(sum(classes))
        return total

    best = direct(m.good, m.votes)
    assert abs(best - m.likelihood(u, n.astype(float))) < 1e-6 * abs(best)
    for step in (-0.02, 0.02):
        assert direct(m.good + step, m.votes) < best + 1
        for c in (0, 1):
            for j in range(5):
                other = m.votes.copy()
                other[c, j, 0] = np.clip(other[c, j, 0] + step, 1e-6, 1 - 1e-6)
                other[c, j, 2] = 1 - other[c, j, 0]
                assert direct(m.good, other) < best + 1


def test_quality_on_documents_that_it_has_not_seen(spark):
    docs, labels = labelled(spark)
    half = docs.where("pmod(xxhash64(doc_id), 2) = 0")
    model = quality.train(half)
    rest = quality.scored(docs.where("pmod(xxhash64(doc_id), 2) = 1"), model).select("c0", "score").toPandas()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    keep = [(truth[i], s >= quality.THRESHOLD) for i, s in zip(rest.c0, rest.score) if i in truth]
    assert np.mean([k for q, k in keep if q]) > 0.95 and np.mean([k for q, k in keep if not q]) < 0.25


def test_quality_of_odd_rows(spark):
    out = quality.quality(odd(spark)).collect()
    assert len(out) == len(ODD)
    assert [(r.score, r.keep) for r in out if r.doc_id == 2] == [(None, False)]
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert quality.quality(odd(spark).limit(0)).count() == 0
    clash = odd(spark).selectExpr("doc_id", "text", "score AS keep", "score", "score AS c0")
    assert quality.of_quality(clash).columns == clash.columns
    assert {tuple(r) for r in quality.of_quality(clash).collect()} <= {tuple(r) for r in clash.collect()}
    assert quality.of_quality(clash.limit(0)).count() == 0
