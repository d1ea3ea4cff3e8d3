import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import spans


def plain_sentences(text):
    """(words, text) of each sentence, by regular expressions alone."""
    cut, out = [0], []
    for m in re.finditer(r"[.!?](?=\s|$)|[。！？]|\n", text):
        cut.append(m.end())
    cut.append(len(text))
    for a, b in zip(cut, cut[1:]):
        words = re.findall(r"[0-9a-z\x80-\uffff]+", text[a:b].lower().translate({ord(c): " " for c in "。！？"}))
        if words:
            out.append(words)
    return out


def brute_force(rows, sentences=spans.SENTENCES, words=spans.WORDS, passage=spans.PASSAGE):
    """For each row the words that stay and the number of sentences that lose any, from the definition alone."""
    texts = {}
    for i, text in rows:
        if text is not None:
            texts.setdefault((i is None, i or 0, text), plain_sentences(text))
    keys = sorted(texts, key=lambda k: (k[0], k[1], rank(k[2])))
    first, gone, size = {}, {}, {}
    for k in keys:
        s = texts[k]
        flat = [w for x in s for w in x]
        start = np.concatenate([[0], np.cumsum([len(x) for x in s])]).astype(int)
        lost = np.zeros(len(flat), bool)
        for j in range(len(s)):
            e = j + sentences
            while e < len(s) and start[min(e, len(s))] - start[j] < words:
                e += 1
            if e > len(s) or start[e] - start[j] < words:
                continue
            run = ("s", tuple(map(tuple, s[j:e])))
            if first.setdefault(run, (k, j)) != (k, j):
                lost[start[j] : start[e]] = True
        for j in range(len(flat) - passage + 1):
            run = ("w", tuple(flat[j : j + passage]))
            place = first.setdefault(run, (k, j))
            if place != (k, j):
                lost[max(j, place[1] + passage) if place[0] == k else j : j + passage] = True
        gone[k] = [w for w, x in zip(flat, lost) if not x], sum(bool(lost[a:b].any()) for a, b in zip(start, start[1:])), len(s)
    return gone


def rank(text):
    """Order of texts with one id: that of their digests, which tests with one text per id don't need."""
    return text


def words_of(text):
    return [w for s in plain_sentences(text) for w in s]


def made(seed, n=70):
    r = random.Random(seed)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    word = lambda: r.choice(vocabulary) + r.choice(["", "", str(r.randint(0, 60))])
    sentence = lambda: " ".join(word() for _ in range(r.randint(1, 14))).capitalize() + r.choice([".", "!", "?", ".\n"])
    shared = [[sentence() for _ in range(r.randint(3, 7))] for _ in range(6)]
    long = [" ".join(word() for _ in range(r.randint(48, 90))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [sentence() for _ in range(r.randint(0, 6))]
        for s in r.sample(shared, r.randint(0, 2)):
            at = r.randint(0, len(parts))
            parts[at:at] = s
        if r.random() < 0.4:
            parts.insert(r.randint(0, len(parts)), f"{word()} {r.choice(long)} {word()}" + r.choice([".", " "]))
        rows.append((i, " ".join(parts)))
    copies = [(100 + k, t) for k, (_, t) in enumerate(r.sample(rows, 12)) for _ in (0, 1)]
    return rows + copies + [(200, (rows[3][1] + " ") * 3), (None, rows[5][1])]


@pytest.mark.parametrize("seed,most_bits", [(7, None), (8, None), (9, 1)])
def test_against_brute_force(spark, monkeypatch, seed, most_bits):
    if most_bits:  # as if there were too many repeats for a filter
        monkeypatch.setattr(spans, "MOST_BITS", most_bits)
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = spans.substring_dedup(docs).collect()
    want = brute_force(rows)
    assert len(out) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for x in out:
        kept, removed, many = want[(x.doc_id is None, x.doc_id or 0, texts[x.doc_id])]
        assert (words_of(x.text), x.removed, x.sentences) == (kept, removed, many), x.doc_id
        assert removed or x.text == texts[x.doc_id]
    assert sum(x.removed for x in out) > 50


def test_sentences_are_those_of_the_expression():
    for t in ["A b. C d! E\nf", "", "...", "One.two three? ", "第一句。第二句！ third? x", " \n lead. 3.5 is. so!!", "end。"]:
        data = np.frombuffer(t.lower().encode(), np.uint8)
        s = spans.Sentences(data, np.array([0, len(data)]))
        assert len(s.word) - 1 == len(plain_sentences(t)) and np.diff(s.word).tolist() == [len(x) for x in plain_sentences(t)], t
        assert b"".join(data[a:b].tobytes() for a, b in zip(s.start, s.end)) == (data.tobytes() if len(s.start) else b"")


def test_odd_rows(spark):
    twice = "plain text of words. " * 10
    rows = [(1, twice, 1, "a"), (1, twice, 2, "b"), (2, None, 3, "c"), (None, "", 4, "d"), (3, "word " * 30_000, 5, "e"), (4, " " * 1_000_000, 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, removed string")
    out = spans.substring_dedup(docs).collect()
    assert len(out) == len(rows) and [(x.text, x.sentences, x.removed) for x in out if x.doc_id == 2] == [(None, 0, 0)]
    assert [x.text for x in out if x.doc_id == 4] == [" " * 1_000_000]
    assert len({x.text for x in out if x.doc_id == 1}) == 1
    assert spans.substring_dedup(docs.limit(0)).count() == 0
    kept = spans.without_repeats(docs)
    assert kept.columns == docs.columns and sorted((r[2], r[3]) for r in kept.collect()) == [(k[2], k[3]) for k in rows]


def test_long_passages_go_wherever_they_begin(spark):
    r = random.Random(5)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    some = lambda n: " ".join(fresh(n))
    inside, one, lines, short = some(51), some(60), fresh(150), some(50)
    rows = [
        (1, f"{some(9)} {inside} {some(5)}. {some(4)}."), (2, f"{some(3)} {inside.upper()} {some(7)}. {some(20)}."),
        (3, one + "."), (4, f"{some(8)}. {one}! {some(6)}."),
        (5, ". ".join(lines)), (6, some(4) + ".\n" + "\n".join(lines) + "\n" + some(3)),
        (7, f"{some(5)} {short} {some(5)}"), (8, f"{some(5)} {short} {some(5)}"),
        (9, "again " * 400),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spans.substring_dedup(docs).collect()
    assert {x.doc_id for x in found if x.removed} == {2, 4, 6, 9}
    out = {x.doc_id: x.text for x in found}
    words = {i: t.split() for i, t in rows}
    assert all(out[i] == dict(rows)[i] for i in (1, 3, 5, 7, 8))
    assert out[2].split() == words[2][:3] + words[2][54:]
    assert out[4].split() == words[4][:8] + words[4][68:]
    assert out[6].split() == words[6][:4] + words[6][154:]
    assert out[9].split() == ["again"] * 51


def test_a_hot_run_is_met_once_for_each_text(spark):
    line = "the same footer stands under every single page of this very large site. it says so twice over. and then it says good bye to all readers."
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('page number ', id, ' tells of ', id * 7, '. {line}') AS text")
    out = spans.substring_dedup(docs).groupBy("removed").count().collect()
    assert sorted(map(tuple, out)) == [(0, 1), (3, 2999)]


def test_filters_lose_nothing(spark):
    h = np.random.default_rng(3).integers(0, 2**63, 50_000)
    table = spark.createDataFrame(pa.table({"h": h[:20_000]}))
    f = spans.sieve(table)
    assert f(h[:20_000].view(np.uint64)).all() and f(h[20_000:].view(np.uint64)).mean() < 0.05
    assert not spans.sieve(table.limit(0))(h.view(np.uint64)).any()
