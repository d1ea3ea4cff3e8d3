import itertools
import random

import numpy as np
import pytest

from lectern.llm import exact, near, spots


def grouped(pairs, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in items}


def corpus(seed=4):
    r = random.Random(seed)
    words = [a + b for a in ("the", "re", "sto", "un", "li", "is", "ma") for b in ("", "na", "dor", "ke", "tion", "ble", "s", "ru")]
    text = lambda n: [r.choice(words + ["the", "is", "was"] * 4) for _ in range(n)]
    passage = text(60)
    docs = []
    for _ in range(60):
        docs.append(text(r.randint(30, 120)) + (passage if r.random() < 0.5 else []))
        if r.random() < 0.5:
            for _ in range(r.randint(1, 3)):
                copy = list(docs[-1])
                for _ in range(int(len(copy) * r.choice([0, 0.03, 0.08]))):
                    i = r.randrange(len(copy))
                    copy[i : i + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
                docs.append(copy)
    return [(i * 3, " ".join(d)) for i, d in enumerate(docs)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_and_bag_bound_against_the_full_matrix():
    r = random.Random(2)
    for _ in range(400):
        a = [r.randint(0, 5) for _ in range(r.randint(0, 40))]
        b = list(a) if r.random() < 0.7 else [r.randint(0, 5) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 6)):
            b.insert(r.randint(0, len(b)), r.randint(0, 5))
            del b[r.randrange(len(b))]
        d, most = distance(a, b), r.randint(0, 12)
        assert near.banded_distance(a, b, most) == min(d, most + 1)
        assert near.bag_distance(np.array(a, np.uint32), np.array(b, np.uint32)) <= d


def test_sketches_are_the_least_labelled_runs_in_text_order():
    h = np.array([1, 2, 1, 2, 1, 9, 8, 7, 1, 2] * 5 + [4], np.uint64)
    first = np.array([0, 50, 50, 51])
    got = near.order_sketches(h, first, 2, 3, 6)
    assert got[1].tolist() == [0] * 6 and len({*got[0].tolist()}) == 6
    wide = near._LIKELY
    near._LIKELY = 1  # the first look finds too few
    try:
        assert (near.order_sketches(h, first, 2, 3, 6) == got).all()
    finally:
        near._LIKELY = wide


@pytest.mark.parametrize("block", [near.BLOCK, 2])
def test_near_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept_doc_id for r in near.near_duplicates(docs).collect()}
    seqs = {i: t.split() for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(seqs, 2) if distance(seqs[a], seqs[b]) <= near._allowed(max(len(seqs[a]), len(seqs[b])), near.THRESHOLD)]
    want = {i: g for i, g in grouped(pairs, seqs).items() if g != i}
    assert all(want.get(i) == g for i, g in got.items())
    assert len(got) >= 0.9 * len(want) and want


@pytest.mark.parametrize("block", [spots.BLOCK, 2])
def test_spot_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spots, "BLOCK", block)
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept_doc_id for r in spots.spot_duplicates(docs).collect()}
    sets = {}
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        sets[i] = {*spots.spots(data, np.array([0, len(data)]), spots.CHAIN)[0].tolist()}
    alike = lambda a, b: len(a & b) >= spots.THRESHOLD * len(a | b) - 1e-9 and min(len(a), len(b)) >= spots.LEAST
    text = dict(rows)
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b]) or text[a] == text[b]]
    want = {i: g for i, g in grouped(pairs, sets).items() if g != i}
    assert got == want and want


ODD = [(5, "a b c d e", 1), (5, "a b c d e", 2), (5, "other words here", 3), (2, None, 4), (2, None, 4), (None, "a b c d e", 5), (7, "", 6), (8, "", 7), (9, "...", 8), (1, "long " * 20_000, 9)]


@pytest.mark.parametrize("found,kept", [(exact.exact_duplicates, exact.exact_dedup), (near.near_duplicates, near.near_dedup)])
def test_odd_rows(spark, found, kept):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, digest int")
    assert sorted(map(tuple, found(docs).collect()), key=str) == [(5, 5), (8, 7), (None, 5)]
    out = kept(docs)
    assert out.columns == docs.columns
    ids = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert ids == sorted([(5, "a b c d e"), (5, "other words here"), (2, None), (2, None), (7, ""), (9, "..."), (1, "long " * 20_000)], key=str)
    assert found(docs.limit(0)).count() == 0 and kept(docs.limit(0)).count() == 0


def test_spots_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, digest int")
    assert sorted(map(tuple, spots.spot_duplicates(docs).collect()), key=str) == [(5, 5), (8, 7), (None, 5)]
    assert spots.spot_duplicates(docs.limit(0)).count() == 0


def test_history_wins_and_the_perfect_hash_is_minimal(spark):
    docs = spark.createDataFrame([(1, "same"), (4, "same"), (3, "same"), (6, "new"), (9, "new")], "doc_id long, text string")
    history = spark.createDataFrame([(4,), (4,), (77,), (None,)], "doc_id long")
    assert sorted(map(tuple, exact.exact_duplicates(docs, history).collect())) == [(1, 4), (3, 4), (9, 6)]
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    h = exact.PerfectHash(keys, np.arange(5000))
    member, slot = h.lookup(keys)
    assert member.all() and sorted(slot.tolist()) == list(range(5000)) and (h.locators[slot] == np.arange(5000)).all()
    assert not h.lookup(keys ^ np.uint64(1))[0].any()


def test_history_of_an_earlier_run(spark, tmp_path):
    first = spark.createDataFrame([(5, "old"), (2, "old"), (3, None), (4, "")], "doc_id long, text string")
    exact.digests(first).write.parquet(f"{tmp_path}/digests")
    seen = spark.read.parquet(f"{tmp_path}/digests")
    docs = spark.createDataFrame([(11, "old"), (1, "old"), (12, "new"), (13, "new"), (14, ""), (15, None)], "doc_id long, text string")
    assert sorted(map(tuple, exact.exact_duplicates(docs, seen=seen).collect())) == [(1, 2), (11, 2), (13, 12), (14, 4)]
    assert sorted(r.doc_id for r in exact.exact_dedup(docs, seen=seen).collect()) == [12, 15]
    history = spark.createDataFrame([(13,)], "doc_id long")
    assert sorted(map(tuple, exact.exact_duplicates(docs, history, seen=seen).collect())) == [(1, 2), (11, 2), (12, 13), (14, 4)]


def test_documents_of_few_spots_are_compared(spark):
    rows = [
        (1, "Rain was falling on quiet old hills"), (2, "rain WAS falling, on quiet old hills; far away"),  # equal sets of one spot
        (3, "the red fox jumped. the blue whale sang"), (4, "the red fox jumped. the green bird slept"),  # 1 of 3 spots
        (5, "the red fox jumped. the blue whale sang quite loudly"),
        (6, "No anchor here"), (7, "no anchor: here!"), (8, "no anchor there"), (9, "..."), (10, "!"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, spots.spot_duplicates(docs).collect())) == [(2, 1), (5, 3), (7, 6)]


def heavily_edited(r, n, edits):
    a = [f"w{r.randrange(10**9)}" for _ in range(n)]
    b = list(a)
    for i in r.sample(range(n), edits):
        b[i] = f"w{r.randrange(10**9)}"
    return " ".join(a), " ".join(b)


def test_near_copies_of_a_quarter_edited_are_caught(spark):
    r = random.Random(11)
    for sizes, least in ((range(4, 13), 1.0), ((20, 32), 1.0), ((60, 200), 0.9)):
        rows = [t for n in sizes for _ in range(30) for t in heavily_edited(r, n, n // 4)]
        docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
        got = {tuple(x) for x in near.near_duplicates(docs).collect()}
        want = {(i + 1, i) for i in range(0, len(rows), 2)}
        assert got <= want and len(got) >= least * len(want)


def test_cells_hold_every_pair_once(spark):
    members = spark.range(50).selectExpr("1L AS key", "id AS node", "50L AS n").union(spark.range(3).selectExpr("2L", "id + 100", "3L"))
    cells = {}
    for r in near.cells(members, 8).collect():
        cells.setdefault((r.key, r.i, r.j), []).append((r.node, r.side))
    pairs = [(k[0], *sorted((x, y))) for k, c in cells.items() for (x, p), (y, q) in itertools.combinations(c, 2) if k[1] == k[2] or p != q]
    assert len(pairs) == len({*pairs}) == 50 * 49 // 2 + 3 and max(map(len, cells.values())) < 40


def test_a_hot_key_of_unlike_texts(spark):
    """Texts that share their rarest words and little else: one key holds them all, and only true copies are found."""
    r = random.Random(6)
    rows = [(i, "zeta eta theta " + " ".join(f"w{r.randrange(40)}" for _ in range(9))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.kept_doc_id for x in near.near_duplicates(docs).collect()}
    seqs = {i: t.split() for i, t in rows}
    alike = [(a, b) for a, b in itertools.combinations(seqs, 2) if len({*seqs[a]} & {*seqs[b]}) >= 7 and distance(seqs[a], seqs[b]) <= 3]
    assert got == {i: g for i, g in grouped(alike, seqs).items() if g != i} and len(got) >= 20
