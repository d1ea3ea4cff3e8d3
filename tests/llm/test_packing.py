from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from lectern.llm.packing import QUEUES, pack, schedule, segments, turns, whole_shares


def round_robin(totals, shares, window, windows):
    """Credits and deficits kept one window after the other, while all queues last."""
    due, sent, total = [Fraction(0)] * len(totals), [0] * len(totals), sum(shares)
    for _ in range(windows):
        ahead, given_ = Fraction(0), 0
        row = []
        for s, share in enumerate(shares):
            due[s] += Fraction(window * share, total)
            ahead += due[s]
            upto = int(ahead)  # what the sources so far are due in whole tokens
            row.append(upto - given_ - sent[s])
            given_ = upto
        for s, n in enumerate(row):
            sent[s] += n
        yield row


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.floats(0.01, 1)), max_size=5), st.integers(5, 40))
def test_every_token_once_in_order_and_to_proportion(queues, window):
    totals, targets = [q[0] for q in queues], [q[1] for q in queues]
    stretches = schedule(totals, targets, window)
    fill, per = Counter(), defaultdict(Counter)
    for s, n in enumerate(totals):
        own, last = turns(stretches, s), (-1, -1)
        for begin in range(0, n, 7):  # documents of seven tokens
            at = begin
            for w, _slot, first, many in segments(own, begin, min(7, n - begin)):
                assert first == at and many > 0 and (w, first) > last
                at, last = first + many, (w, first)
                fill[w] += many
                per[w][s] += many
            assert at == begin + min(7, n - begin)
    windows = -(-sum(totals) // window)
    assert len(fill) == windows and all(fill[w] == window for w in range(windows - 1))
    if stretches and stretches[0].many > 1:
        shares = whole_shares(targets, window)
        live = [s for s in range(len(totals)) if totals[s]]
        for w, row in enumerate(round_robin([totals[s] for s in live], [shares[s] for s in live], window, stretches[0].many)):
            assert [per[w][s] for s in live] == row


def test_windows_hold_the_documents(spark):
    rows = [(i, f"document {i} says " + "word " * (i * 13 % 90), ["a", "b", None][i % 3], "x") for i in range(90)] + [(7, None, "a", "y"), (8, "", "b", "z"), (8, "", "b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, window string").repartition(6)
    out = pack(docs, 64, {"a": 0.5, "b": 0.25, None: 0.25}).collect()
    fill = Counter()
    for r in out:
        assert len(r.ids) == 2 * r.tokens
        fill[r.window] += r.tokens
    last = max(fill)
    assert sorted(fill) == list(range(last + 1)) and all(fill[w] == 64 for w in range(last))
    early = Counter()
    for r in out:
        early[r.source] += r.tokens * (r.window < 5)
    assert abs(early["a"] - 160) <= 1 and abs(early["b"] - 80) <= 1
    v = bpe.vocabulary()
    single = {i for i, n in Counter(r[0] for r in rows).items() if n == 1}
    texts = {i: t for i, t, *_ in rows}
    parts = defaultdict(list)
    for r in out:
        parts[r.doc_id].append((r.begin, r.ids))
    for i in single:
        ids = np.frombuffer(b"".join(x for _, x in sorted(parts[i])), "<u2").astype(np.int64)
        assert ids[-1] == v.size and v.decode(ids[:-1]).tobytes().decode() == (texts[i] or "")


def test_default_proportions_and_no_documents(spark):
    docs = spark.createDataFrame([(i, "one two three four", "ab"[i % 3 > 0]) for i in range(300)], "doc_id long, text string, source string")
    out = pack(docs, 50, temper=1).collect()
    per = defaultdict(Counter)
    for r in out:
        per[r.window][r.source] += r.tokens
    assert all(abs(per[w]["a"] - 50 / 3) <= 2 for w in range(max(per) - 1))
    assert pack(docs.limit(0)).count() == 0


def test_more_sources_than_tokens_in_a_window(spark):
    rows = [(i, "one two three", f"s{i % 70:02}") for i in range(350)] + [(1000 + i, "word " * 40, "big") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for targets in (None, {"big": 1.0} | {f"s{i:02}": 0.01 for i in range(60)}):
        out = pack(docs, 16, targets, temper=1).collect()
        fill, tokens, per = Counter(), defaultdict(list), Counter()
        for r in out:
            fill[r.window] += r.tokens
            tokens[r.doc_id].append((r.begin, r.tokens))
            per[r.window, r.source == "big"] += r.tokens
        last = max(fill)
        assert sorted(fill) == list(range(last + 1)) and all(fill[w] == 16 for w in range(last))
        assert {*tokens} == {r[0] for r in rows}
        for parts in tokens.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert len({(r.window, r.slot) for r in out}) == len({(r.window, r.slot, r.source) for r in out})
        total = sum(fill.values())
        share = sum(r.tokens for r in out if r.source == "big") / total if targets is None else 1 / 1.6
        assert all(abs(per[w, True] - 16 * share) <= 2 for w in range(last // 2))


def test_tempered_shares(spark):
    rows = [(i, "one two three four", "hot" if i % 10 else "cold") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = {s: sum(r.tokens for r in pack(docs, 64, temper=0).collect() if r.source == s) for s in ("hot", "cold")}
    for temper in (0, 0.5, 1):
        per = Counter()
        for r in pack(docs, 64, temper=temper).collect():
            per[r.source] += r.tokens * (r.window == 0)
        assert abs(per["cold"] - 64 * n["cold"] ** temper / (n["cold"] ** temper + n["hot"] ** temper)) <= 1


def test_many_queues_are_scheduled_quickly():
    import time

    r = np.random.default_rng(3)
    totals = [int(x) for x in r.integers(1, 3_000_000, QUEUES)]
    began = time.perf_counter()
    stretches = schedule(totals, [t**0.5 for t in totals], 8192)
    assert time.perf_counter() - began < 60
    last = stretches[-1]
    assert last.first + last.many == -(-sum(totals) // 8192)
    assert sum(int(x.after().sum() - x.at.sum()) for x in stretches) == sum(totals)
