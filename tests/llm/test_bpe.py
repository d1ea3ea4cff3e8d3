import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

from lectern.llm import bpe

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    made = ["", " ", "  ", "a", "'s", "don't we'll  they've 'tis ''s !'s 'S", "x  y\n\n z \t", "naïve   ÜBER ½²٣ 日本語 　x", "\n", "a" * 3000, "ab" * 700 + "!" * 900]
    for _ in range(300):
        made.append("".join(r.choice(["a", "the", " ", "  ", "\n", "'", "s", "ll", "re", "é", "1", "22", "!", "?.", " ", "𝒳", "日"]) for _ in range(r.randint(0, 40))))
    return made


def encode_all(given):
    out = []
    for a, b, ids, bounds in bpe.encoded(pa.array(given)):
        out += [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])]
    return out


def test_pieces_are_those_of_the_pattern():
    for t in texts():
        data = np.frombuffer(t.encode(), np.uint8)
        got = bpe.pieces(data, np.array([0, len(data)]))
        want = [len(t[: m.start()].encode()) for m in regex.finditer(PATTERN, t)]
        assert got.tolist() == want, t


def test_ids_equal_those_of_another_library(reference):
    given = texts()
    assert encode_all(given) == [reference.encode_ordinary(t) for t in given]


def test_memory_has_no_effect(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr("lectern.llm.kernel.SLICE", 50)
    given = texts()
    assert encode_all(given) == [reference.encode_ordinary(t) for t in given]


def test_shared_hashes_have_no_effect(reference, monkeypatch):
    monkeypatch.setattr(bpe, "range_hashes", lambda data: lambda start, end: np.zeros(len(start), np.uint64))
    e = bpe.Encoder()
    data = np.frombuffer("one two three".encode(), np.uint8)
    assert e.encode(data, np.array([0, len(data)]))[0].tolist() == reference.encode_ordinary("one two three")


def test_long_piece_equals_side_by_side():
    v, r = bpe.vocabulary(), random.Random(1)
    for _ in range(50):
        piece = bytes(r.choice(b"abcdeth ing") for _ in range(r.randint(1, 60)))
        data = np.frombuffer(piece, np.uint8)
        ids, n = bpe.merge_many(data, np.array([0]), 64, np.array([len(piece)]), v)
        assert ids.tolist() == bpe.merge_long(piece, v) and n.tolist() == [len(ids)]


def test_round_trip_and_odd_rows(spark):
    rows = [(1, "plain text", "x"), (1, "plain text", "y"), (2, None, "z"), (None, "", "z"), (3, "é" * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = bpe.encode(docs)
    got = sorted(map(tuple, bpe.decode(coded).collect()), key=str)
    assert got == sorted([(a, b) for a, b, _ in rows], key=str)
    assert {r.doc_id: r.ids for r in coded.collect()}[2] is None
    assert bpe.encode(docs.limit(0)).count() == 0
