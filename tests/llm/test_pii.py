import random

import pyarrow as pa
import pytest

from lectern.llm import pii

PLAIN = [
    ("EMAIL", "ann.smith+x@mail7.example.com", None),
    ("EMAIL", "ann.smith (at) mail.example (dot) com", "ann.smith@mail.example.com"),
    ("EMAIL", "ann [dot] smith [at] example [dot] com", "ann.smith@example.com"),
    ("EMAIL", "ann at example dot org", "ann@example.org"),
    ("EMAIL", "аnn@exаmple.com", "ann@example.com"),
    ("EMAIL", "ａｎｎ＠example．com", "ann@example.com"),
    ("EMAIL", "a​nn@exam​ple.com", "ann@example.com"),
    ("PHONE", "+1 (017) 555-7713", None),
    ("PHONE", "(212) 555-0199", None),
    ("PHONE", "212-555-0199", None),
    ("PHONE", "five five five one two three four", "5551234"),
    ("PHONE", "zéro six un deux trois quatre cinq six sept huit", "0612345678"),
    ("CARD", "4785380592391139", None),
    ("CARD", "4785 3805 9239 1139", None),
    ("CARD", "４７８５３８０５９２３９１１３９", "4785380592391139"),
    ("IP", "233.233.171.252", None),
    ("SSN", "123-45-6789", None),
    ("IBAN", "DE89 3704 0044 0532 0130 00", None),
]
CLEAN = [
    "", " ", "look at example.com for one two things", "he was at home. Dot and Ann were there", "version 1.2.3 of 2024-05-06",
    "4785380592391138", "300.1.2.3", "1111111111111111", "a @ b", "he paid 1,234,567.89 in 12 parts", "un deux", "one. Two. Three.", "meet at noon dot",
]


@pytest.mark.parametrize("kind,text,value", PLAIN)
def test_found_where_it_stands(kind, text, value):
    for before, after in (("", ""), ("Écrire: ", " ok"), ("x\ny ", "\nz"), ("日本 ", ", then")):
        full = before + text + after
        [(k, a, b, v)] = pii.find(full)
        assert (k, full[a:b], v) == (kind, text, value or text)
        assert pii.masked(full) == f"{before}[{kind}]{after}"


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert pii.find(text) == [] and pii.masked(text) == text


def test_many_in_one_text_against_where_they_were_put():
    r = random.Random(3)
    for _ in range(100):
        full, want = "", []
        for _ in range(r.randint(0, 8)):
            full += " ".join(r.choice(["lorem", "ipsum", "déjà", "wörd", "der", "of"]) for _ in range(r.randint(1, 30))) + " "
            kind, text, _ = r.choice([p for p in PLAIN if " at " not in p[1] and "[dot]" not in p[1]])
            want.append((kind, len(full), len(full) + len(text)))
            full += text + r.choice([" lorem. ", "; ipsum ", "\n"])
        assert [f[:3] for f in pii.find(full)] == want
        assert pii.suspects(pa.array([full]))[0] or not want


def test_the_screen_passes_whatever_can_be_found():
    assert pii.suspects(pa.array([p[1] for p in PLAIN])).all()
    assert not pii.suspects(pa.array(["", None, "one two, then. Five six at home", "déjà vu"])).any()


def test_no_limit_on_how_far_an_address_reaches_back():
    local = " dot ".join(["part"] * 80)
    text = f"write to {local} at example dot org today"
    assert pii.masked(text) == "write to [EMAIL] today"
    assert pii.masked("x (dot) y.z (at) a (dot) b.com!") == "[EMAIL]!"


def test_spelled_numbers_go_by_rule():
    digits = "one two three four five six seven eight nine zero".split()
    run = lambda n: " ".join(digits[k % 10] for k in range(n))
    for n in range(1, 40):
        want = "" if n < 7 else "PHONE" if n < 16 else "NUMBER"
        assert {k for k, *_ in pii.find(f"there are {run(n)} of them")} - {"CARD"} <= {want}
        assert bool(pii.find(f"there are {run(n)} of them")) == (n >= 7)
        assert bool(pii.find(f"the code is now {run(n)} of them")) == (n >= 3), n
    assert pii.masked("my pin: four two four two ok") == "my pin: [NUMBER] ok"


@pytest.mark.parametrize("run", [" ", "\n", "( ", "@ ", "[", "a.", "at ", " dot ", "one ", "1", "1 ", "a@b ", "a at b.c ", "+1", "-", "é ", "\u00a0"])
def test_time_is_linear(run):
    import time

    text = "x@y" + run * (1_000_000 // len(run)) + "@"
    began = time.perf_counter()
    pii.find(text)
    pii.suspects(pa.array([text]))
    assert time.perf_counter() - began < 30  # on a busy machine; a square would take hours


def naive(text):
    """(kind, begin, end) by another way: every substring between two word bounds is undisguised by itself and tried."""
    import re
    import unicodedata

    plain = "".join(unicodedata.normalize("NFKC", c) if len(unicodedata.normalize("NFKC", c)) == 1 else c for c in text)
    found = []
    for m in re.finditer(r"\S+(?: (?:at|\(at\)|\[at\]|dot|\(dot\)|\[dot\]) \S+)+|\S+@\S+", plain):
        value = re.sub(r" (?:\(|\[)?dot(?:\)|\])? ", ".", re.sub(r" (?:\(|\[)?at(?:\)|\])? ", "@", m[0]))
        if re.fullmatch(r"[\w.+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}", value, re.I) and ("dot" in m[0] or "@" in m[0] or "(" in m[0]):
            found.append(("EMAIL", *m.span()))
    for m in re.finditer(r"\d{3}-\d{3}-\d{4}", plain):
        found.append(("PHONE", *m.span()))
    return sorted(found, key=lambda f: f[1])


def test_the_table_against_another_finder(spark):
    r = random.Random(12)
    words = ["plain", "words", "stand", "here", "été", "grün", "3.5", "dots."]
    rows = []
    for i in range(200):
        parts = [r.choice(words) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            name, host = f"n{r.randint(1, 99)}", f"h{r.randint(1, 99)}"
            parts.insert(r.randint(0, len(parts)), r.choice([
                f"{name}@{host}.com", f"{name} at {host} dot org", f"{name} (at) {host} (dot) net", f"{name} [dot] x at {host} dot com", f"ｎ{name}@{host}.de", "212-555-0199",
            ]))
            parts.insert(r.randint(0, len(parts)), ";")
        rows.append((i, " ; ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.begin, x.kind, x.end) for x in pii.private_spans(docs).collect())
    want = sorted((i, a, k, b) for i, t in rows for k, a, b in naive(t))
    assert got == want and len(want) > 150


def test_character_counts_under_any_case(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", 15)], "doc_id long, Text string, N_CHARS int")
    assert [tuple(x) for x in pii.without_private(docs).collect()] == [(1, "mail [EMAIL] now", 16)]


def test_offsets_compose():
    x = pii.Rewritten("abcdef")
    x.rewrite([(1, 3, "X"), (4, 5, "")])
    assert (x.text, x.source(1, 2), x.source(2, 3)) == ("aXdf", (1, 3), (3, 4))
    x.rewrite([(1, 3, "yyy")])
    assert (x.text, x.source(1, 2), x.source(3, 5)) == ("ayyyf", (1, 4), (1, 6))


def test_tables(spark):
    rows = [(1, "mail a@b.co now", "k", 15), (1, "mail a@b.co now", "k", 15), (2, None, None, None), (3, "", "x", 0), (4, "clean " * 30_000, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string, n_chars long")
    found = sorted(map(tuple, pii.private_spans(docs).collect()))
    assert found == [(1, "EMAIL", 5, 11, "a@b.co")] * 2
    out = pii.without_private(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted([(1, "mail [EMAIL] now", "k", 16)] * 2 + rows[2:])
    assert pii.private_spans(docs.limit(0)).count() == 0 and pii.without_private(docs.limit(0)).count() == 0


@pytest.mark.parametrize("space", [c for c in map(chr, range(128, 0x3001)) if c.isspace()])
def test_the_screen_passes_spaces_beyond_ascii(space):
    for _, text, _ in PLAIN:
        text = f"mot {text} mot".replace(" ", space)
        assert pii.suspects(pa.array([text]))[0] or not pii.find(text)
    assert pii.find("ann at example dot org".replace(" ", space)) and pii.suspects(pa.array(["ann at example dot org".replace(" ", space)]))[0]
