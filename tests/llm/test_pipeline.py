import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import bpe, packing

DATA = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def corpus():
    """Documents whose fate is known: toxic ones by their words, copies, near copies, addresses, and odd rows."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 8 == 0
        words = [word() for _ in range(r.randint(30, 60))]
        if toxic:
            for k in range(6):
                words[k * 4 + 1 : k * 4 + 1] = ["you", r.choice(["idiot", "moron", "stupid", "loser"])]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    for i in range(0, 40, 3):
        text = rows[i][1]
        rows.append((300 + i, text, "en", "s0", 0))
        words = text.split()
        words[5] = "changed"
        rows.append((400 + i, " ".join(words), "en", "s1", 0))
    rows += [(600, "mail ann.smith@example.com or call 212-555-0199 about " + " ".join(word() for _ in range(20)), "en", "s2", 0)]
    rows += [(700, None, None, None, None), (701, "", "en", "s0", 0), (702, "", "en", "s0", 0), (None, "alone " + " ".join(word() for _ in range(25)), "en", None, 9)]
    return rows, labels


def test_run_against_naive_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # toxic ones go, by the words that make them so
    step = [r for r in rows if r[1] is None or not {"idiot", "moron", "stupid", "loser"} & {*r[1].split()}]
    # of equal texts a labelled document stays, else the least id
    known, first = {i for i, *_ in labels}, {}
    for r in sorted(step, key=lambda r: (r[0] not in known, r[0] is None, r[0] or 0)):
        first.setdefault(r[1] if r[1] is not None else ("null", r[0]), r)
    step = [*first.values()]
    # of near copies, all pairs compared, the least id stays
    kept = []
    for r in sorted(step, key=lambda r: (r[0] is None, r[0] or 0)):
        a = (r[1] or "").split()
        if a and any((b := (k[1] or "").split()) and abs(len(a) - len(b)) < 15 and distance(a, b) <= int(0.25 * max(len(a), len(b)) + 1e-9) for k in kept):
            continue
        kept.append(r)
    assert {r.doc_id for r in out} == {r[0] for r in kept}
    texts = {r[0]: (r[1] or "").replace("ann.smith@example.com", "[EMAIL]").replace("212-555-0199", "[PHONE]") for r in kept}
    v, parts, fill = bpe.vocabulary(), {}, Counter()
    for r in out:
        parts.setdefault(r.doc_id, []).append((r.begin, r.ids))
        fill[r.window] += r.tokens
    for i, pieces in parts.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces)), "<u2").astype(np.int64)
        assert ids[-1] == v.size and v.decode(ids[:-1]).tobytes().decode() == texts[i]
    last = max(fill)
    assert sorted(fill) == list(range(last + 1)) and all(fill[w] == packing.WINDOW for w in range(last))


def test_run_without_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_and_odd_rows(spark):
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    rows = [(1, "a b", "en", "s", 3, "k"), (2, None, None, None, None, None), (None, "", "x", "y", 0, "z"), (3, "w " * 50_000, "en", "s", 1, "k"), (1, "a b", "en", "s", 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert {(2, None), (None, ""), (3, rows[3][1])} <= {(r.doc_id, r.text) for r in out.collect()}, name
