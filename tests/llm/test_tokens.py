from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import bpe, tokens
from lectern.llm.tokens import TokenFiles, token_offsets


def rows():
    return [(i, f"text number {i} " * (i % 7), "s") for i in range(60)] + [(3, "text", None), (None, None, "x"), (61, "", "x"), (62, "word " * 20_000, "x")]


def test_round_trip_by_memory_map(spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    docs = spark.createDataFrame(rows(), "doc_id long, text string, tokens string").repartition(5)
    out = token_offsets(docs, folder).collect()
    files = TokenFiles(folder)
    assert len(files) == len(out) == len(rows())
    v = bpe.vocabulary()
    texts = sorted((t or "") for _, t, _ in rows())
    assert sorted(v.decode(files.document(i).astype(np.int64)).tobytes().decode() for i in range(len(files))) == texts
    by_id = {}
    for i, t, _ in rows():
        by_id.setdefault(i, []).append(t or "")
    for r in out:
        ids = files.window(r.begin, r.tokens)
        assert ids[-1] == v.size and v.decode(ids[:-1].astype(np.int64)).tobytes().decode() in by_id[r.doc_id]
    spans = sorted((r.begin, r.begin + r.tokens) for r in out)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert files.window(0, 10**9).size == spans[-1][1]


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_offsets(spark.createDataFrame([], "doc_id long, text string"), folder).count() == 0
    assert len(TokenFiles(folder)) == 0 and not len(TokenFiles(folder).window(0, 5))


def test_only_files_of_lost_attempts_go(spark, tmp_path, monkeypatch):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "0000000-other.bin").write_bytes(b"xx")
    monkeypatch.setattr(tokens.uuid, "uuid4", lambda: SimpleNamespace(hex="abcdefabcdefabcdef"))
    (tmp_path / "t" / "abcdefabcdef-0000000-lost.bin").write_bytes(b"xx")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    token_offsets(docs, f"file://{tmp_path}/t")
    names = {p.name for p in (tmp_path / "t").iterdir()}
    assert "0000000-other.bin" in names and "abcdefabcdef-0000000-lost.bin" not in names
    with pytest.raises(FileExistsError):
        token_offsets(docs, f"file://{tmp_path}/t")
    assert {p.name for p in (tmp_path / "t").iterdir()} == names


def test_bases_are_the_prefix_sums_of_the_files(spark, tmp_path):
    """Against the files themselves and SQL over the manifest."""
    folder = f"file://{tmp_path}/tokens"
    out = token_offsets(spark.createDataFrame(rows(), "doc_id long, text string, tokens string").repartition(5), folder).toPandas()
    manifest = duckdb.sql(f"SELECT *, coalesce(sum(tokens) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM '{tmp_path}/tokens/manifest/*.parquet'").df()
    kind, total = tokens.id_type(), 0
    for r in manifest.sort_values("shard").itertuples():
        ids, index = np.fromfile(f"{tmp_path}/tokens/{r.name}.bin", kind), np.fromfile(f"{tmp_path}/tokens/{r.name}.idx", "<u8")
        assert (len(index) - 1, index[0], index[-1], len(ids)) == (r.documents, 0, r.tokens, r.tokens) and r.base == r.first_token == total
        mine = out[out.file.str.contains(r.name)].sort_values("begin")
        assert (mine.begin.to_numpy() == index[:-1] + total).all() and (mine.tokens.to_numpy() == np.diff(index)).all()
        assert (ids[index[1:].astype(int) - 1] == bpe.vocabulary().size).all()
        total += r.tokens


def test_encoded_matches_files():
    [(a, b, ids, bounds)] = list(bpe.encoded(pa.array(["a b", None, "c"])))
    assert (a, b) == (0, 3) and bounds[1] == bounds[2]
