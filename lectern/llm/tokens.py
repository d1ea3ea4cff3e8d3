"""Token ids as flat binary files with 64-bit document offsets, to be memory-mapped.

Each partition writes one file of unsigned little-endian integers (16 bits if all ids fit, else
32), every document ended by the vocabulary's first free id, and beside it one file of 64-bit
offsets, n + 1 for n documents, counted in tokens within the file.  The files' bases, in
documents and in tokens, are prefix sums over what the partitions hold; so nothing is shuffled
but a row for each file, and files are written once, side by side.

A task that runs twice writes two files under different names; only the one that its committed
rows name counts, and the run's others are deleted.  A folder holds one corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoded, vocabulary
from .common import fresh_path, picked, written


def id_type(path: str = VOCABULARY) -> np.dtype:
    """The type of ids in files; it has room for the end-of-document id."""
    return np.dtype("<u2" if vocabulary(path).size < 1 << 16 else "<u4")


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def with_ends(ids: np.ndarray, bounds: np.ndarray, end: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each document, and where each document then begins."""
    return np.insert(ids, bounds[1:], end).astype(kind), bounds + np.arange(len(bounds))


def _written(batches: Iterator[pa.RecordBatch], folder: str, path: str, run: str) -> Iterator[pa.RecordBatch]:
    shard, end, kind = TaskContext.get().partitionId(), vocabulary(path).size, id_type(path)
    fs, root = place(folder)
    name, total, offsets = f"{run}-{shard:07d}-{uuid.uuid4().hex[:12]}", 0, [np.zeros(1, np.uint64)]
    seen: dict[str | None, int] = {}  # tokens so far of each source
    out = None
    for batch in batches:
        if not len(batch):
            continue
        out = out or fs.open_output_stream(f"{root}/{name}.bin")
        texts, sources = batch.column("text"), batch.column("source").to_pylist()
        for a, b, ids, bounds in encoded(texts, path):
            flat, bounds = with_ends(ids, bounds, end, kind)
            out.write(flat.tobytes())
            n = np.diff(bounds)
            offsets.append((total + bounds[1:]).astype(np.uint64))
            of_source = []
            for s, k in zip(sources[a:b], n.tolist()):
                of_source.append(seen.get(s, 0))
                seen[s] = of_source[-1] + k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(b - a, shard, np.int32)), pa.array([name] * (b - a)), batch.column("doc_id")[a:b], batch.column("source")[a:b],
                    pa.array(total + bounds[:-1]), pa.array(n.astype(np.int64)), pa.array(of_source, pa.int64()),
                ],
                ["shard", "name", "doc_id", "source", "at", "tokens", "of_source"],
            )
            total += len(flat)
    if out:
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(np.concatenate(offsets).astype("<u8").tobytes())


_WRITTEN = "shard int, name string, doc_id long, source string, at long, tokens long, of_source long"


def token_files(docs: DataFrame, folder: str, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Writes the files of ``docs`` to ``folder``; (rows, manifest).

    rows: shard, name, doc_id, source, at (tokens before it in its file), tokens (with the end
    id), of_source (tokens of the same source before it in its file), a row for each document.
    manifest: shard, name, documents, tokens, first_document, first_token, a row for each file,
    written to ``folder``/manifest too.  No documents, no files.  doc_id is taken as a long.  A
    folder that has a manifest already is refused; other files in it are left alone.
    """
    fs, root = place(folder)
    fs.create_dir(root, recursive=True)
    if fs.get_file_info(f"{root}/manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds a corpus already")
    run = uuid.uuid4().hex[:12]
    names = {"doc_id": "doc_id", "text": "text"} | ({"source": "source"} if "source" in map(str.lower, docs.columns) else {})
    rows = picked(docs, **names)
    source = F.col("source").cast("string") if "source" in names else F.lit(None).cast("string")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text")
    rows = written(rows.mapInArrow(lambda it: _written(it, folder, path, run), _WRITTEN), "token-rows")
    # one row for each file goes through one task: prefix sums have an order
    before = "OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    manifest = rows.groupBy("shard", "name").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    manifest = manifest.select(
        "*", F.expr(f"coalesce(sum(documents) {before}, 0)").alias("first_document"), F.expr(f"coalesce(sum(tokens) {before}, 0)").alias("first_token")
    )
    schema = manifest.schema
    manifest.write.parquet(f"{folder}/manifest")
    manifest = docs.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")
    good = {r.name for r in manifest.select("name").toLocalIterator()}
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith(f"{run}-") and f.base_name.rpartition(".")[0] not in good:
            fs.delete_file(f.path)
    return rows, manifest


def token_offsets(docs: DataFrame, folder: str | None = None, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, file, begin, tokens) for every document, with its files written to ``folder``.

    ``begin`` counts the tokens before it in the whole corpus, ``tokens`` its own with the end
    id.  Without ``folder`` a new one in the shared folder is taken.  Null and empty texts are
    documents of the end id alone; rows that repeat a doc_id or a text are documents of their own.
    """
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    rows, manifest = token_files(docs, folder, path)
    bases = manifest.select(F.col("shard").alias("of"), "first_token")
    rows = rows.join(bases, F.col("shard") == F.col("of"))
    return rows.select("doc_id", F.concat(F.lit(f"{folder}/"), "name", F.lit(".bin")).alias("file"), (F.col("first_token") + F.col("at")).alias("begin"), "tokens")


class TokenFiles:
    """Reads files on a local or mounted folder by memory-mapping them."""

    def __init__(self, folder: str, path: str = VOCABULARY):
        import pyarrow.dataset as ds

        _, self.root = place(folder)
        table = ds.dataset(f"{self.root}/manifest", format="parquet").to_table().sort_by("shard").to_pydict()
        self.names, self.documents = table["name"], np.append(table["first_document"], 0)
        self.tokens = np.append(table["first_token"], 0)
        if self.names:
            self.documents[-1] = self.documents[-2] + table["documents"][-1]
            self.tokens[-1] = self.tokens[-2] + table["tokens"][-1]
        self.kind = id_type(path)

    def __len__(self) -> int:
        return int(self.documents[-1])

    def _map(self, k: int, extension: str, kind: str | np.dtype) -> np.memmap:
        return np.memmap(f"{self.root}/{self.names[k]}.{extension}", kind, "r")

    def document(self, i: int) -> np.ndarray:
        """Ids of document ``i``, counted over all files, without the end id."""
        k = int(np.searchsorted(self.documents, i, "right")) - 1
        index = self._map(k, "idx", "<u8")
        a, b = (int(x) for x in index[i - int(self.documents[k]) :][:2])
        return self._map(k, "bin", self.kind)[a : b - 1]

    def window(self, begin: int, n: int) -> np.ndarray:
        """``n`` ids from position ``begin`` of the corpus, fewer at its end."""
        out, end = [], min(begin + n, int(self.tokens[-1]))
        while begin < end:
            k = int(np.searchsorted(self.tokens, begin, "right")) - 1
            base, to = int(self.tokens[k]), min(end, int(self.tokens[k + 1]))
            out.append(self._map(k, "bin", self.kind)[begin - base : to - base])
            begin = to
        return np.concatenate(out) if out else np.zeros(0, self.kind)
