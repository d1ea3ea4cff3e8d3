"""Collections of embedded chunks: a partitioned table with append, replace, purge and search; and the embedding cache."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from lectern.functions.text import IMAGE, utc_now
from lectern.functions.tokens import by_slice
from lectern.operators import chunking, retrieval
from lectern.providers import Describer, Embedder, Hashing, Scorer, embedded_each
from lectern.storage import scratch

FILE = r"(?s)^(.+)-(\d+)$"
#: Hash buckets of file names by which a collection is laid out: a file's chunks are in one.
BUCKETS = 64
_TITLES = "struct<h1:string,h2:string,h3:string,h4:string,h5:string,h6:string>"
_STRING = StringType()
_STRUCT = StructType([StructField(f"h{k}", _STRING) for k in range(1, 7)])
SCHEMA = StructType(
    [
        StructField("chunk_id", _STRING), StructField("text", _STRING), StructField("embedding", ArrayType(FloatType())),
        StructField("model", StructType([StructField("name", _STRING), StructField("version", _STRING)])), StructField("created_at", _STRING), StructField("approx_tokens", IntegerType()),
        StructField("keywords", ArrayType(_STRING)), StructField("headings", _STRUCT), StructField("heading", _STRUCT), StructField("full_headings", _STRING),
    ]
)


def file_of(chunk_id: Column) -> Column:
    """The file in a chunk's id; empty for an id of another form."""
    return F.regexp_extract(chunk_id, FILE, 1)


def chunks_per_file(chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(file, n): files by the ids' stems; ids of another form count for no file."""
    return chunks.select(file_of(F.col(id)).alias("file")).where("file <> ''").groupBy("file").agg(F.count("*").alias("n"))


def info(chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(file, n): ``chunks_per_file``, and the total, whose file is null and which counts every id."""
    files = chunks.select(F.nullif(file_of(F.col(id)), F.lit("")).alias("file"))
    total = F.grouping("file").alias("total")
    return files.rollup("file").agg(total, F.count("*").alias("n")).where("total = 1 OR file IS NOT NULL").select("file", "n")


def doomed(name: str, exact: bool = False, id: str = "chunk_id") -> Column:
    """Whether purging the file ``name`` deletes a chunk; '*' and '?' are wild unless ``exact``."""
    if exact:
        hit = F.col(id).rlike("(?s)^" + "".join(c if c.isalnum() else "\\" + c for c in name) + r"-\d+$")
    elif not {*name} & {*"*?"}:
        hit = F.col(id).startswith(f"{name}-")
    else:
        hit = F.col(id).like("".join({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c) for c in name) + "-%")
    return F.coalesce(hit, F.lit(False))


def purged(chunks: DataFrame, name: str, exact: bool = False, id: str = "chunk_id") -> DataFrame:
    """The chunks that purging the file ``name`` leaves; a chunk without an id stays."""
    return chunks.where(~doomed(name, exact, id))


def cache_key(text: Column, model: str, version: str) -> Column:
    """The key of a text under a model; null for null."""
    return F.sha2(F.concat(F.lit(f"{model}\n{version}\n"), text), 256)


def cache_misses(docs: DataFrame, cached: DataFrame, model: str, version: str, text: str = "text") -> DataFrame:
    """The rows with a text whose key the cache (k) doesn't have, with ``k``."""
    keyed = docs.withColumn("k", cache_key(F.col(text), model, version)).where("k IS NOT NULL")
    return keyed.join(cached.select("k").distinct(), "k", "left_anti")


def embedding_of(text: Column | str, embedder: Embedder) -> Column:
    """A text's vector by a provider that is given slices of batches; a null text is embedded as a space."""

    def embed(texts: list[str | None]) -> pa.Array:
        rows = [t or "" for t in texts]
        m = embedded_each(embedder.embed, rows).astype(np.float32) if rows else np.zeros((0, embedder.width), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    return F.arrow_udf(lambda texts: by_slice(texts, embed), "array<float>")(text)


def embed(chunks: DataFrame, embedder: Embedder | None = None, cache: str | None = None, text: str = "text") -> DataFrame:
    """``chunks`` with embedding, model and created_at.

    With ``cache``, a table of (k, v) in that folder, only distinct texts that it lacks are
    embedded, and are appended to it; the result then reads all vectors from there.  Without, each
    text is embedded where it stands and nothing is shuffled.
    """
    spark, embedder = chunks.sparkSession, embedder or Hashing()
    if cache is None:
        out = chunks.withColumn("embedding", embedding_of(text, embedder))
    else:
        key = cache_key(F.coalesce(F.col(text), F.lit("")), embedder.name, embedder.version)
        keyed = chunks.select("*", key.alias("__lectern_k"))
        have = _table(spark, cache, "k string, v array<float>")
        missing = keyed.select(F.col("__lectern_k").alias("k"), F.col(text).alias("t")).join(have.select("k"), "k", "left_anti").dropDuplicates(["k"])
        missing.select("k", embedding_of("t", embedder).alias("v")).write.mode("append").parquet(cache)
        vectors = _table(spark, cache, "k string, v array<float>").dropDuplicates(["k"])
        out = keyed.join(vectors.select(F.col("k").alias("__lectern_k"), F.col("v").alias("embedding")), "__lectern_k", "left").drop("__lectern_k")
    model = F.struct(F.lit(embedder.name).alias("name"), F.lit(embedder.version).alias("version"))
    return out.withColumns({"model": model, "created_at": utc_now()})


def current(chunks: DataFrame) -> DataFrame:
    """Chunks whose ``metadata`` may hold what older ones kept there, at the top level; absent and null become empty."""
    old = {f.name for f in chunks.schema["metadata"].dataType.fields} if "metadata" in chunks.columns else set()
    empty = {"keywords": F.expr("cast(array() as array<string>)"), "headings": F.from_json(F.lit("{}"), _TITLES), "heading": F.from_json(F.lit("{}"), _TITLES), "full_headings": F.lit("")}
    out = {}
    for name, default in empty.items():
        found = ([F.col(name)] if name in chunks.columns else []) + ([F.col(f"metadata.{name}")] if name in old else [])
        out[name] = F.coalesce(*found, default)
    return chunks.withColumns(out).drop("metadata")


def stored(chunks: DataFrame) -> DataFrame:
    """Chunks as a collection stores them: those with a vector, titles and structs without content as null."""
    have = set(chunks.columns)

    def titles(name: str) -> Column:
        each = [F.nullif(F.col(f"{name}.h{k}"), F.lit("")) for k in range(1, 7)]
        return F.when(F.coalesce(*each).isNotNull(), F.struct(*(e.alias(f"h{k}") for k, e in enumerate(each, 1))))

    def field(f: StructField) -> Column:
        if f.name == "keywords":
            return F.coalesce(*([F.col(f.name)] if f.name in have else []), F.expr("cast(array() as array<string>)")).alias(f.name)
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if f.name in ("headings", "heading"):
            return titles(f.name).cast(f.dataType).alias(f.name)
        if f.name == "full_headings":
            return F.nullif(F.col(f.name), F.lit("")).alias(f.name)
        return F.col(f.name).try_cast(f.dataType).alias(f.name)

    out = chunks.select(*map(field, SCHEMA.fields))
    return out.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))


def _table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table in a folder; an empty one if there is none yet."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(there) else spark.createDataFrame([], schema)


class Corpus:
    """A collection in a folder that all executors share, in buckets by a hash of the file.

    Adding a file touches its bucket alone.  A purge reads ids everywhere, for a name is a prefix,
    and rewrites the buckets that it hits.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, scorer: Scorer | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.embedder, self.scorer, self.buckets = spark, path.rstrip("/"), embedder or Hashing(), scorer, buckets
        self._home = f"{self.path}/chunks"

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _rows(self) -> DataFrame:
        return _table(self.spark, self._home, StructType([*SCHEMA.fields, StructField("bucket", IntegerType())]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(file_of(F.col("chunk_id")), F.lit(""))), F.lit(self.buckets)).cast("int")

    def _move(self, staged: str) -> None:
        """Puts the files of a staged table's buckets among the collection's: what was written once isn't written again."""
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs, home = Path(staged).getFileSystem(self.spark._jsc.hadoopConfiguration()), Path(self._home)
        for bucket in fs.globStatus(Path(f"{staged}/bucket=*")):
            to = Path(home, bucket.getPath().getName())
            files = [f.getPath() for f in fs.listStatus(bucket.getPath())] if fs.exists(to) else [bucket.getPath()]
            for f in files:  # their names are unique
                if not fs.rename(f, to):
                    raise OSError(f"{f} can't be moved to {to}")

    def reset(self) -> Corpus:
        """Drops all chunks; the collection exists, empty."""
        self._delete(self._home)
        self._rows().write.mode("overwrite").partitionBy("bucket").parquet(self._home)
        return self

    def table(self) -> DataFrame:
        """All chunks."""
        return self._rows().drop("bucket")

    def has(self, file: str) -> bool:
        """Whether any chunk's id begins with ``file``."""
        return not self._rows().where(F.col("chunk_id").startswith(file)).limit(1).isEmpty()

    def add(self, embedded: DataFrame, mode: str = "append") -> int:
        """Adds chunks that have a vector; their number.  'append' duplicates what is there already, 'replace'
        first drops the files' own chunks, 'new' raises if there are any."""
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        stored(embedded).withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(staged)
        try:
            rows = _table(self.spark, staged, self._rows().schema)
            many = rows.count()
            if mode != "append":
                files = rows.select(file_of(F.col("chunk_id")).alias("f"), "bucket").distinct()
                old = self._rows().withColumn("__lectern_f", file_of(F.col("chunk_id")))
                hit = old.join(files, (F.col("__lectern_f") == F.col("f")) & (old.bucket == files.bucket), "left_semi")
                if mode == "new" and not hit.limit(1).isEmpty():
                    raise ValueError("the collection has chunks of such a file already")
                self._rewrite(hit.select("bucket").distinct(), lambda keep: keep.withColumn("__lectern_f", file_of(F.col("chunk_id"))).join(files.select("f"), F.col("__lectern_f") == F.col("f"), "left_anti").drop("__lectern_f"))
            self._move(staged)
            return many
        finally:
            self._delete(staged)

    def _rewrite(self, touched: DataFrame, kept) -> None:
        """Leaves ``kept`` of the rows of the buckets ``touched``, at most as many as the collection has buckets."""
        buckets = [r.bucket for r in touched.collect()]
        if not buckets:
            return
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        kept(self._rows().where(F.col("bucket").isin(buckets))).write.partitionBy("bucket").parquet(staged)
        try:
            for b in buckets:
                self._delete(f"{self._home}/bucket={b}")
            self._move(staged)
        finally:
            self._delete(staged)

    def purge(self, name: str, exact: bool = False) -> int:
        """Deletes a file's chunks, by ``doomed``; how many there were."""
        hits = {r.bucket: r.n for r in self._rows().where(doomed(name, exact)).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        touched = self.spark.createDataFrame([(b,) for b in hits], "bucket int")
        self._rewrite(touched, lambda rows: purged(rows, name, exact))
        return sum(hits.values())

    def total(self) -> int:
        return self._rows().count()

    def info(self) -> DataFrame:
        """(file, n) in order of the files; the total's file is null and stands first."""
        return info(self._rows()).orderBy(F.col("file").asc_nulls_first())

    def images(self, markdown: DataFrame, describer: Describer | None = None) -> DataFrame:
        return describe_images(markdown, describer, f"{self.path}/images" if describer else None)

    def embeddings(self, markdown: DataFrame, budget: int = chunking.BUDGET) -> DataFrame:
        """The embedded chunks of (source_file, text), vectors from and to the collection's cache.

        Chunks are written to the shared folder first: they are read for the cache and each time they are added.
        """
        path = scratch(self.spark, "chunks")
        chunks = chunking.chunk(markdown, budget)
        chunks.write.parquet(path)
        return embed(self.spark.read.schema(chunks.schema).parquet(path), self.embedder, f"{self.path}/cache")

    def _vector(self, query: str) -> list[float]:
        return embedded_each(self.embedder.embed, [query])[0].tolist()

    def search(self, query: str, k: int = 50, properties: list[str] | None = None) -> DataFrame:
        """The ``k`` chunks nearest to a query, with distance; of their properties those listed, which may be nested ("headings.h1")."""
        hits = self._hits(query, k).drop("rank")
        return hits if properties is None else hits.select(*properties, "distance")

    def _hits(self, query: str, k: int) -> DataFrame:
        """``search`` with each hit's rank."""
        near = retrieval.ranked(self._keyed(), self._vector(query), k, "key")
        return self._keyed().join(F.broadcast(near), "key").drop("key", "embedding").orderBy("rank")

    def _keyed(self) -> DataFrame:
        """Chunks by id, one for each: a file that was added twice has its chunks twice."""
        return self.table().withColumn("key", F.col("chunk_id")).where("key IS NOT NULL").dropDuplicates(["key"])

    def bm25(self, query: str, k: int = 50) -> DataFrame:
        """The ``k`` best chunks for a query's words, with score."""
        words = [w for w in retrieval.re_terms(query)]
        best = retrieval.bm25(self._keyed().select(F.col("key").alias("doc_id"), "text"), words, k)
        return self._keyed().join(F.broadcast(best), F.col("key") == F.col("doc_id")).drop("key", "doc_id", "embedding").orderBy(F.desc("score"), "chunk_id")

    def request(self, question: str, model: str, rerank: bool = False, k: int = 50, first: int = 500) -> DataFrame:
        """(prompt, n_tokens, request): what is to be asked, from the ``k`` nearest chunks, with titles.

        An embedder that says so (``reranks`` false) is refused with ``rerank``: its distances stand by themselves.
        """
        if rerank and not getattr(self.embedder, "reranks", True):
            raise ValueError(f"hits by the embedder {self.embedder.name!r} are not reranked")
        hits = self._hits(question, first if rerank else k)
        if rerank:
            hits = retrieval.reranked(hits, question, self.scorer).limit(k)
            hits = hits.withColumn("rank", F.row_number().over(_by(F.desc("reranker"), "rank")))
        hits = chunking.add_title(hits.select("*", *(F.col(f"headings.h{i}").alias(f"h{i}") for i in range(1, 7))), [f"h{i}" for i in range(1, 7)])
        out = retrieval.prompt(hits, question, "rank", id="chunk_id")
        return out.withColumn("request", retrieval.request_json(F.col("prompt"), model))


def _by(*order: Column | str) -> WindowSpec:
    """The order of a question's hits, which are few."""
    return Window.orderBy(*order)


START, END = "<IMAGE DESCRIPTION START>", "<IMAGE DESCRIPTION END>"


def describe_images(docs: DataFrame, describer: Describer | None = None, cache: str | None = None, force: bool = False, text: str = "text", constant: str = "pas de description") -> DataFrame:
    """``docs`` with every embedded image replaced by its description between image tags.

    Without ``describer`` the description is ``constant``.  With it, each distinct image, by the
    SHA-1 of its data, is described once; ``cache``, a table of (k, v), is looked up first unless
    ``force``, and what is new is appended to it.  Texts without images aren't shuffled.
    """
    if describer is None:
        return docs.withColumn(text, F.regexp_replace(text, IMAGE, f"{START}{constant}{END}"))
    spark, columns = docs.sparkSession, docs.columns
    urls = F.regexp_extract_all(text, F.lit(IMAGE), 2)
    some = docs.withColumn("__lectern_u", urls)
    plain = some.where(F.coalesce(F.size("__lectern_u") == 0, F.lit(True))).select(*columns)
    some = some.where(F.size("__lectern_u") > 0).withColumn("__lectern_t", F.sha2(text, 256))
    each = some.select("__lectern_t", F.posexplode("__lectern_u").alias("at", "url")).dropDuplicates(["__lectern_t", "at"])
    each = each.withColumn("k", F.sha1(F.substring_index("url", ";base64,", -1)))
    images = each.select("k", "url").dropDuplicates(["k"])
    have = spark.createDataFrame([], "k string, v string") if cache is None else _table(spark, cache, "k string, v string")
    missing = images if force else images.join(have.select("k"), "k", "left_anti")

    def describe(urls: pa.Array) -> pa.Array:
        return pa.array([f"{START}{d}{END}" for d in describer.describe(urls.to_pylist())], pa.string())

    new = missing.select("k", F.arrow_udf(describe, "string")("url").alias("v"), F.current_timestamp().alias("when"))
    if cache is None:
        known = new.select("k", "v")
    else:
        new.write.mode("append").parquet(cache)
        newest = spark.read.schema("k string, v string, when timestamp").parquet(cache)
        known = newest.groupBy("k").agg(F.max_by("v", "when").alias("v"))
    parts = each.join(known, "k").groupBy("__lectern_t").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("__lectern_d"))
    out = some.join(parts, "__lectern_t")
    between = F.split(text, IMAGE, -1)
    whole = F.array_join(F.zip_with(between, F.transform("__lectern_d", lambda x: x["v"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return plain.unionByName(out.withColumn(text, whole).select(*columns))
