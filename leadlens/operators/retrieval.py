"""Document retrieval.

* ``chunk_documents`` -- whole texts cut into overlapping token windows with
  array functions (``sequence`` + ``posexplode`` + ``slice``), no UDF, no shuffle.
* ``embed_chunks`` -- a pluggable embedding stage.  The default is a hashed
  term-count vector (tokens hashed into ``dims`` buckets, counted per row with
  ``numpy.bincount`` in an Arrow-batched pandas UDF): it runs offline and is
  reproducible across engines.  A real sentence model would be another function
  returning the same (ids..., embedding) shape.
* ``weighted`` -- counts times inverse document frequency, unit length; the frequencies are a table
  saved with the index.
* ``vector_top_k`` -- exact cosine top-k.  The query side is shipped in batches
  of a checked size; the corpus is never broadcast.  Corpus slices are scored
  with one matrix product each, a task keeps a running k best per query, and
  ``row_number() <= k`` (a partial ``WindowGroupLimit`` before the shuffle)
  merges the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .ordered import ordered_scan

MAX_BROADCAST_QUERIES = 4096
COUNT_ROWS = 1024  # token lists that are counted at a time


def tokens(text: Column) -> Column:
    """Whitespace tokens of the whole text (leading/trailing blanks ignored; a NULL
    text has no tokens)."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(stripped.isNull() | (stripped == ""), F.array().cast("array<string>")) \
            .otherwise(F.split(stripped, r"\s+"))


def chunk_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = 512, overlap: int = 64) -> DataFrame:
    """(id, chunk_id, start_token, n_tokens, text) windows of ``size`` tokens
    advancing by ``size - overlap``; a window is emitted only if it adds tokens
    the previous one did not cover."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be in [0, size)")
    step = size - overlap
    tok = df.select(F.col(id_col), tokens(F.col(text_col)).alias("__tok"))
    n = F.size("__tok")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    ex = tok.select(id_col, "__tok", F.posexplode(starts).alias("chunk_id", "start_token"))
    piece = F.slice("__tok", F.col("start_token") + 1, size)
    return ex.select(id_col, F.col("chunk_id").cast("long").alias("chunk_id"),
                     F.col("start_token").cast("long").alias("start_token"),
                     F.size(piece).cast("long").alias("n_tokens"),
                     F.array_join(piece, " ").alias("text"))


def token_buckets(text: Column, dims: int, hash_fn: str = "xxhash64") -> Column:
    """Bucket id of every lower-cased token.  ``md5`` buckets are reproducible in
    other engines (first 8 hex digits mod dims); ``xxhash64`` is faster."""
    toks = tokens(F.lower(text))
    if hash_fn == "md5":
        return F.transform(toks, lambda t: F.pmod(
            F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dims)).cast("int"))
    return F.transform(toks, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))


def _bucket_counts(array: pa.Array, bucket_of, dims: int) -> Iterator[pa.Array]:
    """Counts per bucket of the lists of an Arrow column, for at most ``COUNT_ROWS`` lists at a time."""
    for lo in range(0, len(array), COUNT_ROWS):
        part = array.slice(lo, COUNT_ROWS)
        lengths = np.asarray(pc.fill_null(pc.list_value_length(part), 0)).astype(np.int64)
        rows = np.repeat(np.arange(len(part)), lengths)
        counts = np.bincount(rows * dims + bucket_of(part.flatten()), minlength=len(part) * dims)
        ends = pa.array(np.arange(len(part) + 1) * dims, pa.int32())
        yield pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()), mask=part.is_null())


def _counter(bucket_of, dims: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def counts(lists: pa.Array) -> pa.Array:
        parts = list(_bucket_counts(lists, bucket_of, dims))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))
    return counts


def _md5_bucket_counter(dims: int):
    """Term counts per md5 bucket from token arrays, which stay in Arrow: only the distinct tokens of a
    slice become Python strings, to be hashed once."""
    import hashlib

    def bucket_of(tokens: pa.Array) -> np.ndarray:
        coded = tokens.dictionary_encode()
        buckets = np.fromiter((int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % dims for t in coded.dictionary.to_pylist()),
                              np.int64, len(coded.dictionary))
        return buckets[np.asarray(coded.indices)]
    return _counter(bucket_of, dims)


def _bincounter(dims: int):
    return _counter(lambda buckets: np.asarray(buckets).astype(np.int64), dims)


def embed_chunks(df: DataFrame, id_cols: Sequence[str], text_col: str = "text",
                 dims: int = 256, hash_fn: str = "xxhash64") -> DataFrame:
    """R2: ``id_cols`` + ``embedding`` (term counts per hashed bucket).  Row-local:
    no shuffle.  Pass ``id_cols=None`` to keep every input column."""
    if hash_fn == "md5":
        emb = _md5_bucket_counter(dims)(tokens(F.lower(F.col(text_col))))
    else:
        emb = _bincounter(dims)(token_buckets(F.col(text_col), dims, hash_fn))
    keep = [F.col(c) for c in id_cols] if id_cols is not None else [F.col("*")]
    return df.select(*keep, emb.alias("embedding"))


def document_frequencies(embedded: DataFrame, vec: str = "embedding") -> DataFrame:
    """The weighting model of an index: (bucket, df, n, idf) with idf = ln((1 + n) / (1 + df)) + 1 over
    the rows of ``embedded``; one row per bucket that occurs."""
    used = embedded.where(F.col(vec).isNotNull())
    n = used.select(F.count(F.lit(1)).alias("n"))
    seen = used.select(F.posexplode(vec).alias("bucket", "count")).where("count > 0")
    df = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select(  # one row
        "bucket", "df", "n", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(embedded: DataFrame, model: DataFrame, dims: int, vec: str = "embedding") -> DataFrame:
    """R2: counts times idf, scaled to length 1 (a zero vector stays zero).  A bucket that the model
    does not know has the idf of df = 0.  The model has at most ``dims`` rows and becomes one array."""
    unseen = F.log1p(F.max("n").cast("double")) + 1
    row = model.agg(F.sort_array(F.collect_list(F.struct("bucket", "idf"))).alias("w"), F.coalesce(unseen, F.lit(1.0)).alias("unseen"))
    known = F.map_from_entries(F.col("__m.w"))
    idf = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.coalesce(F.element_at(known, b), F.col("__m.unseen")))
    array = row.select(F.struct("w", "unseen").alias("__m")).select(idf.alias("__idf"))
    both = embedded.crossJoin(F.broadcast(array))  # one row
    product = F.zip_with(F.col(vec), F.col("__idf"), lambda c, w: c * w)
    out = both.withColumn("__p", product)
    norm = F.sqrt(F.aggregate("__p", F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("__n", norm).withColumn(
        vec, F.when(F.col("__n") > 0, F.transform("__p", lambda x: x / F.col("__n"))).otherwise(F.col("__p"))).drop("__idf", "__p", "__n")


def usable_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is there and holds no NULL; others take no part in a search."""
    return df.where(F.col(vec).isNotNull() & F.forall(F.col(vec), lambda x: x.isNotNull()))


def vector_top_k(queries: DataFrame, corpus: DataFrame, query_id: str, doc_ids: Sequence[str],
                 vec: str = "embedding", k: int = 5,
                 max_broadcast: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """For every query the k most cosine-similar corpus rows.

    Output: query_id, rank, doc ids..., similarity (NULL for zero vectors).
    Ties are broken by the doc ids (NULL first).  Rows without a vector, or with a NULL in it,
    take no part; ids keep their type and value (they never leave Arrow), NULL ids included.
    The queries are shipped to the tasks in batches of about ``max_broadcast`` rows (counted
    first); a task scores its corpus slices against a query batch with one matrix product each
    and returns k rows per query, so no (query, document) pair is materialised as a row; the
    final ``row_number() <= k`` merges the tasks' candidates.  ``vector_index`` searches a written
    index without shipping queries.
    """
    spark = queries.sparkSession
    q = usable_vectors(queries, vec).select(F.col(query_id).alias("__qid"), F.col(vec).cast("array<double>").alias("__qv"))
    n_q = q.count()
    n_batches = max(1, math.ceil(n_q / max_broadcast))
    id_fields = [corpus.schema[d] for d in doc_ids]
    qid_type = queries.schema[query_id].dataType
    names = [f"__d{i}" for i in range(len(doc_ids))]
    out_schema = T.StructType([T.StructField("__qn", T.LongType())] + [T.StructField(n, f.dataType) for n, f in zip(names, id_fields)]
                              + [T.StructField("similarity", T.DoubleType())])
    given = usable_vectors(corpus, vec).select(*[F.col(d).alias(n) for d, n in zip(doc_ids, names)],
                                               F.col(vec).cast("array<double>").alias("__cv"))
    results = None
    for b in range(n_batches):
        qb = q if n_batches == 1 else q.where(F.pmod(F.xxhash64("__qv"), F.lit(n_batches)) == b)
        rows = qb.collect()                       # about max_broadcast query vectors
        if not rows:
            continue
        qmat = np.array([r["__qv"] for r in rows], dtype=np.float64)
        bc = spark.sparkContext.broadcast(qmat)
        scored = given.mapInArrow(_batch_top_k(bc, names, k), out_schema)
        w = Window.partitionBy("__qn").orderBy(F.desc_nulls_last("similarity"), *[F.asc(n) for n in names])
        top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, r["__qid"]) for i, r in enumerate(rows)],
                                    T.StructType([T.StructField("__qn", T.LongType()), T.StructField("__qid", qid_type)]))
        top = top.join(F.broadcast(ids), "__qn")
        results = top if results is None else results.unionByName(top)
    if results is None:
        return spark.createDataFrame([], T.StructType([T.StructField(query_id, qid_type),
                                                       T.StructField("rank", T.IntegerType())] + id_fields +
                                                      [T.StructField("similarity", T.DoubleType())]))
    return results.select(F.col("__qid").alias(query_id), "rank", *[F.col(n).alias(d) for n, d in zip(names, doc_ids)], "similarity")


def best_of(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest entries of every row; ties to the first columns."""
    m = distance.shape[1]
    if m <= k:
        return tuple(x.ravel() for x in np.indices(distance.shape))
    kth = np.partition(distance, k - 1, axis=1)[:, k - 1:k]
    less, same = distance < kth, distance == kth
    same &= np.cumsum(same, axis=1) <= k - less.sum(axis=1, keepdims=True)
    return np.nonzero(less | same)


def _batch_top_k(bc, names: list[str], k: int, slice_rows: int = 1024):
    """One matrix product of the query batch with each corpus slice (<= ``slice_rows`` rows, in the
    order of their ids), and a running k best per query under (similarity desc, ids asc): a task
    returns k rows a query, however many slices it reads."""
    def fn(batches):
        qmat = bc.value
        qn = np.sqrt((qmat * qmat).sum(1))
        best = None
        by_id = [(n, "ascending") for n in names]
        for batch in batches:
            for lo in range(0, batch.num_rows, slice_rows):
                part = pa.Table.from_batches([batch.slice(lo, slice_rows)])
                part = part.take(pc.sort_indices(part.select(names), sort_keys=by_id, null_placement="at_start")) if names else part
                cmat = matrix(part["__cv"], qmat.shape[1])
                cn = np.sqrt((cmat * cmat).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    sim = (qmat @ cmat.T) / (qn[:, None] * cn[None, :])
                neg = np.where(np.isfinite(sim), -sim, np.inf)       # NULL similarity sorts last
                row, col = best_of(neg, k)
                found = part.select(names).take(pa.array(col))
                found = found.append_column("__qn", pa.array(row, pa.int64())).append_column("__neg", pa.array(neg[row, col]))
                if best is not None:
                    found = pa.concat_tables([best, found])
                    found = found.take(pc.sort_indices(found, sort_keys=[("__qn", "ascending"), ("__neg", "ascending"), *by_id],
                                                       null_placement="at_start"))
                    qs = found["__qn"].to_numpy()
                    place = np.arange(len(qs)) - np.searchsorted(qs, qs)
                    found = found.filter(pa.array(place < k))
                best = found.combine_chunks()
        if best is not None and best.num_rows:
            neg = best["__neg"].to_numpy()
            out = best.select(["__qn", *names]).append_column(
                "similarity", pa.array(-neg, pa.float64(), mask=~np.isfinite(neg)))
            yield from out.combine_chunks().to_batches()
    return fn


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column; shorter rows with zeros, longer ones cut to ``dims``."""
    array = lists.combine_chunks()
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    n = np.asarray(pc.list_value_length(array)).astype(np.int64)
    flat = np.asarray(array.flatten(), float)
    if (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    row = np.repeat(np.arange(len(n)), n)
    column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out[row[column < dims], column[column < dims]] = flat[column < dims]
    return out


def centroids(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Per-key mean vector (element-wise), e.g. one query per label."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return df.groupBy(key).agg(vector_to_array(mean).alias(vec))


def assemble_context(top: DataFrame, chunks: DataFrame, query_id: str, doc_ids: Sequence[str],
                     text_col: str = "text", sep: str = "\n\n") -> DataFrame:
    """Per query, the retrieved chunk texts in rank order joined by ``sep``
    (at most k texts per query, so the collect is bounded)."""
    j = top.join(chunks.select(*doc_ids, text_col), list(doc_ids))
    agg = j.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("__r"))
    return agg.select(query_id, F.size("__r").alias("n_chunks"),
                      F.array_join(F.transform("__r", lambda s: s[text_col]), sep).alias("context"))


def conversation_history(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role") -> DataFrame:
    """Turns replayed in order: position within the conversation and the
    number of earlier user turns (skew-safe per-conversation scan)."""
    flagged = conv.withColumn("__user", (F.col(role) == "user").cast("long"))
    s = ordered_scan(flagged, by=[conv_id], order=[turn], row_number="position",
                     running={"__users": "__user"})
    return s.select(*conv.columns, "position",
                    (F.col("__users") - F.col("__user")).alias("prior_user_turns"))


def build_weighted_index(docs: DataFrame, path: str, size: int = 512, overlap: int = 64, dims: int = 256,
                         hash_fn: str = "xxhash64") -> DataFrame:
    """Chunks with weighted embeddings under ``path``/chunks and their weighting model under
    ``path``/idf, which queries need as well (:func:`weighted_queries`)."""
    spark = docs.sparkSession
    counts = materialize(build_index(docs, None, size, overlap, dims, hash_fn), "term-counts")
    document_frequencies(counts).write.mode("overwrite").parquet(f"{path}/idf")
    write_index(weighted(counts, spark.read.parquet(f"{path}/idf"), dims), f"{path}/chunks")
    return read_index(spark, f"{path}/chunks")


def weighted_queries(queries: DataFrame, path: str, id_cols: Sequence[str], text_col: str = "text", dims: int = 256,
                     hash_fn: str = "xxhash64") -> DataFrame:
    """Questions embedded with the weights of the index under ``path``."""
    model = read_index(queries.sparkSession, f"{path}/idf")
    return weighted(embed_chunks(queries, id_cols, text_col, dims, hash_fn), model, dims)


def write_index(chunks_with_vectors: DataFrame, path: str) -> None:
    """Persist (doc_id, chunk_id, text, embedding) as Parquet."""
    chunks_with_vectors.write.mode("overwrite").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    """Load a persisted index; a missing index is an error, not an empty table."""
    from ..session import path_exists

    if not path_exists(spark, path):
        raise FileNotFoundError(f"No index found at '{path}'. Build it with build_index first.")
    return spark.read.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Every file under ``path`` as one whole-text document."""
    df = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"),
                                                      F.col("_metadata.file_path").alias("path"))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def build_index(docs: DataFrame, path: str | None = None, size: int = 512, overlap: int = 64,
                dims: int = 256, hash_fn: str = "xxhash64") -> DataFrame:
    """Documents -> chunks -> embeddings (-> Parquet when ``path`` is given)."""
    ch = chunk_documents(docs, "doc_id", "text", size, overlap)
    idx = embed_chunks(ch, None, "text", dims, hash_fn)
    if path:
        write_index(idx, path)
    return idx
