"""Exact top-k search by integer inner product: columnar branch and bound.

Vectors are turned into blocks of at most ``BLOCK_ROWS`` rows in vertical layout (one run of
values per dimension).  Queries form blocks of about ``QUERY_ROWS``.  A join on (group of data
blocks, query block) brings each query block to groups of about ``GROUP_BLOCKS`` data blocks, so
both sides of a pair have about as many rows and what is copied per pair of rows is least; a
task holds one such pair at a time.

Inside, scores accumulate one block of ``DIMS`` dimensions after the other.  What the later
dimensions can still add is at most the product of the remaining norms (Cauchy-Schwarz), so a
candidate whose sum plus that bound lies under the query's tenth score so far is dropped; the
survivors are compacted before the next dimension block.  Each query keeps its k best over the
group's blocks; the k best over groups are taken by a window with a partial limit.

Defined results: a vector that is null, or holds null or non-finite components, takes no part,
nor does a null vec_id; a missing component of a shorter vector counts as 0; rows that share a
vec_id are candidates one by one, as a query they count once (with the smallest vector); a
query's own id is never its candidate; scores outside the range of a long are clipped to it; fewer
than k candidates give them all; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlens.session import materialize

from .common import column, table

K = 10
SCALE = 1024
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
GROUP_BLOCKS = 1
MAX_TASKS = 20_000
DIMS = 8

_BLOCK = "part long, block long, n int, dims int, ids binary, vectors binary"
_EXACT = float(1 << 53)


def quantise(ids: pa.Array, vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer values as doubles, row per vector) of the vectors that take part."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(vectors), 0)
    n = np.asarray(lengths).astype(np.int64)
    flat = vectors.flatten()
    values = np.asarray(pc.fill_null(flat, float("nan"))).astype(float)
    row = np.repeat(np.arange(len(n)), n)
    good = np.asarray(pc.and_(pc.is_valid(vectors), pc.is_valid(ids))).copy()
    good[row[~np.isfinite(values)]] = False
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    column_of = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, column_of] = np.clip(np.floor(values * scale), -1e300, 1e300)
    return np.asarray(pc.fill_null(ids, 0))[good].astype(np.int64), out[good]


def _blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    names = [f.split(" ")[0] for f in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, values = quantise(column(batch, "vec_id").cast(pa.int64()), column(batch, "embedding"), scale)
            for lo in range(0, len(ids), rows):
                x = np.ascontiguousarray(values[lo:lo + rows].T)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([x.shape[1]], pa.int32()),
                     pa.array([x.shape[0]], pa.int32()), pa.array([ids[lo:lo + rows].tobytes()], pa.binary()),
                     pa.array([x.tobytes()], pa.binary())], names=names)
                block += 1

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, _BLOCK)


def _load(block: dict) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(block["ids"], np.int64),
            np.frombuffer(block["vectors"], float).reshape(block["dims"], block["n"]))


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def threshold(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # all that tie with the k-th stay
            scores_k = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = scores >= scores_k
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def _rest(x: np.ndarray, dims: int) -> np.ndarray:
    """Norm of the dimensions from each dimension block on, with slack for rounding."""
    cuts = range(0, x.shape[0], dims)
    square = np.array([(x[c:c + dims] * x[c:c + dims]).sum(axis=0) for c in cuts] + [np.zeros(x.shape[1])])
    return np.sqrt(np.cumsum(square[::-1], axis=0)[::-1]) * (1 + 1e-9)


def search_block(best: Best, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Add a data block's candidates (columns of ``x``) for all queries (columns of ``q``)."""
    dims = max(q.shape[0], x.shape[0], 1)
    q, x = (np.concatenate((v, np.zeros((dims - v.shape[0], v.shape[1])))) for v in (q, x))
    top = (float(np.abs(q).max(initial=0)) + 1) * (float(np.abs(x).max(initial=0)) + 1) * dims
    if top >= _EXACT:
        return _search_large(best, query_ids, q, ids, x)
    rest_q, rest_x = _rest(q, DIMS), _rest(x, DIMS)
    first = q[:DIMS].T @ x[:DIMS]
    for i in range(q.shape[1]):
        least = best.threshold(i)
        alive = np.flatnonzero((first[i] + rest_q[1, i] * rest_x[1] >= least) & (ids != query_ids[i]))
        score = first[i, alive]
        for b, at in enumerate(range(DIMS, dims, DIMS), start=1):
            if not len(alive):
                break
            score = score + q[at:at + DIMS, i] @ x[at:at + DIMS][:, alive]
            keep = score + rest_q[b + 1, i] * rest_x[b + 1, alive] >= least
            if not keep.all():
                score, alive = score[keep], alive[keep]
        if len(alive):
            best.add(i, score, ids[alive])


def _search_large(best: Best, query_ids, q, ids, x) -> None:
    """Values too large for exact doubles: whole integers, clipped to a long."""
    lo, hi = -(1 << 63), (1 << 63) - 1
    xs = [[int(v) for v in col] for col in x.T]
    for i in range(q.shape[1]):
        qi = [int(v) for v in q[:, i]]
        found = [(max(lo, min(hi, sum(a * b for a, b in zip(qi, col)))), int(v)) for col, v in zip(xs, ids) if v != query_ids[i]]
        held = list(zip([int(s) for s in best.scores[i]], best.ids[i].tolist()))
        found = sorted(held + found, key=lambda p: (-p[0], p[1]))[:best.k]
        best.scores[i] = np.array([s for s, _ in found], object)
        best.ids[i] = np.array([v for _, v in found], np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """For each query (vec_id, embedding) its k best rows of ``vectors``: query_id, rank (from 1),
    vec_id, score."""
    spark = vectors.sparkSession
    data = materialize(_blocks(vectors, BLOCK_ROWS, scale), "vector-blocks")
    one_each = queries.filter("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(
        F.min("embedding").alias("embedding"))
    n_query_blocks = max(1, -(-one_each.count() // QUERY_ROWS))
    asked = materialize(_blocks(one_each.repartition(n_query_blocks), 2 * QUERY_ROWS, scale), "query-blocks")
    n_groups = max(1, -(-data.count() // GROUP_BLOCKS))
    # the grid: every group of data blocks with every query block
    qb = F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))
    g = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    d = data.withColumn("g", F.pmod(F.hash("part", "block"), F.lit(n_groups))).withColumn("qb", qb)
    q = asked.select(F.col("part").cast("int").alias("qb"), F.col("n").alias("qn"), F.col("dims").alias("qdims"),
                     F.col("ids").alias("qids"), F.col("vectors").alias("qvectors")).withColumn("g", g)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out: list[tuple] = []
        for r in right.to_pylist():
            query_ids, q = _load({"ids": r["qids"], "vectors": r["qvectors"], "dims": r["qdims"], "n": r["qn"]})
            best = Best(len(query_ids), k)
            for i in range(left.num_rows):
                ids, x = _load(left.slice(i, 1).to_pylist()[0])
                search_block(best, query_ids, q, ids, x)
            for i, query in enumerate(query_ids.tolist()):
                out += [(query, int(v), int(s)) for s, v in zip(best.scores[i], best.ids[i])]
        return pa.table([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], names=names)

    # a cell is small in bytes and large in work: cells are dealt one to a task, not by their size
    tasks = min(n_groups * n_query_blocks, MAX_TASKS)
    d, q = d.repartition(tasks, "g", "qb"), q.repartition(tasks, "g", "qb")
    found = d.groupBy("g", "qb").cogroup(q.groupBy("g", "qb")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
