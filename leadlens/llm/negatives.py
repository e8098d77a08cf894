"""Hard-negative mining: exact integer scores of anchors and candidates by Strassen multiplication,
kept in mergeable heaps.

Candidates lie in groups of about ``GROUP_ROWS`` rows, anchors in blocks of about ``ANCHOR_ROWS``; a
join on (group, anchor block) brings each pair of them to one task.  There, tiles of anchors and
candidates are multiplied as int64 matrices by Strassen's recursion (odd sides padded with zeros,
exact additions) down to sides of ``LEAF``.

* Pass 1 multiplies rows of the same label and keeps each anchor's best scores in a *positive heap*.
* Pass 2 multiplies anchors with all candidates and keeps, for each of the anchor's positives, the
  best different-label scores inside the positive's window in a *window heap*.

Heaps of a tile merge into those of the cell, and cells merge in a window function with a partial
limit, so no (anchor, candidate) pair becomes a row.  Both sides of a cell are bounded by their
number of rows, whatever labels or anchors are frequent.

Defined results: rows with a null label, vec_id or vector, or with null or non-finite components
take no part; a missing component of a shorter vector counts as 0; components beyond +-2^62 and
scores beyond a long become that bound; rows that share a vec_id are candidates one by one, as an
anchor they count once (smallest label, then vector), and none of them is the anchor's own
positive or negative; ties go to the smaller vec_id; an anchor without positives, or a window
without rows, gives no row; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlens.session import materialize

from .common import column, table
from .vectors import pack, stack, unpack, whole_numbers, widen

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive's score
GROUP_ROWS = 4096
ANCHOR_ROWS = 4096
MAX_TASKS = 20_000
BLOCK_ROWS = 1024
TILE = (256, 1024)
LEAF = 16
POSITIVES_MAX = 64

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_BLOCK = "part long, n long, width long, labels binary, ids binary, vectors binary, windows binary"
_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in (f.split(" ") for f in _BLOCK.split(", "))])
_WINDOWS = "array<struct<positive_id:bigint,positive_score:bigint>>"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The exact product of integer matrices."""
    rows, inner, cols = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, cols) <= leaf:
        return a @ b
    if rows % 2 or inner % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    if inner % 2 or cols % 2:
        b = np.pad(b, ((0, inner % 2), (0, cols % 2)))
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    out = np.zeros((2 * r, 2 * c), a.dtype)
    q11, q12, q21, q22 = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    m = strassen(a11 + a22, b11 + b22, leaf)
    q11 += m
    q22 += m
    m = strassen(a21 + a22, b11, leaf)
    q21 += m
    q22 -= m
    m = strassen(a11, b12 - b22, leaf)
    q12 += m
    q22 += m
    m = strassen(a22, b21 - b11, leaf)
    q11 += m
    q21 += m
    m = strassen(a11 + a12, b22, leaf)
    q11 -= m
    q12 += m
    q22 += strassen(a21 - a11, b11 + b12, leaf)
    q11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :cols]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``.  Sums and differences wrap in int64 and come
    out right where the product fits it; otherwise whole numbers of any size, clipped to a long."""
    top = max(-int(a.min(initial=0)), int(a.max(initial=0))) * max(-int(b.min(initial=0)), int(b.max(initial=0)))
    if top * max(a.shape[1], 1) < 1 << 62:
        return strassen(a, b.T)
    large = strassen(a.astype(object), b.T.astype(object))
    return np.clip(large, _LEAST, _MOST).astype(np.int64)


class Heaps:
    """The k best (score, id) of each of n rows so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), _LEAST, np.int64)
        self.ids = np.full((n, k), _MOST, np.int64)
        self.held = np.zeros((n, k), bool)

    def merge(self, rows: np.ndarray, found: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Offer ``found`` (rows x candidates) where ``allowed``."""
        k = self.scores.shape[1]
        allowed = allowed & (found >= np.where(self.held[rows, -1], self.scores[rows, -1], _LEAST)[:, None])
        if np.count_nonzero(allowed) > 8 * k * len(rows):  # what is under the row's k-th best cannot stay
            near = np.partition(np.where(allowed, found, _LEAST), -k, axis=1)[:, -k]
            allowed &= found >= near[:, None]
        r, c = np.nonzero(allowed)
        if not len(r):
            return
        hr, hc = np.nonzero(self.held[rows])
        row = np.concatenate((r, hr))
        score = np.concatenate((found[r, c], self.scores[rows[hr], hc]))
        ident = np.concatenate((ids[c], self.ids[rows[hr], hc]))
        order = np.lexsort((ident, ~score, row))
        row, score, ident = row[order], score[order], ident[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        stay = place < k
        at, place = rows[row[stay]], place[stay]
        self.scores[at, place], self.ids[at, place], self.held[at, place] = score[stay], ident[stay], True


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows (vec_id, label, embedding, windows) as blocks."""
    names = [f.split(" ")[0] for f in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            good, x = whole_numbers(column(batch, "embedding"), scale)
            x = x[good]
            ids, labels = (np.asarray(column(batch, c)).astype("<i8")[good] for c in ("vec_id", "label"))
            windows = [w for w, g in zip(column(batch, "windows").to_pylist(), good) if g]
            for lo in range(0, len(ids), size):
                hi = min(len(ids), lo + size)
                width, blob = pack(x[lo:hi])
                held = np.zeros((hi - lo, POSITIVES_MAX, 3), "<i8")
                for i, given in enumerate(windows[lo:hi]):
                    for j, w in enumerate(given or []):
                        held[i, j] = 1, w["positive_id"], w["positive_score"]
                depth = max((len(w or []) for w in windows[lo:hi]), default=0)
                yield pa.RecordBatch.from_pylist([dict(zip(names, (
                    part, hi - lo, width, labels[lo:hi].tobytes(), ids[lo:hi].tobytes(), blob,
                    np.ascontiguousarray(held[:, :depth]).tobytes())))], schema=_ARROW)

    usable = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding",
                         "windows").mapInArrow(run, _BLOCK)


class _Side:
    """One side of a cell: all its blocks above each other."""

    def __init__(self, cell: pa.Table):
        blocks = cell.to_pylist()
        self.labels = np.concatenate([np.frombuffer(b["labels"], "<i8") for b in blocks])
        self.ids = np.concatenate([np.frombuffer(b["ids"], "<i8") for b in blocks])
        self.x = stack([unpack(b["width"], b["vectors"], b["n"]) for b in blocks])
        windows = [np.frombuffer(b["windows"], "<i8").reshape(b["n"], -1, 3) for b in blocks]
        depth = max(w.shape[1] for w in windows)
        self.windows = np.concatenate([np.pad(w, ((0, 0), (0, depth - w.shape[1]), (0, 0))) for w in windows])


def _sides(anchors: pa.Table, candidates: pa.Table) -> tuple[_Side, _Side] | None:
    if not anchors.num_rows or not candidates.num_rows:
        return None
    a, c = _Side(anchors), _Side(candidates)
    dims = max(a.x.shape[1], c.x.shape[1])
    a.x, c.x = widen(a.x, dims), widen(c.x, dims)
    return a, c


def _tiles(n: int, size: int) -> Iterator[np.ndarray]:
    for lo in range(0, n, size):
        yield np.arange(lo, min(n, lo + size))


def positives_of(k: int):
    """Pass 1 in a cell: each anchor's k best rows of its label."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["anchor_id", "positive_id", "positive_score"]
        sides = _sides(anchors, candidates)
        if sides is None:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        a, c = sides
        heaps = Heaps(len(a.ids), k)
        for label in np.intersect1d(a.labels, c.labels).tolist():
            of_a, of_c = np.flatnonzero(a.labels == label), np.flatnonzero(c.labels == label)
            for i in _tiles(len(of_a), TILE[0]):
                rows = of_a[i]
                for j in _tiles(len(of_c), TILE[1]):
                    cols = of_c[j]
                    heaps.merge(rows, scores(a.x[rows], c.x[cols]), a.ids[rows][:, None] != c.ids[cols], c.ids[cols])
        r, p = np.nonzero(heaps.held)
        return pa.table([a.ids[r], heaps.ids[r, p], heaps.scores[r, p]], names=names)

    return run


def negatives_of(k: int, low: int, high: int):
    """Pass 2 in a cell: for each positive of an anchor the k best rows inside its window."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
        sides = _sides(anchors, candidates)
        if sides is None:
            return pa.table([pa.array([], pa.int64())] * 6, names=names)
        a, c = sides
        there, positive = a.windows[:, :, 0] > 0, a.windows[:, :, 2]
        exact = positive.astype(object)
        least = np.clip(-((-low * exact) // 100), _LEAST, _MOST).astype(np.int64)
        most = np.clip((high * exact) // 100, _LEAST, _MOST).astype(np.int64)
        heaps = [Heaps(len(a.ids), k) for _ in range(there.shape[1])]
        for rows in _tiles(len(a.ids), TILE[0]):
            for cols in _tiles(len(c.ids), TILE[1]):
                found = scores(a.x[rows], c.x[cols])
                other = (a.labels[rows][:, None] != c.labels[cols]) & (a.ids[rows][:, None] != c.ids[cols])
                for w, heap in enumerate(heaps):
                    inside = other & (found >= least[rows, w][:, None]) & (found <= most[rows, w][:, None])
                    heap.merge(rows, found, inside & there[rows, w][:, None], c.ids[cols])
        out = []
        for w, heap in enumerate(heaps):
            r, p = np.nonzero(heap.held)
            out.append((a.ids[r], np.full(len(r), w), a.windows[r, w, 1], positive[r, w], heap.ids[r, p], heap.scores[r, p]))
        return pa.table([np.concatenate([o[j] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for j in range(6)],
                        names=names)

    return run


def _grid(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_groups: int, run, schema: str) -> DataFrame:
    """``run`` over every (anchor block, group of candidates).  A cell is small in bytes and large in
    work, so cells are dealt one to a task, not by their size."""
    tasks = min(n_anchors * n_groups, MAX_TASKS)
    a = anchors.withColumn("a", F.col("part").cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    c = candidates.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    a, c = a.repartition(tasks, "a", "g"), c.repartition(tasks, "a", "g")
    return a.groupBy("a", "g").cogroup(c.groupBy("a", "g")).applyInArrow(run, schema)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH, scale: int = SCALE, group_rows: int = GROUP_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """For each anchor (vec_id, label, embedding) and each of its ``positives`` best rows of the same
    label the ``negatives`` best rows of another label whose score is ``low`` to ``high`` per cent
    of the positive's: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score."""
    if not 0 < positives <= POSITIVES_MAX:
        raise ValueError(f"positives must lie in 1..{POSITIVES_MAX}")
    blocks = materialize(_blocks(vectors.select("vec_id", "label", "embedding", F.lit(None).cast(_WINDOWS).alias("windows")), BLOCK_ROWS,
                                 scale), "candidate-blocks")
    n_groups = max(1, -(-(blocks.agg(F.sum("n").alias("n")).first().n or 0) // group_rows))
    candidates = blocks.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(n_groups)).cast("int"))

    asked = anchors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").groupBy(
        F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("v"))
    asked = asked.select("vec_id", "v.label", "v.embedding")
    n_anchors = max(1, -(-asked.count() // anchor_rows))
    first = materialize(_blocks(asked.repartition(n_anchors).withColumn("windows", F.lit(None).cast(_WINDOWS)), anchor_rows, scale),
                        "anchor-blocks")
    near = _grid(first, candidates, n_anchors, n_groups, positives_of(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    windows = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(  # at most ``positives`` entries
        F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("w"))
    windows = windows.select("vec_id", F.transform("w", lambda e: F.struct(
        e["positive_id"].alias("positive_id"), e["positive_score"].alias("positive_score"))).alias("windows"))
    second = materialize(_blocks(asked.join(windows, "vec_id").repartition(n_anchors), anchor_rows, scale), "anchor-windows")
    found = _grid(second, candidates, n_anchors, n_groups, negatives_of(negatives, low, high),
                  "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return mine(vectors, vectors.filter("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE p.place <= 5 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
