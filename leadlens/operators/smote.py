"""SMOTE oversampling with exact k-nearest neighbours.

Exact kNN without a pair list over the whole class:

1. project every minority row on its first principal direction (unit vector u,
   Spark ML ``PCA``), so |u.x - u.z| <= ||x - z||;
2. rank rows by the projection (skew-safe ``ordered_scan``) and cut the ranks
   into blocks of ``block_size`` rows;
3. round 1: every block meets its own and the two adjacent blocks; a row's k-th
   distance there, theta, bounds its true k-th distance from above;
4. round 2: a row can only have a closer neighbour in a block whose projection
   range lies within theta of its own projection, because |u.x - u.z| <=
   ||x - z||.  Blocks in reach of a block's rows are visited, rows out of reach
   skipped, and the k best of both rounds kept -- exact after two rounds.

A block travels as one row of binary matrices and meets at most ``GROUP_BLOCKS``
candidate blocks in one cell, one after the other, with a matrix product per pair and
a running k best per row; a cell returns those within theta, and the final k per row
come from ``row_number() <= k``.  Every round's result is written once to
the shared checkpoint folder, so lineage stays short.  With d features of which most
are indicators, one projection prunes little, so the work stays close to one matrix
product of the minority class with itself.

Where the nominal columns behind the indicators are known, ``neighbours`` indexes them instead.

Synthetic rows follow the usual rule x + u * (neighbour - x) with u in [0, 1);
the number of copies per minority row, the neighbour picked for each copy and u
all come from seeded hashes of (seed, id, copy) -- reproducible, no ``rand()``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ordered import ordered_scan


def principal_direction(df: DataFrame, vec: str) -> list[float]:
    """Unit first principal component of an array<double> column (d numbers)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = df.select(array_to_vector(vec).alias("__v"))
    model = PCA(k=1, inputCol="__v", outputCol="__p").fit(v)
    u = model.pc.toArray()[:, 0]
    norm = float(np.linalg.norm(u))
    return (u / norm).tolist() if norm > 0 else [1.0] + [0.0] * (len(u) - 1)


#: Candidate blocks that meet a block of rows in one cell; round 1 has three.
GROUP_BLOCKS = 8

_BLOCK = "blk long, n int, ids binary, s binary, v binary"


def _matrices(rows: DataFrame) -> DataFrame:
    """One row per block of (id, s, v): its ids, projections and vectors as binary arrays."""
    def run(part: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(part["id"]))
        v = np.asarray(part["v"].combine_chunks().flatten(), float).reshape(part.num_rows, -1)[order]
        return pa.table({"blk": part["blk"].slice(0, 1), "n": pa.array([part.num_rows], pa.int32()),
                         "ids": pa.array([np.asarray(part["id"])[order].astype(np.int64).tobytes()], pa.binary()),
                         "s": pa.array([np.asarray(part["s"], float)[order].tobytes()], pa.binary()),
                         "v": pa.array([v.tobytes()], pa.binary())})

    return rows.groupBy("blk").applyInArrow(run, _BLOCK)


def _load(row: dict):
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["s"], float), np.frombuffer(row["v"], float).reshape(len(ids), -1)


def exact_knn(df: DataFrame, id_col: str, vec: str, k: int, block_size: int = 2048) -> DataFrame:
    """(id, nb_rank, nb_id, distance) -- the k nearest other rows of every row,
    ties broken by neighbour id."""
    spark = df.sparkSession
    pts = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    u = principal_direction(pts, "v")
    proj = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in u]), lambda a, b: a * b),
                       F.lit(0.0), lambda acc, x: acc + x)
    ranked = ordered_scan(pts.withColumn("s", proj), by=[], order=["s", "id"], row_number="rn")
    n = ranked.count()
    need = min(k, n - 1)
    if need <= 0:
        return spark.createDataFrame([], "id long, nb_rank int, nb_id long, distance double")
    blk = ((F.col("rn") - 1) / block_size).cast("long")
    blocks = materialize(_matrices(ranked.select(blk.alias("blk"), "id", "s", "v")), "knn-blocks")
    last = (n - 1) // block_size

    def search(pairs: DataFrame, reach: DataFrame | None) -> DataFrame:
        """k best per row of the blocks ``qblk`` among the rows of the blocks ``cblk`` (qblk, cblk);
        ``reach`` (qblk, theta binary) limits a row to candidates within its theta."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            query = left.slice(0, 1).to_pylist()[0]
            ids, s, v = _load(query)
            theta = np.frombuffer(query["theta"], float) if "theta" in query else np.full(len(ids), np.inf)
            best = [(np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64))]
            for i in range(right.num_rows):
                cid, cs, cv = _load(right.slice(i, 1).to_pylist()[0])
                rows = np.flatnonzero((s - theta <= cs.max()) & (s + theta >= cs.min()))
                if not len(rows):
                    continue
                d, c = _top_k(ids[rows], v[rows], cid, cv, k)
                dist, cand = best.pop()
                wide_d, wide_c = np.full((len(ids), d.shape[1]), np.inf), np.full((len(ids), d.shape[1]), -1, np.int64)
                wide_d[rows], wide_c[rows] = d, c
                dist, cand = np.hstack([dist, wide_d]), np.hstack([cand, wide_c])
                order = np.lexsort((cand, dist), axis=1)[:, :k]
                best.append((np.take_along_axis(dist, order, 1), np.take_along_axis(cand, order, 1)))
            dist, cand = best.pop()
            good = np.isfinite(dist) & (dist <= theta[:, None] * (1 + 1e-9))
            return pa.table({"qid": pa.array(np.repeat(ids, dist.shape[1]).reshape(dist.shape)[good]),
                             "cid": pa.array(cand[good]), "distance": pa.array(dist[good]),
                             "qblk": pa.array(np.full(int(good.sum()), query["blk"], np.int64)),
                             "s": pa.array(np.repeat(s, dist.shape[1]).reshape(dist.shape)[good])})

        asked = blocks.withColumn("qblk", F.col("blk"))
        group = F.lit(0).cast("long")  # round 1: one cell a block
        if reach is not None:
            asked = asked.join(reach, "qblk")
            group = F.floor(F.col("cblk") / GROUP_BLOCKS)
        pairs = pairs.withColumn("cgrp", group)
        cells = pairs.select(F.col("qblk").alias("row"), F.col("cgrp").alias("qgrp")).distinct()
        asked = asked.join(cells, F.col("qblk") == F.col("row")).drop("row")
        others = blocks.select(F.col("blk").alias("cblk"), *[F.col(c).alias(c) for c in ("n", "ids", "s", "v")])
        given = pairs.join(others, "cblk")
        return asked.groupBy("qblk", "qgrp").cogroup(given.groupBy("qblk", "cgrp")).applyInArrow(
            run, "qid long, cid long, distance double, qblk long, s double")

    # round 1: own block and its neighbours -> an upper bound on the k-th distance
    near = blocks.select((F.col("blk") + 0).alias("qblk")).select("qblk", F.explode(F.sequence(F.col("qblk") - 1, F.col("qblk") + 1)).alias("cblk"))
    top1 = materialize(search(near.where((F.col("cblk") >= 0) & (F.col("cblk") <= last)), None), "knn-round1")

    # round 2: every block whose projection range lies within theta of one of the block's rows
    # (|u.x - u.z| <= ||x - z||), minus the blocks already seen -> exact
    bound = top1.groupBy("qblk", "qid", "s").agg(F.max("distance").alias("t"), F.count(F.lit(1)).alias("found"))
    theta = F.when(F.col("found") >= need, F.col("t")).otherwise(F.lit(float("inf")))

    def thetas(part: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(part["qid"]))
        return pa.table({"qblk": part["qblk"].slice(0, 1), "theta": pa.array([np.asarray(part["theta"], float)[order].tobytes()], pa.binary())})

    # a row without any candidate in round 1 would be missing here: it takes an infinite theta
    every = ranked.select(blk.alias("qblk"), F.col("id").alias("qid"), "s").join(
        bound.select("qid", theta.alias("theta")), "qid", "left").fillna(float("inf"), ["theta"])
    every = materialize(every, "knn-theta")
    reach = every.groupBy("qblk").applyInArrow(thetas, "qblk long, theta binary")
    span = every.groupBy("qblk").agg(F.min(F.col("s") - F.col("theta")).alias("low"), F.max(F.col("s") + F.col("theta")).alias("high"),
                                     F.min("s").alias("first"), F.max("s").alias("last"))
    # one row per block on both sides
    span = materialize(span, "knn-span")
    ends = span.select(F.col("qblk").alias("cblk"), F.col("first").alias("cfirst"), F.col("last").alias("clast"))
    in_reach = span.join(ends, (F.col("clast") >= F.col("low")) & (F.col("cfirst") <= F.col("high")) & (F.abs(F.col("qblk") - F.col("cblk")) > 1))
    top2 = search(in_reach.select("qblk", "cblk"), reach)
    both = top1.unionByName(top2)
    rnk = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "cid"))
    final = both.withColumn("nb_rank", rnk).where(F.col("nb_rank") <= k)
    return materialize(final.select(F.col("qid").alias("id"), F.col("nb_rank").cast("int"),
                                    F.col("cid").alias("nb_id"), "distance"), "knn")


def _top_k(qids: np.ndarray, qv_all: np.ndarray, cid: np.ndarray, cv: np.ndarray, k: int, chunk: int = 512):
    """(distances, ids), each rows x min(k, candidates), of the k best candidates of every row, by
    distance, then id; infinite where there is none.

    Squared distances are screened with a matrix product and a shortlist of 2k is re-ranked by
    exact differences (so ties break by id exactly as a direct computation would).  Rows whose
    ties could reach past the shortlist take a path over every tied candidate."""
    cn = (cv * cv).sum(1)
    n_c = len(cid)
    kk, m2 = min(k, n_c), min(2 * k, n_c)
    dist, cand = np.full((len(qids), kk), np.inf), np.full((len(qids), kk), -1, np.int64)
    for lo in range(0, len(qids), chunk):
        qv, ids = qv_all[lo:lo + chunk], qids[lo:lo + chunk]
        qn = (qv * qv).sum(1)
        approx = qn[:, None] + cn[None, :] - 2.0 * (qv @ cv.T)
        approx[ids[:, None] == cid[None, :]] = np.inf  # not its own neighbour
        short = np.argpartition(approx, m2 - 1, axis=1)[:, :m2]
        pa_ = np.take_along_axis(approx, short, 1)
        kth = np.partition(pa_, kk - 1, axis=1)[:, kk - 1]
        tol = 1e-9 * (1.0 + qn + cn.max())
        # a candidate outside the shortlist could tie the k-th one
        spill = (m2 < n_c) & (pa_.max(1) <= kth + tol)
        d = np.sqrt(((qv[:, None, :] - cv[short]) ** 2).sum(-1))
        d[~np.isfinite(pa_)] = np.inf
        order = np.lexsort((cid[short], d), axis=1)[:, :kk]
        dist[lo:lo + chunk] = np.take_along_axis(d, order, 1)
        cand[lo:lo + chunk] = cid[np.take_along_axis(short, order, 1)]
        for r in np.flatnonzero(spill):
            sel = np.flatnonzero(approx[r] <= kth[r] + tol[r])
            sel = sel[np.isfinite(approx[r, sel])]
            dd = np.sqrt(((cv[sel] - qv[r]) ** 2).sum(1))
            o = np.lexsort((cid[sel], dd))[:kk]
            dist[lo + r], cand[lo + r] = np.inf, -1
            dist[lo + r, :len(o)], cand[lo + r, :len(o)] = dd[o], cid[sel][o]
    return dist, cand


def _unit(seed: int, *cols: Column) -> Column:
    """Deterministic uniform number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)).cast("double") / float(1 << 53)


def smote(df: DataFrame, feature_cols: Sequence[str], target: str, id_col: str, k: int = 5,
          seed: int = 42, block_size: int = 2048, nominal: Sequence[Sequence[str]] | None = None,
          method: str = "exact", radius: float | None = None) -> DataFrame:
    """add synthetic minority rows until both classes have the same count.

    ``nominal`` names the one-hot columns of each nominal column, by which neighbours are indexed;
    ``method="lsh"`` takes approximate neighbours within ``radius`` (rows without any get no copies).

    Returns the input rows plus synthetic rows.  ``copy`` is 0 for input rows and counts a
    source row's synthetic rows from 1, so (id, copy) is a key; ``synthetic`` marks them.  A
    synthetic row keeps its source's id and other non-feature columns.
    """
    # one row per class
    counts = {r[target]: r["n"] for r in df.groupBy(target).agg(F.count("*").alias("n")).collect()}
    if len(counts) != 2:
        raise ValueError("SMOTE needs exactly two classes")
    minority = min(counts, key=lambda c: (counts[c], str(c)))
    n_min, n_maj = counts[minority], max(counts.values())
    base = df.withColumn("synthetic", F.lit(False)).withColumn("copy", F.lit(0))
    n_syn = n_maj - n_min
    if n_syn == 0 or n_min < 2:
        return base
    kk = min(k, n_min - 1)
    feats = [F.col(f"`{c}`").cast("double") for c in feature_cols]
    mino = df.where(F.col(target) == minority)
    from .neighbours import knn

    position = {c: i for i, c in enumerate(feature_cols)}
    groups = [[position[c] for c in g] for g in nominal or () if g]
    nn = knn(mino.select(id_col, F.array(*feats).alias("__v")), id_col, "__v", kk, method, groups, block_size, radius)

    # copies per row: n_syn // n_min, plus one for the first n_syn % n_min rows in hash order
    hashed = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.lit(""))
    per, extra = divmod(n_syn, n_min)
    rows = _with_extra(mino.withColumn("__h", hashed), extra)
    copies = F.lit(per) + F.col("__extra")
    rows = rows.where(copies > 0).select("*", F.explode(F.sequence(F.lit(0), copies - 1)).alias("__copy"))
    rows = rows.withColumn("__pick", (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("__copy")),
                                             F.lit(kk)) + 1).cast("int")) \
               .withColumn("__u", _unit(seed + 1, F.col(id_col), F.col("__copy")))
    picked = rows.join(nn.select(F.col("id").alias(id_col), F.col("nb_rank").alias("__pick"), "nb_id"),
                       [id_col, "__pick"])
    nbv = mino.select(F.col(id_col).alias("nb_id"), F.array(*feats).alias("__nv"))
    gen = picked.join(nbv, "nb_id")
    out_cols = []
    for c in df.columns:
        if c in position:
            x = F.col(f"`{c}`").cast("double")
            out_cols.append((x + F.col("__u") * (F.col("__nv")[position[c]] - x)).alias(c))
        else:
            out_cols.append(F.col(f"`{c}`"))
    synthetic = gen.select(*out_cols, F.lit(True).alias("synthetic"), (F.col("__copy") + 1).cast("int").alias("copy"))
    return base.unionByName(synthetic)


def _with_extra(rows: DataFrame, wanted: int) -> DataFrame:
    """``__extra``: 1 for the first ``wanted`` rows in the order of ``__h``, else 0.  The last of them is found
    from counts, so no row is sorted or written."""
    if not wanted:
        return rows.withColumn("__extra", F.lit(0))
    start = F.substring("__h", 1, 4)
    for digits, n in sorted(map(tuple, rows.groupBy(start).count().collect())):  # at most 65,537
        if wanted <= n:
            break
        wanted -= n
    for cut, n in sorted(map(tuple, rows.where(start == digits).groupBy("__h").count().collect())):  # a 65,536th of the ids
        if wanted <= n:
            break
        wanted -= n
    if wanted == n:
        return rows.withColumn("__extra", (F.col("__h") <= cut).cast("int"))
    place = F.row_number().over(Window.partitionBy("__h").orderBy("__h"))  # copies of one id
    some = rows.where(F.col("__h") == cut).withColumn("__extra", (place <= wanted).cast("int"))
    return rows.where(F.col("__h") != cut).withColumn("__extra", (F.col("__h") < cut).cast("int")).unionByName(some)
