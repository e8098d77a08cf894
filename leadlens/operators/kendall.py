"""Kendall's tau-b without enumerating pairs (A7, method="kendall").

tau_b = S / sqrt((n0 - n1) (n0 - n2)),  S = n0 - n1 - n2 + n3 - 2 nd

n0 = n(n-1)/2; n1, n2, n3 = pairs tied in x, in y, in both (group counts);
nd = discordant pairs = pairs ordered by (x, y) whose y is strictly decreasing
(an inversion count).  nd is counted in two distributed passes:

1. range-partition by (x, y, row hash) into P partitions; inside each partition
   the inversions of the y sequence are counted with a vectorised merge count.
   Pairs in different partitions have x_i <= x_j, with equal x only when
   y_i <= y_j, so they are discordant exactly when y_i > y_j;
2. those cross pairs are #{(i, j): part_i < part_j, y_i > y_j}.  Rows are
   range-partitioned again by (y desc, part, row hash); each partition counts, in
   order, earlier rows with a smaller part, and emits one histogram of its parts.
   Earlier partitions enter through prefix sums over the (partition, part) grid of those
   counts, two distributed windows.  Pairs with equal y and different parts were counted in
   order and are subtracted with a group-count formula.

Hot keys are split by the row hash, every pass is linear-logarithmic per
partition, and nothing proportional to the data or the partitions reaches the driver.  Pair
counts are summed as decimal(38,0): a value held by billions of rows overflows a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

PART_ROWS = 500_000  # rows of all pairs that one task counts, whatever the size of the table


def _pairs_of(n) -> F.Column:
    """n * (n - 1) without overflow."""
    wide = n.cast("decimal(19,0)")
    return (wide * (wide - 1)).cast("decimal(38,0)")


def _square(n) -> F.Column:
    wide = n.cast("decimal(19,0)")
    return (wide * wide).cast("decimal(38,0)")


def count_earlier_smaller(a: np.ndarray) -> int:
    """Total of #{i < j : a_i < a_j} over j, for non-negative integers a
    (bottom-up merge levels, each vectorised with a sort and searchsorted)."""
    n = len(a)
    if n < 2:
        return 0
    a = np.asarray(a, dtype=np.int64)
    k = int(a.max()) + 2
    idx = np.arange(n, dtype=np.int64)
    total = 0
    b = 1
    while b < n:
        blk = idx // (2 * b)
        right = ((idx // b) % 2) == 1
        left_keys = np.sort(blk[~right] * k + a[~right])
        rb = blk[right]
        hi = np.searchsorted(left_keys, rb * k + a[right], side="left")
        lo = np.searchsorted(left_keys, rb * k, side="left")
        total += int((hi - lo).sum())
        b *= 2
    return total


def _dense_rank(values: pd.Series) -> np.ndarray:
    _, inv = np.unique(values.to_numpy(), return_inverse=True)
    return inv.astype(np.int64)


def _segments(keys: np.ndarray):
    """(start, stop) of runs of equal consecutive keys."""
    if len(keys) == 0:
        return []
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    bounds = np.concatenate([[0], cut, [len(keys)]])
    return list(zip(bounds[:-1], bounds[1:]))


def tau_b_pairs(df: DataFrame, pairs: list[tuple[str, str]],
                num_partitions: int | None = None) -> dict[tuple[str, str], float]:
    """tau-b for several column pairs in one pipeline: the pairs are stacked as
    (pair, x, y) rows and every pass partitions by the pair first, so the job
    count does not grow with the number of pairs."""
    spark = df.sparkSession
    cols = sorted({c for p in pairs for c in p})
    base = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    base = materialize(base, "kendall-columns")  # read by every count below
    n_parts = num_partitions or max(shuffle_partitions(spark), -(-base.count() * len(pairs) // PART_ROWS))
    idx = {c: f"c{i}" for i, c in enumerate(cols)}
    stacked = F.explode(F.array(*[
        F.struct(F.lit(j).alias("pair"), F.col(idx[a]).alias("x"), F.col(idx[b]).alias("y"))
        for j, (a, b) in enumerate(pairs)]))
    data = base.select(stacked.alias("r")).select("r.*") \
               .where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    data = data.withColumn("h", F.xxhash64("pair", "x", "y", F.monotonically_increasing_id()))

    # tie counts per pair (complete cases of that pair), exact integer sums;
    # every collect below returns one row per pair
    def tied(*keys):
        rows = data.groupBy("pair", *keys).count().groupBy("pair").agg(F.sum(_pairs_of(F.col("count"))).alias("t")).collect()
        return {r["pair"]: int(r["t"]) // 2 for r in rows}

    tx, ty, txy = tied("x"), tied("y"), tied("x", "y")

    # pass 1: inversions of y inside each (pair, x, y)-range partition
    ranged = data.repartitionByRange(n_parts, "pair", "x", "y", "h") \
                 .sortWithinPartitions("pair", "x", "y", "h")

    def local(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        frames = [b[["pair", "y", "h"]] for b in batches if len(b)]
        if not frames:
            return
        part = pd.concat(frames, ignore_index=True)
        inv = np.zeros(len(part), dtype=np.int64)
        keys = part["pair"].to_numpy()
        for lo, hi in _segments(keys):
            seg = part["y"].iloc[lo:hi]
            inv[hi - 1] = count_earlier_smaller(-_dense_rank(seg) + (hi - lo))
        yield pd.DataFrame({"pair": keys.astype(np.int32), "y": part["y"], "h": part["h"],
                            "part": np.int32(pid), "inv": inv})

    tagged = materialize(ranged.mapInPandas(local, "pair int, y double, h long, part int, inv long"),
                         "kendall")
    local_inv = {r["pair"]: int(r["s"]) for r in tagged.groupBy("pair").agg(F.sum(F.col("inv").cast("decimal(28,0)")).alias("s")).collect()}
    n_rows = {r["pair"]: r["n"] for r in tagged.groupBy("pair").agg(F.count("*").alias("n")).collect()}
    # pairs with equal y in different parts (counted in pass-2 order, not discordant)
    same_y = {r["pair"]: int(r["d"]) // 2 for r in (
        tagged.groupBy("pair", "y", "part").count()
              .groupBy("pair", "y").agg(F.sum("count").alias("t"),
                                        F.sum(_square(F.col("count"))).alias("s2"))
              .groupBy("pair").agg(F.sum(_square(F.col("t")) - F.col("s2")).alias("d"))).collect()}

    # pass 2: per pair, y-descending order, earlier rows with a smaller part
    ranged2 = tagged.repartitionByRange(n_parts, "pair", F.col("y").desc(), "part", "h") \
                    .sortWithinPartitions("pair", F.col("y").desc(), "part", "h")

    def cross(batches):
        from pyspark import TaskContext

        qid = TaskContext.get().partitionId()
        frames = [b[["pair", "part"]] for b in batches if len(b)]
        if not frames:
            return
        part = pd.concat(frames, ignore_index=True)
        keys = part["pair"].to_numpy()
        parts = part["part"].to_numpy().astype(np.int64)
        out = []
        for lo, hi in _segments(keys):
            seg = parts[lo:hi]
            found, n = np.unique(seg, return_counts=True)
            within = count_earlier_smaller(seg)
            out += [(qid, int(keys[lo]), int(p), int(c), within if i == 0 else 0)
                    for i, (p, c) in enumerate(zip(found, n))]
        yield pd.DataFrame(out, columns=["q", "pair", "part", "n", "within"])

    grid = materialize(ranged2.mapInPandas(cross, "q int, pair int, part int, n long, within long"), "kendall-grid")
    # rows of earlier partitions (q' < q) in smaller parts (p' < p), by two prefix sums over the
    # full grid of partitions and parts
    axis = grid.groupBy("pair").agg(F.collect_set("q").alias("qs"), F.collect_set("part").alias("ps"))
    full = axis.select("pair", F.explode("qs").alias("q"), "ps").select("pair", "q", F.explode("ps").alias("part"))
    full = full.join(grid.drop("within"), ["pair", "q", "part"], "left").fillna(0, ["n"])
    before_q = Window.partitionBy("pair", "part").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    before_p = Window.partitionBy("pair", "q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("earlier", F.coalesce(F.sum("n").over(before_q), F.lit(0)))
    full = full.withColumn("smaller", F.coalesce(F.sum("earlier").over(before_p), F.lit(0)))
    wide = "decimal(19,0)"
    across = full.groupBy("pair").agg(F.sum((F.col("n").cast(wide) * F.col("smaller").cast(wide)).cast("decimal(38,0)")).alias("s"))
    inside = grid.groupBy("pair").agg(F.sum(F.col("within").cast("decimal(28,0)")).alias("s"))
    cross_pairs = {r["pair"]: int(r["s"]) for r in across.collect()}  # one row per pair
    for r in inside.collect():
        cross_pairs[r["pair"]] += int(r["s"])

    result = {}
    for j, key in enumerate(pairs):
        nd = local_inv.get(j, 0) + cross_pairs.get(j, 0) - same_y.get(j, 0)
        n = int(n_rows.get(j, 0))
        n0 = n * (n - 1) // 2
        t1, t2, t3 = tx.get(j, 0), ty.get(j, 0), txy.get(j, 0)
        sval = n0 - t1 - t2 + t3 - 2 * nd
        den = (n0 - t1) * (n0 - t2)
        result[key] = float(sval / np.sqrt(float(den))) if den > 0 else float("nan")
    return result


def tau_b(df: DataFrame, x: str, y: str, num_partitions: int | None = None) -> float:
    return tau_b_pairs(df, [(x, y)], num_partitions)[(x, y)]
