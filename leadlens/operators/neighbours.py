"""Exact k nearest neighbours of rows with nominal columns, without all-pairs work.

One-hot columns contribute whole numbers to a squared distance: rows that differ in m nominal
columns lie at least ``unit * m`` apart (unit 2, or 1 where a row has no category of a column).  So
rows are indexed by their *tuple* of categories and tuples are visited in order of m:

* round 0: a row's own tuple.  Rows of a tuple are sorted by their projection on the numeric
  part's principal direction and cut into blocks; ``CELL_BLOCKS`` blocks in a row are a piece, whose
  rows meet where the blocks are made.  Then a block meets those of other pieces, by doubling offsets,
  only as far as the k-th distance so far still reaches;
* rounds 1 and 2: tuples that differ in exactly m columns, found by equality of the tuple with those
  columns left out; only rows whose k-th distance reaches ``unit * m`` ask, and no other row of their
  blocks travels;
* last, the few rows whose k-th distance reaches further meet all rows in their reach in projection
  order, again by doubling offsets.

Every join is an equality join on a key of bounded groups: a key with many rows is cut into pieces
of about ``CELL_ROWS`` rows.  The lists of rows that ask no more are written round by round; tables
and shuffles of a round are let go before the next.  The result counts the pairs whose distance was
computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import free_shuffles, materialize, remove_scratch
from .ordered import ordered_scan
from .smote import exact_knn, principal_direction

BLOCK_ROWS = 512
FAR_ROWS = 2048
CELL_ROWS = 4096
CELL_BLOCKS = 8
REACH_BUCKETS = 256
WILD = 2        # rounds by equal tuples with columns left out
_TOL = 1e-9     # relative rounding of squared distances

_BLOCK = "grp string, no long, n int, low double, high double, codes binary, ids binary, s binary, z binary"
_DATA = ("codes", "ids", "s", "z")
_BEST = "uid long, d binary, c binary, visited long"


class Shape:
    """How a vector splits into nominal columns and numeric positions."""

    def __init__(self, dims: int, nominal: Sequence[Sequence[int]]):
        self.nominal = [list(g) for g in nominal]
        inside = {i for g in nominal for i in g}
        self.numeric = [i for i in range(dims) if i not in inside]
        self.dims = dims

    def vectors(self, codes: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Full vectors from category numbers (0: none) and numeric parts."""
        out = np.zeros((len(codes), self.dims))
        out[:, self.numeric] = z
        for g, positions in enumerate(self.nominal):
            has = np.flatnonzero(codes[:, g] > 0)
            out[has, np.array(positions)[codes[has, g] - 1]] = 1.0
        return out


def _slots(rows: int) -> int:
    """Groups of about ``CELL_ROWS`` rows: small tuples and cells share a group, which is one call."""
    return max(1, -(-int(rows) // CELL_ROWS))


def _pack(rows: DataFrame, n: int, search: tuple[Shape, int, int] | None = None) -> DataFrame:
    """One row per block (grp, no) of (id, codes, s, z); with ``search`` (shape, k, unit) also the k best
    of each of its rows among the rows of its piece."""
    def run(part: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, sort_keys=[("grp", "ascending"), ("no", "ascending"), ("id", "ascending")]))
        n = part.num_rows
        names, no = part["grp"].to_pylist(), np.asarray(part["no"])
        new = [i for i in range(n) if i == 0 or no[i] != no[i - 1] or names[i] != names[i - 1]]
        ids, s = np.asarray(part["id"]).astype("<i8"), np.asarray(part["s"], float)
        codes = np.asarray(part["codes"].combine_chunks().flatten()).reshape(n, -1).astype("<i4")
        z = np.asarray(part["z"].combine_chunks().flatten(), float).reshape(n, -1)
        spans = list(zip(new, [*new[1:], n]))

        def blobs(x):
            return pa.array([np.ascontiguousarray(x[a:b]).tobytes() for a, b in spans], pa.binary())

        out = {"grp": pa.array([names[a] for a, _ in spans]), "no": pa.array([int(no[a]) for a, _ in spans], pa.int64()),
               "n": pa.array([b - a for a, b in spans], pa.int32()), "low": pa.array([float(s[a:b].min()) for a, b in spans]),
               "high": pa.array([float(s[a:b].max()) for a, b in spans]), "codes": blobs(codes), "ids": blobs(ids), "s": blobs(s),
               "z": blobs(z)}
        if search:
            shape, k, unit = search
            d, c, visited = np.full((n, k), np.inf), np.full((n, k), -1, "<i8"), []
            pieces: dict[tuple, list[tuple]] = {}
            for a, b in spans:
                pieces.setdefault((names[a], no[a] // CELL_BLOCKS), []).append((a, b))
            for blocks in pieces.values():
                first, last = blocks[0][0], blocks[-1][1]
                rows = Rows(shape, ids[first:last], s[first:last], codes[first:last], z[first:last])
                for a, b in blocks:
                    own = rows.some(slice(a - first, b - first))
                    seen = nearest(own, own, d[a:b], c[a:b], k, 0, 0, unit)
                    if len(blocks) > 1:
                        others = rows.some(np.r_[0:a - first, b - first:last - first])
                        seen += nearest(own, others, d[a:b], c[a:b], k, 0, 0, unit)
                    d[a:b], c[a:b] = _once([d[a:b]], [c[a:b]], k)
                    visited.append(seen)
            out |= {"d": blobs(d), "c": blobs(c), "visited": pa.array(visited, pa.int64())}
        return pa.table(out)

    slot = F.pmod(F.xxhash64("grp", F.floor(F.col("no") / CELL_BLOCKS) if search else F.col("no")), F.lit(_slots(n)))
    return rows.withColumn("slot", slot).groupBy("slot").applyInArrow(
        lambda part: run(part.drop_columns(["slot"])), _BLOCK + (", d binary, c binary, visited long" if search else ""))


class Rows:
    """Ids, projections, categories and full vectors of some rows."""

    def __init__(self, shape: Shape, ids: np.ndarray, s: np.ndarray, codes: np.ndarray, z: np.ndarray):
        self.ids, self.s, self.codes, self.v = ids, s, codes, shape.vectors(codes, z)

    @classmethod
    def of(cls, shape: Shape, blocks: list[dict]) -> "Rows":
        """Blocks above each other."""
        def all_of(name, kind):
            return np.concatenate([np.frombuffer(b[name], kind) for b in blocks])

        ids = all_of("ids", "<i8")
        n = len(ids)
        return cls(shape, ids, all_of("s", float), all_of("codes", "<i4").reshape(n, len(shape.nominal)),
                   all_of("z", float).reshape(n, len(shape.numeric)))

    def some(self, at) -> "Rows":
        out = object.__new__(Rows)
        out.ids, out.s, out.codes, out.v = self.ids[at], self.s[at], self.codes[at], self.v[at]
        return out


def _theta(best: np.ndarray, k: int) -> np.ndarray:
    """Squared k-th distance of every row so far."""
    return np.square(best[:, k - 1])


def nearest(q: Rows, c: Rows, d: np.ndarray, found: np.ndarray, k: int, least: int, most: int, unit: int) -> int:
    """Improve the k best (distances ``d``, ids ``found``; both rows x k, in place) of the rows of ``q`` by
    rows of ``c`` that differ in ``least`` to ``most`` nominal columns.  Returns the pairs looked at."""
    visited = 0
    start = _theta(d, k)
    asking = np.flatnonzero(start * (1 + _TOL) + _TOL >= unit * least)  # others are near enough already
    asking = asking[np.argsort(q.s[asking], kind="stable")]
    line = np.argsort(c.s, kind="stable")
    along, cn_all = c.s[line], (c.v * c.v).sum(1)
    for lo in range(0, len(asking), 256):
        at = asking[lo:lo + 256]
        theta = start[at]  # every row is asked once
        slack = _TOL * (1 + np.where(np.isfinite(theta), theta, 0))
        reach = np.sqrt(np.maximum(theta + slack - unit * least, 0)).max() * (1 + _TOL) + _TOL
        some = line[np.searchsorted(along, q.s[at[0]] - reach):np.searchsorted(along, q.s[at[-1]] + reach, side="right")]
        if not len(some):
            continue
        ids, codes, v, cn = c.ids[some], c.codes[some], c.v[some], cn_all[some]
        gap = q.s[at][:, None] - c.s[some][None]
        differ = np.zeros(gap.shape, np.int16)
        for g in range(q.codes.shape[1]):
            differ += q.codes[at, g][:, None] != codes[:, g]
        use = (differ >= least) & (differ <= most) & (gap * gap + unit * differ <= (theta + slack)[:, None])
        use &= q.ids[at][:, None] != ids
        visited += int(use.sum())
        if not use.any():
            continue
        qn = (q.v[at] * q.v[at]).sum(1)
        rough = np.where(use, qn[:, None] + cn - 2 * (q.v[at] @ v.T), np.inf)
        bound = theta
        if rough.shape[1] > k:
            bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
        near = use & (rough <= (bound + 1e-9 * (1 + qn + cn.max()))[:, None])
        r, j = np.nonzero(near)
        if not len(r):
            continue
        exact = np.sqrt(((q.v[at[r]] - v[j]) ** 2).sum(-1))
        held = np.nonzero(np.isfinite(d[at]))
        row = np.concatenate((r, held[0]))
        dist = np.concatenate((exact, d[at][held]))
        ident = np.concatenate((ids[j], found[at][held]))
        order = np.lexsort((ident, dist, row))
        row, dist, ident = row[order], dist[order], ident[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        stay = place < k
        d[at[row[stay]], place[stay]] = dist[stay]
        found[at[row[stay]], place[stay]] = ident[stay]
    return visited


def _once(d: list[np.ndarray], c: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best per row of lists beside each other."""
    dist, ident = np.hstack(d), np.hstack(c)
    order = np.lexsort((ident, dist), axis=1)
    dist, ident = np.take_along_axis(dist, order, 1), np.take_along_axis(ident, order, 1)
    # a pair that two lists share counts once (infinite entries may repeat)
    again = np.zeros(dist.shape, bool)
    again[:, 1:] = (ident[:, 1:] == ident[:, :-1]) & np.isfinite(dist[:, 1:]) & (ident[:, 1:] != _MOST)
    dist = np.where(again, np.inf, dist)
    order = np.lexsort((ident, dist), axis=1)[:, :k]
    return np.take_along_axis(dist, order, 1), np.take_along_axis(ident, order, 1)


def _merge(parts: DataFrame, k: int, slots: int) -> DataFrame:
    """The k best per row of each block from several candidates' lists of the block."""
    def run(part: pa.Table) -> pa.Table:
        by_uid: dict[int, list[dict]] = {}
        for r in part.select(["uid", "d", "c", "visited"]).to_pylist():
            by_uid.setdefault(r["uid"], []).append(r)
        out: dict[str, list] = {"uid": [], "d": [], "c": [], "visited": []}
        for uid, rows in by_uid.items():
            d = [np.frombuffer(r["d"], float).reshape(-1, k) for r in rows]
            c = [np.frombuffer(r["c"], "<i8").reshape(-1, k) for r in rows]
            dist, ident = _once(d, c, k) if len(rows) > 1 else (d[0], c[0])
            for name, value in zip(out, (uid, dist.tobytes(), ident.tobytes(), sum(r["visited"] for r in rows))):
                out[name].append(value)
        return _best_table(out)

    return parts.withColumn("slot", F.pmod("uid", F.lit(slots))).groupBy("slot").applyInArrow(run, _BEST)


def _best_table(out: dict[str, list]) -> pa.Table:
    return pa.table({"uid": pa.array(out["uid"], pa.int64()), "d": pa.array(out["d"], pa.binary()),
                     "c": pa.array(out["c"], pa.binary()), "visited": pa.array(out["visited"], pa.int64())})


def _cells(shape: Shape, k: int, least: int, most: int, unit: int, left_key: list[str], right_key: list[str]):
    """The query blocks (with their best so far) of every cell in a group against its candidate
    blocks; a list per query block and cell."""
    def by_key(side: pa.Table, key: list[str]) -> dict[tuple, list[dict]]:
        cells: dict[tuple, list[dict]] = {}
        for r in side.to_pylist():
            cells.setdefault(tuple(r[c] for c in key), []).append(r)
        return cells

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"uid": [], "d": [], "c": [], "visited": []}
        candidates = by_key(right, right_key)
        for key, asked in by_key(left, left_key).items():
            if key not in candidates:
                continue
            q, c = Rows.of(shape, asked), Rows.of(shape, candidates[key])
            d = np.concatenate([np.frombuffer(b["d"], float).reshape(-1, k) for b in asked])
            found = np.concatenate([np.frombuffer(b["c"], "<i8").reshape(-1, k) for b in asked])
            visited = nearest(q, c, d, found, k, least, most, unit)
            at = 0
            for b in asked:
                rows = len(b["d"]) // (8 * k)
                for name, value in zip(out, (b["uid"], d[at:at + rows].tobytes(), found[at:at + rows].tobytes(), visited)):
                    out[name].append(value)
                visited, at = 0, at + rows
        return _best_table(out)

    return run


def _reach(best: DataFrame, k: int, beyond: int) -> DataFrame:
    """(uid, reach) per block: how far projections of its rows may lie apart for a squared distance
    that still counts when ``beyond`` of it is spent; blocks without such a row are left out."""
    def run(batches):
        for batch in batches:
            uid, reach = [], []
            for u, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left = float((_theta(np.frombuffer(blob, float).reshape(-1, k), k) * (1 + _TOL) + _TOL).max()) - beyond
                if left >= 0:
                    uid.append(u)
                    reach.append(left ** 0.5)
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(reach, pa.float64())], names=["uid", "reach"])

    return best.select("uid", "d").mapInArrow(run, "uid long, reach double")


def _offsets(step: int) -> list[int]:
    if step == 0:
        return [-1, 0, 1]
    return [o for a in range(2 ** step, 2 ** (step + 1)) for o in (-a, a)]


def _along(blocks: DataFrame, best: DataFrame, shape: Shape, k: int, least: int, most: int, unit: int, slots: int,
           asked: DataFrame | None = None) -> DataFrame:
    """Blocks of ``asked`` (all, whose pieces have met) against the blocks of the same ``grp`` in reach along
    the projection, by doubling offsets; returns the improved best lists."""
    met = F.lit(False)
    if asked is None:
        asked, met = blocks, F.floor(F.col("no") / CELL_BLOCKS) == F.floor(F.col("cno") / CELL_BLOCKS)
    start = best
    ranges = blocks.select(F.col("grp").alias("cgrp"), F.col("no").alias("cno"), F.col("low").alias("clow"), F.col("high").alias("chigh"),
                           F.col("n").alias("cn"))
    # columns of their own, so that both sides of a cell can come from one table
    others = blocks.select(F.col("grp").alias("cgrp"), F.col("no").alias("cno"), *[F.col(c).alias(c) for c in _DATA])
    step, going = 0, None
    while True:
        reach = _reach(best, k, unit * least)
        q = asked.select("uid", "grp", "no", "low", "high").join(reach, "uid")
        if going is not None:
            q = q.join(going.select("uid").distinct(), "uid", "left_semi")
        pairs = q.withColumn("off", F.explode(F.array(*[F.lit(o) for o in _offsets(step)]))).withColumn("cno", F.col("no") + F.col("off"))
        pairs = pairs.join(ranges, (F.col("grp") == F.col("cgrp")) & (pairs["cno"] == ranges["cno"])).drop(ranges["cno"])
        pairs = pairs.where((F.col("clow") <= F.col("high") + F.col("reach")) & (F.col("chigh") >= F.col("low") - F.col("reach")))
        pairs = materialize(pairs.select("uid", "cgrp", "cno", F.floor(F.col("off") / CELL_BLOCKS).alias("part"), "cn", met.alias("met")), "knn-pairs")
        total, fresh = pairs.agg(F.sum("cn"), F.sum(F.when(~F.col("met"), F.col("cn")))).first()
        if going is not None:
            remove_scratch(going)
        if total is None:
            remove_scratch(pairs)
            return best
        going = pairs
        step += 1
        if fresh is None:
            continue
        pairs = pairs.where("NOT met").drop("met")
        groups = F.lit(_slots(fresh))
        cells = pairs.select("uid", "part").distinct()
        left = asked.select("uid", *_DATA).join(best.select("uid", "d", "c"), "uid").join(cells, "uid").withColumn(
            "slot", F.pmod(F.xxhash64("uid", "part"), groups))
        right = pairs.withColumnRenamed("uid", "quid").withColumnRenamed("part", "qpart").join(others, ["cgrp", "cno"]).withColumn(
            "qslot", F.pmod(F.xxhash64("quid", "qpart"), groups))
        new = left.groupBy("slot").cogroup(right.groupBy("qslot")).applyInArrow(
            _cells(shape, k, least, most, unit, ["uid", "part"], ["quid", "qpart"]), _BEST)
        before, best = best, materialize(_merge(best.unionByName(new), k, slots), "knn-best")
        if before is not start:
            remove_scratch(before)
        free_shuffles(best.sparkSession)


def _open(state: DataFrame, k: int, beyond: int) -> DataFrame:
    """The rows of blocks with their lists (``state``) whose squared k-th distance reaches ``beyond``, as blocks
    of these rows alone."""
    kinds = {"ids": "<i8", "s": float, "codes": "<i4", "z": float, "d": float, "c": "<i8"}

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in ("uid", "grp", "n", *kinds, "visited")}
            for r in batch.to_pylist():
                ask = np.flatnonzero(_asks(np.frombuffer(r["d"], float).reshape(-1, k), k, beyond))
                if not len(ask):
                    continue
                n = len(r["ids"]) // 8
                for name in ("uid", "grp"):
                    out[name].append(r[name])
                out["n"].append(len(ask))
                out["visited"].append(0)
                for name, kind in kinds.items():
                    x = np.frombuffer(r[name], kind)
                    out[name].append(np.ascontiguousarray(x.reshape(n, len(x) // n)[ask]).tobytes())
            types = {"uid": pa.int64(), "grp": pa.string(), "n": pa.int32(), "visited": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(f, pa.binary())) for f, v in out.items()], names=list(out))

    names = ["uid", "grp", *kinds]
    return state.select(*names).mapInArrow(run, "uid long, grp string, n int, " + ", ".join(f"{f} binary" for f in kinds) + ", visited long")


def _asks(d: np.ndarray, k: int, beyond: int) -> np.ndarray:
    return _theta(d, k) * (1 + _TOL) + _TOL >= beyond


def _wild(blocks: DataFrame, asked: DataFrame, shape: Shape, k: int, m: int, unit: int, slots: int) -> DataFrame:
    """The rows of ``asked``, as blocks, against blocks whose tuples differ in exactly ``m`` columns; returns
    the improved best lists of ``asked``."""
    n_columns = len(shape.nominal)
    parts = F.split("grp", ",")
    keys = F.array(*[F.concat_ws(",", F.lit(str(i)), *[F.lit("*") if g in left_out else parts[g] for g in range(n_columns)])
                     for i, left_out in enumerate(combinations(range(n_columns), m))])
    q = asked.select("uid", "n", F.explode(keys).alias("key"))
    open_keys = q.groupBy("key").agg(F.sum("n").alias("qn"))
    c = blocks.select("uid", "n", F.explode(keys).alias("ckey")).join(open_keys, F.col("ckey") == F.col("key"), "left_semi")
    sizes = materialize(c.groupBy("ckey").agg(F.sum("n").alias("cn")).join(open_keys, F.col("ckey") == F.col("key")).select(
        "ckey", "cn", F.ceil(F.col("cn") / CELL_ROWS).cast("int").alias("cp"), F.ceil(F.col("qn") / CELL_ROWS).cast("int").alias("qp")), "knn-keys")
    groups = F.lit(_slots(sizes.agg(F.sum(F.col("cn") * F.col("qp"))).first()[0] or 0))
    sizes = sizes.drop("cn")
    q = q.join(sizes.withColumnRenamed("ckey", "key"), "key").withColumn("a", F.pmod(F.xxhash64("uid"), F.col("qp")).cast("int")) \
         .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("cp") - 1)))
    c = c.join(sizes, "ckey").withColumn("cb", F.pmod(F.xxhash64("uid"), F.col("cp")).cast("int")) \
         .withColumn("ca", F.explode(F.sequence(F.lit(0), F.col("qp") - 1)))
    mine = blocks.select(F.col("uid").alias("cuid"), *[F.col(c).alias(c) for c in _DATA])
    left = q.select("uid", "key", "a", "b").join(asked.select("uid", *_DATA, "d", "c"), "uid")
    right = c.select(F.col("uid").alias("cuid"), "ckey", "ca", "cb").join(mine, "cuid")
    left = left.withColumn("slot", F.pmod(F.xxhash64("key", "a", "b"), groups))
    right = right.withColumn("cslot", F.pmod(F.xxhash64("ckey", "ca", "cb"), groups))
    new = left.groupBy("slot").cogroup(right.groupBy("cslot")).applyInArrow(
        _cells(shape, k, m, m, unit, ["key", "a", "b"], ["ckey", "ca", "cb"]), _BEST)
    best = materialize(_merge(asked.select("uid", "d", "c", "visited").unionByName(new), k, slots), "knn-best")
    remove_scratch(sizes)
    return best


def _lists(state: DataFrame, k: int, below: int | None = None) -> DataFrame:
    """(id, nb_rank, nb_id, distance) from blocks with their best lists; with ``below`` only of rows whose
    squared k-th distance does not reach it."""
    def run(batches):
        for batch in batches:
            for ids, d, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(ids, "<i8")
                d, c = np.frombuffer(d, float).reshape(-1, k), np.frombuffer(c, "<i8").reshape(-1, k)
                given = np.isfinite(d)
                if below is not None:
                    given &= ~_asks(d, k, below)[:, None]
                r, p = np.nonzero(given)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array((p + 1).astype(np.int32)), pa.array(c[r, p]), pa.array(d[r, p])],
                                                 names=["id", "nb_rank", "nb_id", "distance"])

    return state.select("ids", "d", "c").mapInArrow(run, "id long, nb_rank int, nb_id long, distance double")


def _with_best(blocks: DataFrame, best: DataFrame) -> DataFrame:
    return blocks.drop("d", "c", "visited").join(best.select("uid", "d", "c"), "uid")


def nominal_knn(df: DataFrame, id_col: str, vec: str, k: int, nominal: Sequence[Sequence[int]],
                block_rows: int | None = None) -> tuple[DataFrame, int]:
    """((id, nb_rank, nb_id, distance): the k nearest other rows of every row, ties to the smaller
    id; the number of pairs whose distance was computed).  ``nominal`` lists the positions of each
    one-hot column; vectors that are not one-hot there go to :func:`smote.exact_knn`."""
    block_rows = block_rows or BLOCK_ROWS
    spark = df.sparkSession
    pts = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    sums = [F.aggregate(F.array(*[F.col("v")[i] for i in g]), F.lit(0.0), lambda a, x: a + x) for g in nominal]
    flags = F.array(*[F.col("v")[i] for g in nominal for i in g]) if nominal else F.array().cast("array<double>")
    head = pts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"),
                   F.min(F.forall(flags, lambda x: x.isin(0.0, 1.0))).alias("zero_one"),
                   *[F.min(s).alias(f"lo{i}") for i, s in enumerate(sums)], *[F.max(s).alias(f"hi{i}") for i, s in enumerate(sums)]).first()
    n = head.n
    if n < 2 or not nominal or not head.zero_one or max(head[f"hi{i}"] for i in range(len(nominal))) > 1 \
            or head.dims == sum(map(len, nominal)):
        return exact_knn(df, id_col, vec, k), n * (n - 1)
    unit = 2 if min(head[f"lo{i}"] for i in range(len(nominal))) == 1 else 1
    shape, k = Shape(head.dims, nominal), min(k, n - 1)
    codes = F.array(*[F.array_position(F.array(*[F.col("v")[i] for i in g]), F.lit(1.0)).cast("int") for g in nominal])
    pts = pts.select("id", codes.alias("codes"), F.array(*[F.col("v")[i] for i in shape.numeric]).alias("z"))
    direction = principal_direction(pts, "z")
    s = F.aggregate(F.zip_with("z", F.array(*[F.lit(float(c)) for c in direction]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    pts = pts.withColumn("s", s).withColumn("grp", F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))))
    ranked = ordered_scan(pts, by=["grp"], order=["s", "id"], row_number="rn").withColumn("no", F.floor((F.col("rn") - 1) / block_rows))
    uid = F.xxhash64("grp", "no", "ids")
    packed = _pack(ranked.select("grp", "no", "id", "codes", "s", "z"), n, (shape, k, unit))
    blocks = materialize(packed.withColumn("uid", uid), "knn-blocks")
    free_shuffles(spark)
    first = blocks.select("uid", "d", "c", "visited")
    slots = _slots(n)
    best = _along(blocks, first, shape, k, 0, 0, unit, slots)
    visited = best.agg(F.sum("visited")).first()[0]
    state, used = blocks, []
    if best is not first:
        state = materialize(_with_best(blocks, best), "knn-state")
        used += [best, state]
    lists = []
    for m in range(1, min(WILD, len(nominal)) + 1):
        lists.append(materialize(_lists(state, k, unit * m), "knn-lists"))
        asked = materialize(_open(state, k, unit * m), "knn-asked")
        if asked.isEmpty():
            remove_scratch(asked)
            state = None
            break
        best = _wild(blocks, asked, shape, k, m, unit, slots)
        visited += best.agg(F.sum("visited")).first()[0]
        state = materialize(_with_best(asked, best), "knn-state")
        remove_scratch(asked)
        remove_scratch(best)
        used.append(state)
        free_shuffles(spark)
    if state is not None:
        more = m + 1 if m < len(nominal) else None
        lists.append(materialize(_lists(state, k, unit * more if more else None), "knn-lists"))
        asked = materialize(_open(state, k, unit * more), "knn-open") if more else None
        if asked is not None and not asked.isEmpty():
            known = materialize(_lists(asked, k), "knn-known")
            found, seen = _far(ranked, asked, shape, k, more, unit, n)
            both = known.select("id", "nb_id", "distance").unionByName(found.select("id", "nb_id", "distance")).distinct()
            w = Window.partitionBy("id").orderBy("distance", "nb_id")
            lists.append(materialize(both.withColumn("nb_rank", F.row_number().over(w).cast("int")).where(F.col("nb_rank") <= k).select(
                "id", "nb_rank", "nb_id", "distance"), "knn-lists"))
            visited += seen
            remove_scratch(known)
            remove_scratch(found)
        if asked is not None:
            remove_scratch(asked)
    for table in (*used, blocks, ranked):
        remove_scratch(table)
    free_shuffles(spark)
    out = lists[0]
    for part in lists[1:]:
        out = out.unionByName(part)
    return out, int(visited)


def _far(ranked: DataFrame, asked: DataFrame, shape: Shape, k: int, m: int, unit: int, n: int):
    """Rows of ``asked``, whose k-th distance still reaches tuples ``m`` or more columns away, against all rows
    in their reach in projection order: (their best lists from there, pairs visited)."""
    def rows(batches):
        for batch in batches:
            for ids, s, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                t = np.frombuffer(d, float).reshape(-1, k)[:, k - 1]
                reach = np.sqrt(np.maximum(t * t * (1 + _TOL) + _TOL - unit * m, 0)) * (1 + _TOL) + _TOL
                s = np.frombuffer(s, float)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8")), pa.array(t), pa.array(s - reach), pa.array(s + reach)],
                                                 names=["id", "t", "low", "high"])

    open_rows = materialize(asked.select("ids", "s", "d").mapInArrow(rows, "id long, t double, low double, high double"), "knn-open")
    everyone = _in_reach(ranked.select("id", "codes", "s", "z"), open_rows)
    line = ordered_scan(everyone, by=[], order=["s", "id"], row_number="rn").withColumn(
        "no", F.floor((F.col("rn") - 1) / FAR_ROWS)).withColumn("grp", F.lit(""))
    uid = F.xxhash64("grp", "no", "ids")
    blocks = materialize(_pack(line.select("grp", "no", "id", "codes", "s", "z"), n).withColumn("uid", uid), "knn-line")
    some = line.join(open_rows.select("id"), "id", "left_semi").select("grp", "no", "id", "codes", "s", "z")
    asked = materialize(_pack(some, n).withColumn("uid", F.xxhash64("no", "ids", F.lit(1))), "knn-asked")
    # start from the distances known: k entries of each row, ids of their own (-1) so that none is found twice
    given = asked.select("uid", F.explode(_ids_of("ids")).alias("id")).join(open_rows.select("id", "t"), "id", "left")

    def start(part: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(part["id"]))
        t = np.array([np.inf if x is None else x for x in part["t"].to_pylist()])[order]
        # entries with id -1 stand for what is known: a new row must be at least as near
        d = np.repeat(t[:, None], k, axis=1)
        return pa.table({"uid": part["uid"].slice(0, 1), "d": pa.array([d.tobytes()], pa.binary()),
                         "c": pa.array([np.full(d.shape, _MOST, "<i8").tobytes()], pa.binary()), "visited": pa.array([0], pa.int64())})

    first = materialize(given.groupBy("uid").applyInArrow(start, _BEST), "knn-best")
    best = _along(blocks, first, shape, k, m, len(shape.nominal), unit, _slots(n), asked)
    found = materialize(_lists(_with_best(asked, best), k).where(F.col("nb_id") != _MOST), "knn-far")
    seen = best.agg(F.sum("visited")).first()[0]
    for table in (*([first] if best is not first else []), best, asked, blocks, line, open_rows):
        remove_scratch(table)
    return found, seen


def _in_reach(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows whose ``s`` lies in a bucket that a span (low, high) touches; buckets by quantiles."""
    cuts = rows.agg(F.percentile_approx("s", [i / REACH_BUCKETS for i in range(1, REACH_BUCKETS)])).first()[0] or []
    cuts = F.array(*[F.lit(float(c)) for c in sorted({c for c in cuts if c == c})]).cast("array<double>")

    def bucket(x):
        return F.size(F.filter(cuts, lambda c: c <= x))

    touched = spans.select(F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))).alias("b")).distinct()
    some = [r.b for r in touched.collect()]  # at most REACH_BUCKETS
    return rows.where(F.coalesce(bucket(F.col("s")).isin(some), F.lit(True)))


_MOST = (1 << 63) - 1


def _ids_of(column: str):
    @F.arrow_udf("array<bigint>")
    def ids(blobs: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b.as_py(), "<i8") for b in blobs], pa.list_(pa.int64()))

    return ids(F.col(column))


def lsh_knn(df: DataFrame, id_col: str, vec: str, k: int, radius: float, tables: int = 24, width: float | None = None,
            seed: int = 42) -> DataFrame:
    """Approximate neighbours (J1): Spark ML's bucketed random projections, pairs within ``radius`` that
    share a bucket in one of ``tables`` hash tables; (id, nb_rank, nb_id, distance) of the k nearest of
    them.  Rows with fewer than k such pairs have fewer neighbours."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    pts = df.select(F.col(id_col).cast("long").alias("id"), array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width or 2 * radius, numHashTables=tables, seed=seed)
    pairs = lsh.fit(pts).approxSimilarityJoin(pts, pts, radius, "distance").where("datasetA.id <> datasetB.id")
    w = Window.partitionBy("id").orderBy("distance", "nb_id")
    return pairs.select(F.col("datasetA.id").alias("id"), F.col("datasetB.id").alias("nb_id"), "distance").withColumn(
        "nb_rank", F.row_number().over(w).cast("int")).where(F.col("nb_rank") <= k).select("id", "nb_rank", "nb_id", "distance")


def knn(df: DataFrame, id_col: str, vec: str, k: int, method: str = "exact", nominal: Sequence[Sequence[int]] | None = None,
        block_size: int = 2048, radius: float | None = None) -> DataFrame:
    """k nearest neighbours: ``exact`` (by the index of nominal tuples where ``nominal`` is given, else by
    blocks along the principal direction) or ``lsh`` (approximate, pairs within ``radius``)."""
    if method == "lsh":
        if radius is None:
            raise ValueError("method 'lsh' needs a radius")
        return lsh_knn(df, id_col, vec, k, radius)
    if method != "exact":
        raise ValueError(f"unknown method {method!r}: exact or lsh")
    return nominal_knn(df, id_col, vec, k, nominal)[0] if nominal else exact_knn(df, id_col, vec, k, block_size)
