"""Gradient-boosted trees grown from histograms (M4, M5, M6): level-wise or leaf-wise, round by round.

Rows are binned once (cut points from ``percentile_approx`` over the training rows) and written as
blocks of one byte per feature and row, with label, weight and margin.  A boosting round makes one
pass over the kept blocks per level of its tree: every task turns margins into gradients, sends the
rows down the unfinished tree and adds up histograms of the leaves asked for; tasks' sums are added
in a tree of stages.  Gradients are whole multiples of a fixed step, so sums are exact and a tree
does not depend on how rows lie in partitions.

* A leaf's histogram is read for the smaller of two siblings only; the other is the parent's minus it.
* Leaves wait in a queue by gain.  ``max_leaves`` takes the best first (leaf-wise growth); without it
  all leaves that gain are split (level-wise).  A pass reads all leaves that the queue may reach
  with what is known, so the tree is that of one-by-one growth in at most ``max_depth`` passes.
* Rounds are warm: a block's margins hold all trees so far; a new tree is added by the next round's
  first pass, and every ``MARGIN_EVERY`` trees the blocks are written.  The validation loss comes with
  that pass too, and growth stops after ``patience`` rounds without a lower one: no tree is ever
  fitted twice.

Row and feature sampling hash (seed, tree), rows by their place in a written block.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, remove_scratch

BLOCK_ROWS = 16_384
MARGIN_EVERY = 10
FAN = 16
STEP_BITS = 36  # |gradient| * step stays below 2^36, so a block's sums are exact in doubles
SUM_BITS = 56   # and all rows' sums below 2^62

_BLOCK = "part long, block long, val boolean, n int, bins binary, y binary, w binary, margin binary"
_NAMES = [f.split(" ")[0] for f in _BLOCK.split(", ")]


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6             # 0 or less: no limit
    max_leaves: int | None = None  # leaf-wise growth up to so many leaves
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    min_gain: float = 1e-6
    subsample: float = 1.0
    colsample: float = 1.0
    max_bins: int = 255
    patience: int | None = None
    seed: int = 42


@dataclass
class GrownTree:
    """Nodes in arrays; node 0 is the root, a leaf has feature -1, x <= threshold goes left."""

    feature: np.ndarray
    cut: np.ndarray        # the bin of ``threshold``
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray      # margin added in a leaf
    gain: np.ndarray
    rows: np.ndarray

    def leaves(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x`` (bins or values, compared with ``cuts``)."""
        node = np.zeros(len(x), np.int32)
        going = np.flatnonzero(self.feature[node] >= 0)
        while len(going):
            at = node[going]
            is_left = x[going, self.feature[at]] <= cuts[at]
            node[going] = np.where(is_left, self.left[at], self.right[at])
            going = going[self.feature[node[going]] >= 0]
        return node

    @property
    def n_leaves(self) -> int:
        return int((self.feature < 0).sum())


@dataclass
class BoostedTrees:
    """A fitted ensemble.  ``transform`` scores like a Spark ML classifier's."""

    base: float
    trees: list[GrownTree]
    n_features: int
    losses: list[float] = field(default_factory=list)  # validation loss with 0, 1, 2, ... trees
    fitted: int = 0                                    # trees grown in all, later ones than the best included

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaves(x, t.threshold)]
        return out

    def transform(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        """Adds ``margin``, ``probability`` (vector of both classes) and ``prediction``."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        n = self.n_features

        @F.arrow_udf("double")
        def margin(x: pa.Array) -> pa.Array:
            return pa.array(self.margins(np.asarray(x.flatten(), float).reshape(len(x), n)))

        p = 1 / (1 + F.exp(-F.col("margin")))
        return df.withColumn("margin", margin(vector_to_array(features_col))).withColumn(
            "probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (F.col("margin") > 0).cast("double"))

    @property
    def featureImportances(self) -> "Importances":  # noqa: N802  the name Spark ML's tree models use
        total = np.zeros(self.n_features)
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return Importances(total / total.sum() if total.sum() > 0 else total)

    def save(self, spark: SparkSession, path: str) -> None:
        """Node table (one row per node) and the other fields."""
        rows = [(i, j, *(getattr(t, c)[j].item() for c in _NODE)) for i, t in enumerate(self.trees) for j in range(len(t.feature))]
        spark.createDataFrame(rows, "tree int, node int, " + ", ".join(f"{c} {k}" for c, k in _NODE.items())).coalesce(1) \
             .write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"base": self.base, "n_features": self.n_features, "losses": self.losses, "fitted": self.fitted, "trees": len(self.trees)}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()  # as large as the model
        trees = [GrownTree(*(part[c].to_numpy() for c in _NODE)) for _, part in nodes.groupby("tree", sort=True)]
        return cls(meta["base"], trees, meta["n_features"], meta["losses"], meta["fitted"])


_NODE = {"feature": "int", "cut": "int", "threshold": "double", "left": "int", "right": "int", "value": "double", "gain": "double",
         "rows": "long"}


class Importances:
    """Numbers with the ``toArray`` of a Spark ML vector."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def toArray(self) -> np.ndarray:  # noqa: N802
        return self.values


# -- binning -------------------------------------------------------------------------------


def bin_cuts(train: DataFrame, n_features: int, max_bins: int) -> list[np.ndarray]:
    """Per feature the ascending cut points: bin b holds values in (cut[b-1], cut[b]], the last bin
    also all above.  One aggregation over the training rows."""
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins must lie in 2..255")
    # as text: thousands of literal columns take the driver many seconds
    share = ", ".join(f"{(i + 1) / max_bins!r}D" for i in range(max_bins))
    row = train.agg(*[F.expr(f"percentile_approx(x[{i}], array({share}), {100 * max_bins})").alias(f"c{i}") for i in range(n_features)]).first()
    return [np.unique(np.array(row[f"c{i}"] if row[f"c{i}"] is not None else [0.0], float)) for i in range(n_features)]


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.minimum(np.searchsorted(c, x[:, i], side="left"), len(c) - 1)
    return out


def _blocks(rows: DataFrame, cuts: list[np.ndarray], base: float) -> DataFrame:
    """Rows (x, y, w, val) as blocks with the starting margin."""
    d = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, d)
            y, w, val = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            for flag in (False, True):
                at = np.flatnonzero(val == flag)
                for lo in range(0, len(at), BLOCK_ROWS):
                    some = at[lo:lo + BLOCK_ROWS]
                    yield _row(part, block, flag, _bins(x[some], cuts), y[some].astype(np.uint8), w[some].astype(float),
                               np.full(len(some), base))
                    block += 1

    return rows.select("x", F.col("y").cast("int"), F.col("w").cast("double"), "val").mapInArrow(run, _BLOCK)


def _row(part: int, block: int, val: bool, bins: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([val]), pa.array([len(y)], pa.int32()),
         *(pa.array([a.tobytes()], pa.binary()) for a in (bins.T, y, w, margin))], names=_NAMES)


def _read(row: tuple, d: int) -> tuple:
    """The arrays of a block; its bins are written feature by feature."""
    part, block, val, n, bins, y, w, margin = row
    return (part, block, val, np.frombuffer(bins, np.uint8).reshape(d, n).T, np.frombuffer(y, np.uint8), np.frombuffer(w, float),
            np.frombuffer(margin, float))


# -- one pass over the blocks --------------------------------------------------------------


def _summed(parts: RDD, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the tasks' (histograms, losses), added by Spark down to ``FAN`` rows."""
    def add(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], a[1] + b[1]

    n = parts.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.mapPartitionsWithIndex(lambda i, rows, n=n: ((i % n, r) for r in rows)).reduceByKey(add, n).values()
    total, loss = np.zeros(shape, np.int64), np.zeros(2, np.int64)
    for sums, lost in parts.collect():  # at most FAN rows
        total += sums
        loss += lost
    return total, loss


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss as whole multiples of 1 / step."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint(w * (p - y) * step), np.rint(w * p * (1 - p) * step)


def _histograms(bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, total: np.ndarray, first: np.ndarray) -> None:
    """Add a block's rows to ``total`` [node, (gradient, hessian, rows), bin of all features]; ``at`` is their
    node.  All sums are whole numbers below 2^53, so no order of adding changes them."""
    order = np.argsort(at, kind="stable")
    at, bins, sums = at[order], bins[order], np.column_stack((g, h, np.ones(len(g))))[order]
    size, widths = len(total), np.diff(first)
    nodes, starts = np.unique(at, return_index=True)
    narrow = np.flatnonzero(widths <= 2)  # indicators: the sums of bin 1, and the rest
    flags = (bins[:, narrow] == 1).astype(float)
    for node, lo, hi in zip(nodes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
        ones = (sums[lo:hi].T @ flags[lo:hi]).astype(np.int64)
        two = widths[narrow] == 2
        total[node][:, first[narrow]] += sums[lo:hi].sum(axis=0).astype(np.int64)[:, None] - ones
        total[node][:, first[narrow[two]] + 1] += ones[:, two]
    for i in np.flatnonzero(widths > 2).tolist():
        width = int(widths[i])
        cell = at * width + bins[:, i]
        for k in range(3):
            weight = None if k == 2 else sums[:, k]
            total[:, k, first[i]:first[i + 1]] += np.bincount(cell, weight, size * width).astype(np.int64).reshape(size, width)


class Table:
    """The binned rows and the passes over them.  Blocks are kept in memory (or on local disk) with the
    margins of all trees so far; every ``MARGIN_EVERY`` trees they are written, which cuts the lineage."""

    def __init__(self, found: DataFrame, cuts: list[np.ndarray], step: float, params: BoostParams):
        self.found, self.cuts, self.step, self.params = found, cuts, step, params
        self.n_blocks = found.count()
        self.first = np.concatenate(([0], np.cumsum([len(c) for c in cuts]))).astype(np.int64)
        self.recent = 0  # trees not yet in the written margins
        self.passes = 0
        self.blocks, self.before = self._kept(), []

    def _kept(self) -> RDD:
        # blocks are few and large: dealt out evenly, whatever the files
        tasks = max(1, min(self.n_blocks, max(self.found.rdd.getNumPartitions(), self.found.sparkSession.sparkContext.defaultParallelism)))
        return self.found.repartition(tasks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

    def histograms(self, tree_number: int, tree: GrownTree, nodes: list[int], with_loss: bool = False):
        """(histograms of ``nodes`` [node, (gradient, hessian, rows), bin of all features], (loss, weight)
        of the validation rows)."""
        d, step, params, first = len(self.cuts), self.step, self.params, self.first
        shape = (len(nodes), 3, int(first[-1]))
        slot = np.full(len(tree.feature), -1, np.int64)
        slot[nodes] = np.arange(len(nodes))

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            total, loss, seen = np.zeros(shape, np.int64), np.zeros(2, np.int64), False
            for row in rows:
                if row[2] and not with_loss:
                    continue
                part, block, val, bins, y, w, margin = _read(row, d)
                seen = True
                if val:
                    sign = np.where(y > 0, -margin, margin)
                    loss += np.array([np.rint(np.logaddexp(0, sign) * w * step).astype(np.int64).sum(),
                                      np.rint(w * step).astype(np.int64).sum()])
                    continue
                at = slot[tree.leaves(bins, tree.cut)]
                keep = at >= 0
                if params.subsample < 1:
                    keep &= np.random.default_rng([params.seed, tree_number, part, block]).random(len(y)) < params.subsample
                keep = np.flatnonzero(keep)
                g, h = gradients(y[keep], w[keep], margin[keep], step)
                _histograms(bins[keep], at[keep], g, h, total, first)
            if seen:
                yield total, loss

        self.passes += 1
        out = _summed(self.blocks.mapPartitions(run), shape)
        for old in self.before:  # the pass has filled the blocks that follow
            old.unpersist()
        self.before = []
        return out

    def add(self, tree: GrownTree) -> None:
        """Append a tree to the margins: the next pass adds it on the way, every ``MARGIN_EVERY``th is written."""
        d = len(self.cuts)

        def run(row: tuple) -> tuple:
            bins, margin = _read(row, d)[3], np.frombuffer(row[7], float)
            return (*row[:7], (margin + tree.value[tree.leaves(bins, tree.cut)]).tobytes())

        self.before.append(self.blocks)
        self.blocks = self.blocks.map(run)
        self.recent += 1
        if self.recent < MARGIN_EVERY:
            self.blocks = self.blocks.persist(StorageLevel.MEMORY_AND_DISK)
            return
        spark = self.found.sparkSession
        before, self.found = self.found, materialize(spark.createDataFrame(self.blocks, _BLOCK, verifySchema=False), "boost-margins")
        remove_scratch(before)
        for old in self.before:
            old.unpersist()
        self.blocks, self.before, self.recent = self._kept(), [], 0

    def close(self) -> None:
        for kept in (*self.before, self.blocks):
            kept.unpersist()
        remove_scratch(self.found)


# -- growing one tree ----------------------------------------------------------------------


def best_split(hist: np.ndarray, first: np.ndarray, allowed: np.ndarray, step: float, params: BoostParams):
    """(gain, feature, bin) of a node's best split, ties to the first feature and bin; None where no
    split gains."""
    if not allowed.any():
        return None
    lo, widths = first[:-1], np.diff(first)
    sums = np.cumsum(hist, axis=1)
    before = np.where(lo > 0, sums[:, np.maximum(lo - 1, 0)], 0)
    whole = np.repeat(sums[:, first[1:] - 1] - before, widths, axis=1)
    left = sums - np.repeat(before, widths, axis=1)
    (gs, hs, _), (gl, hl, nl), (gr, hr, nr) = whole, left, whole - left
    ok = np.repeat(allowed, widths)
    ok[first[1:] - 1] = False  # nothing lies above the last bin
    ok &= (nl >= params.min_rows) & (nr >= params.min_rows) & (nl > 0) & (nr > 0)
    ok &= (hl / step >= params.min_hessian) & (hr / step >= params.min_hessian)
    if not ok.any():
        return None

    def score(a, b):
        return (a / step) ** 2 / (b / step + params.l2)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, score(gl, hl) + score(gr, hr) - score(gs, hs), -np.inf)
    at = int(np.argmax(gain))
    if not gain[at] > params.min_gain:
        return None
    i = int(np.searchsorted(first, at, side="right")) - 1
    return float(gain[at]), i, at - int(first[i])


class Grower:
    """One tree: nodes as they become known, and the queue that decides which of them are split."""

    def __init__(self, table: Table, number: int):
        self.table, self.number, self.params = table, number, table.params
        d, rate = len(table.cuts), self.params.colsample
        self.allowed = np.ones(d, bool)
        if rate < 1:
            picked = np.random.default_rng([self.params.seed, number]).permutation(d)[:max(1, round(rate * d))]
            self.allowed = np.isin(np.arange(d), picked)
        self.hist: dict[int, np.ndarray] = {}
        self.split: dict[int, tuple] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.depth, self.sums = [0], [None]

    def _learn(self, node: int, hist: np.ndarray) -> None:
        lo, hi = self.table.first[0], self.table.first[1]
        self.sums[node] = hist[:, lo:hi].sum(axis=1)
        found = best_split(hist, self.table.first, self.allowed, self.table.step, self.params)
        if found:
            self.split[node], self.hist[node] = found, hist

    def _chosen(self) -> list[int]:
        """The nodes that are split, best gain first, as far as gains are known."""
        left = (self.params.max_leaves or 1 << 62) - 1
        queue = [(-self.split[0][0], 0)] if 0 in self.split else []
        out = []
        while queue and left > 0:
            _, node = heapq.heappop(queue)
            out.append(node)
            left -= 1
            for child in self.children.get(node, ()):
                if child in self.split:
                    heapq.heappush(queue, (-self.split[child][0], child))
        return out

    def _tree(self, chosen: list[int]) -> tuple[GrownTree, dict[int, int]]:
        """The tree whose inner nodes are ``chosen``, and the numbers of its nodes."""
        inner = {n for n in chosen if n in self.children}
        number, order = {0: 0}, [0]
        for node in order:
            if node in inner:
                for child in self.children[node]:
                    number[child] = len(order)
                    order.append(child)
        n, table, rate = len(order), self.table, self.params.learning_rate
        out = GrownTree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.full(n, -1, np.int32), np.full(n, -1, np.int32),
                        np.zeros(n), np.zeros(n), np.zeros(n, np.int64))
        for i, node in enumerate(order):
            if self.sums[node] is not None:
                g, h, rows = self.sums[node].tolist()
                out.rows[i] = rows
                denominator = h / table.step + self.params.l2
                out.value[i] = -rate * (g / table.step) / denominator if denominator > 0 else 0.0
            if node in inner:
                gain, feature, cut = self.split[node]
                out.feature[i], out.cut[i], out.threshold[i], out.gain[i] = feature, cut, table.cuts[feature][cut], gain
                out.left[i], out.right[i] = (number[c] for c in self.children[node])
        return out, number

    def grow(self, root: np.ndarray) -> GrownTree:
        self._learn(0, root)
        first = self.table.first
        while True:
            chosen = self._chosen()
            new = [n for n in chosen if n not in self.children]
            if not new:
                return self._tree(chosen)[0]
            small: dict[int, tuple[int, int]] = {}  # smaller child: (parent, its sibling)
            for node in new:
                _, feature, cut = self.split[node]
                hist = self.hist[node]
                left = hist[:, first[feature]:first[feature] + cut + 1].sum(axis=1)
                pair = len(self.depth), len(self.depth) + 1
                self.children[node] = pair
                self.depth += [self.depth[node] + 1] * 2
                self.sums += [left, self.sums[node] - left]
                if self.params.max_depth > 0 and self.depth[pair[0]] >= self.params.max_depth:
                    continue
                one, other = pair if self.sums[pair[0]][2] <= self.sums[pair[1]][2] else pair[::-1]
                small[one] = (node, other)
            if not small:
                continue
            shape, number = self._tree([n for n in self.children])
            hists, _ = self.table.histograms(self.number, shape, [number[n] for n in small])
            for hist, (one, (parent, other)) in zip(hists, small.items()):
                self._learn(one, hist)
                self._learn(other, self.hist[parent] - hist)
            for node in new:
                del self.hist[node]


def fit(train: DataFrame, val: DataFrame | None, params: BoostParams, features_col: str = "features", label: str = "label",
        weight: str = "weight") -> BoostedTrees:
    """Boosted trees for a 0/1 label; ``val`` rows only tell when to stop and which round is best."""
    from pyspark.ml.functions import vector_to_array

    def rows(df: DataFrame, flag: bool) -> DataFrame:
        return df.select(vector_to_array(features_col).alias("x"), F.col(label).cast("double").alias("y"),
                         F.col(weight).cast("double").alias("w"), F.lit(flag).alias("val"))

    t = rows(train, False)
    head = t.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"), F.max("w").alias("top"), F.max(F.size("x")).alias("d"),
                 F.count(F.lit(1)).alias("n")).first()
    if not head.w:
        raise ValueError("no training rows with weight")
    share = min(max(head.p / head.w, 1e-9), 1 - 1e-9)
    base = float(np.log(share / (1 - share)))
    cuts = bin_cuts(t, head.d, params.max_bins)
    both = t if val is None else t.unionByName(rows(val, True))
    step = 2.0 ** min(STEP_BITS, SUM_BITS - head.n.bit_length()) / head.top
    table = Table(materialize(_blocks(both, cuts, base), "boost-blocks"), cuts, step, params)
    has_val = val is not None and not table.found.filter("val").limit(1).isEmpty()
    trees: list[GrownTree] = []
    losses: list[float] = []
    stump = GrownTree(*(np.zeros(1, t) for t in (np.int32, np.int32, float, np.int32, np.int32, float, float, np.int64)))
    stump.feature[0] = -1
    while True:
        hist, loss = table.histograms(len(trees), stump, [0], with_loss=has_val)
        if has_val:
            losses.append(float(loss[0] / loss[1]))
            best = int(np.argmin(losses))
            if params.patience is not None and len(trees) - best >= params.patience:
                break
        if len(trees) >= params.rounds:
            break
        tree = Grower(table, len(trees)).grow(hist[0])
        if tree.n_leaves == 1:
            break  # nothing gains any more
        trees.append(tree)
        table.add(tree)
    table.close()
    keep = len(trees) if not has_val or params.patience is None else max(1, int(np.argmin(losses)))
    return BoostedTrees(base, trees[:keep], head.d, losses, len(trees))


def params_of(config: dict, leaf_wise: bool, seed: int) -> BoostParams:
    """The settings' names of the two boosted configurations.  The leaf-wise learner samples rows
    only with a ``subsample_freq``, and keeps 20 rows a leaf and no L2 term unless told otherwise, as
    its original does."""
    given = {"rounds": int(config.get("n_estimators", 100)), "learning_rate": float(config.get("learning_rate", 0.1)),
             "max_depth": int(config.get("max_depth", -1 if leaf_wise else 6)), "patience": config.get("early_stopping_rounds"),
             "colsample": float(config.get("colsample_bytree", 1.0)), "seed": seed}
    if leaf_wise:
        sampled = float(config.get("subsample", 1.0)) if config.get("subsample_freq", 0) else 1.0
        return BoostParams(**given, max_leaves=int(config.get("num_leaves", 31)), subsample=sampled, l2=float(config.get("reg_lambda", 0.0)),
                           min_rows=int(config.get("min_child_samples", 20)), min_hessian=float(config.get("min_child_weight", 1e-3)))
    return BoostParams(**given, subsample=float(config.get("subsample", 1.0)), l2=float(config.get("reg_lambda", 1.0)),
                       min_hessian=float(config.get("min_child_weight", 1.0)))

