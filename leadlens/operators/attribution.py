"""Exact tree attributions (M10-M12 for tree ensembles): path-dependent TreeSHAP.

The fitted trees are read from the model's own saved node table (a Spark ML
write + ``spark.read.parquet``), collected once (bounded by the model size, like
the model itself) and broadcast.  Rows are processed by ``mapInArrow``: the
TreeSHAP recursion walks each tree once per Arrow batch and every path operation
is a numpy operation over all rows of the batch, so the per-row work is
vectorised and the table is never gathered.

Output space: random forests -- the positive-class probability (average of the
trees' leaf class shares); gradient-boosted trees -- the raw margin
(sum of tree weight x leaf value).  In both, base + sum(attributions) equals the
model output for the row.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    left: np.ndarray         # child index or -1
    right: np.ndarray
    feature: np.ndarray      # split feature or -1
    threshold: np.ndarray    # continuous split: x <= threshold goes left
    cats: list               # categorical split: set of left categories, else None
    cover: np.ndarray
    value: np.ndarray        # leaf value in output space
    weight: float


def model_trees(model, scratch: str) -> list[Tree]:
    """Trees of boosted trees, or of a Spark ML RandomForest / GBT classification model."""
    from pyspark.sql import SparkSession

    from .boosting import BoostedTrees

    if isinstance(model, BoostedTrees):
        return [Tree(t.left, t.right, t.feature, t.threshold, [None] * len(t.feature), t.rows.astype(float), t.value, 1.0)
                for t in model.trees]

    session = SparkSession.getActiveSession()
    path = os.path.join(scratch, "model")
    model.write().overwrite().save(path)
    rows = session.read.parquet(os.path.join(path, "data")).select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories").collect()
    is_gbt = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if is_gbt else None
    n_trees = model.getNumTrees if not is_gbt else len(weights)
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    trees = []
    for tid in sorted(by_tree):
        nodes = sorted(by_tree[tid], key=lambda r: r["id"])
        n = len(nodes)
        left = np.full(n, -1)
        right = np.full(n, -1)
        feat = np.full(n, -1)
        thr = np.zeros(n)
        cats: list = [None] * n
        cover = np.zeros(n)
        value = np.zeros(n)
        for r in nodes:
            i = r["id"]
            stats = np.asarray(r["impurityStats"], dtype=float)
            if is_gbt:
                cover[i] = stats[0]               # variance impurity: (count, sum, sum of squares)
                value[i] = r["prediction"]
            else:
                cover[i] = stats.sum()
                value[i] = stats[1] / stats.sum() if stats.sum() > 0 and len(stats) > 1 else 0.0
            if r["leftChild"] >= 0:
                left[i], right[i] = r["leftChild"], r["rightChild"]
                feat[i] = r["featureIndex"]
                if r["numCategories"] is not None and r["numCategories"] > 0:
                    cats[i] = set(r["leftCategoriesOrThreshold"])
                else:
                    thr[i] = r["leftCategoriesOrThreshold"][0]
        w = weights[tid] if is_gbt else 1.0 / n_trees
        trees.append(Tree(left, right, feat, thr, cats, cover, value, float(w)))
    return trees


def expected_value(trees: list[Tree]) -> float:
    """Base value: cover-weighted mean leaf value, summed over weighted trees."""
    base = 0.0
    for t in trees:
        leaves = t.left < 0
        base += t.weight * float((t.cover[leaves] * t.value[leaves]).sum() / t.cover[0])
    return base


def _extend(fi, zf, of, pw, depth, z, o, f):
    fi[depth], zf[depth] = f, z
    of[:, depth] = o
    pw[:, depth] = 1.0 if depth == 0 else 0.0
    for i in range(depth - 1, -1, -1):
        pw[:, i + 1] += o * pw[:, i] * (i + 1) / (depth + 1)
        pw[:, i] = z * pw[:, i] * (depth - i) / (depth + 1)


def _unwind(fi, zf, of, pw, depth, k):
    o = of[:, k].copy()
    z = zf[k]
    nxt = pw[:, depth].copy()
    nz = o != 0
    safe_o = np.where(nz, o, 1.0)
    for i in range(depth - 1, -1, -1):
        tmp = pw[:, i].copy()
        with np.errstate(divide="ignore", invalid="ignore"):
            a = nxt * (depth + 1) / ((i + 1) * safe_o)
            b = pw[:, i] * (depth + 1) / (z * (depth - i)) if z != 0 else np.zeros_like(tmp)
        pw[:, i] = np.where(nz, a, b)
        nxt = np.where(nz, tmp - pw[:, i] * z * (depth - i) / (depth + 1), nxt)
    for i in range(k, depth):
        fi[i], zf[i] = fi[i + 1], zf[i + 1]
        of[:, i] = of[:, i + 1]


def _unwound_sum(zf, of, pw, depth, k):
    o = of[:, k]
    z = zf[k]
    nxt = pw[:, depth].copy()
    total = np.zeros(len(o))
    nz = o != 0
    safe_o = np.where(nz, o, 1.0)
    for i in range(depth - 1, -1, -1):
        tmp = nxt * (depth + 1) / ((i + 1) * safe_o)
        alt = (pw[:, i] / z) / ((depth - i) / (depth + 1)) if z != 0 else np.zeros_like(tmp)
        total += np.where(nz, tmp, alt)
        nxt = np.where(nz, pw[:, i] - tmp * z * ((depth - i) / (depth + 1)), nxt)
    return total


def _depth(tree: Tree) -> int:
    best, stack = 0, [(0, 0)]
    while stack:
        node, d = stack.pop()
        best = max(best, d)
        if tree.left[node] >= 0:
            stack += [(tree.left[node], d + 1), (tree.right[node], d + 1)]
    return best


def tree_shap(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Exact path-dependent SHAP values of one tree for every row of x."""
    n, m = x.shape
    phi = np.zeros((n, m))
    max_d = _depth(tree)

    def recurse(node, fi, zf, of, pw, depth, pz, po, pf):
        fi, zf, of, pw = fi.copy(), zf.copy(), of.copy(), pw.copy()
        _extend(fi, zf, of, pw, depth, pz, po, pf)
        if tree.left[node] < 0:
            for i in range(1, depth + 1):
                w = _unwound_sum(zf, of, pw, depth, i)
                phi[:, fi[i]] += w * (of[:, i] - zf[i]) * tree.value[node]
            return
        f = tree.feature[node]
        if tree.cats[node] is not None:
            go_left = np.isin(x[:, f], list(tree.cats[node]))
        else:
            go_left = x[:, f] <= tree.threshold[node]
        inc_z, inc_o = 1.0, np.ones(n)
        k = next((i for i in range(depth + 1) if fi[i] == f), None)
        d = depth
        if k is not None:
            inc_z, inc_o = zf[k], of[:, k].copy()
            _unwind(fi, zf, of, pw, depth, k)
            d -= 1
        c = tree.cover[node]
        lft, rgt = tree.left[node], tree.right[node]
        recurse(lft, fi, zf, of, pw, d + 1, tree.cover[lft] / c * inc_z, inc_o * go_left, f)
        recurse(rgt, fi, zf, of, pw, d + 1, tree.cover[rgt] / c * inc_z, inc_o * ~go_left, f)

    fi = np.full(max_d + 2, -1)
    zf = np.zeros(max_d + 2)
    of = np.zeros((n, max_d + 2))
    pw = np.zeros((n, max_d + 2))
    recurse(0, fi, zf, of, pw, 0, 1.0, np.ones(n), -1)
    return phi


def tree_attributions(df: DataFrame, model, feature_cols: Sequence[str], id_col: str,
                      features_col: str = "features", scratch: str | None = None) -> DataFrame:
    """Long form (id, feature, value, attribution) for a tree ensemble."""
    from pyspark.ml.functions import vector_to_array

    from ..session import scratch_path
    from .boosting import BoostedTrees

    spark = df.sparkSession
    saved = not isinstance(model, BoostedTrees)  # whose nodes are at hand
    trees = model_trees(model, scratch or (scratch_path(spark, "trees") if saved else ""))
    bc = spark.sparkContext.broadcast(trees)
    names = list(feature_cols)

    def fn(batches):
        ts = bc.value
        m = len(names)
        for batch in batches:
            n = batch.num_rows
            x = np.asarray(batch.column(1).flatten(), float).reshape(n, m)
            phi = np.zeros_like(x)
            for t in ts:
                phi += t.weight * tree_shap(t, x)
            # ids stay in Arrow: integers with a null, or above 2^53, keep their value
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), m))), pa.array(np.tile(np.array(names, dtype=object), n), pa.string()),
                 pa.array(x.ravel()), pa.array(phi.ravel())], names=[id_col, "feature", "value", "attribution"])

    src = df.select(F.col(id_col), vector_to_array(features_col).alias("__x"))
    id_type = df.schema[id_col].dataType.simpleString()
    return src.mapInArrow(fn, f"`{id_col}` {id_type}, feature string, value double, attribution double")
