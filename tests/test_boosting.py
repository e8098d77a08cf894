"""Boosted trees: brute-force growth, warm rounds, sampling, saving, exact sums."""

import heapq

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from leadlens.operators import boosting
from leadlens.operators.attribution import expected_value, model_trees, tree_attributions
from leadlens.operators.boosting import BoostParams


def make(n=1000, seed=3, d=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(2)
    x[:, -1] = rng.integers(0, 2, n)
    y = ((x[:, 0] + x[:, 1] * x[:, -1] + rng.normal(scale=0.5, size=n)) > 0.3).astype(float)
    return x, y, np.where(y > 0, 2.0, 1.0)


def frame(spark, x, y, w, parts=3):
    rows = [(i, Vectors.dense(r.tolist()), float(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, ["id", "features", "label", "weight"]).repartition(parts)


def brute_tree(x, cuts, g, h, step, params):
    """One leaf at a time, best first, every histogram from the rows themselves."""
    bins = np.column_stack([np.minimum(np.searchsorted(c, x[:, i]), len(c) - 1) for i, c in enumerate(cuts)])

    def split_of(rows):
        best = None
        gs, hs = g[rows].sum() / step, h[rows].sum() / step
        for f in range(x.shape[1]):
            for b in range(len(cuts[f]) - 1):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) < max(1, params.min_rows):
                    continue
                gl, hl, gr, hr = g[left].sum() / step, h[left].sum() / step, g[right].sum() / step, h[right].sum() / step
                if min(hl, hr) < params.min_hessian:
                    continue
                gain = gl ** 2 / (hl + params.l2) + gr ** 2 / (hr + params.l2) - gs ** 2 / (hs + params.l2)
                if gain > params.min_gain and (best is None or gain > best[0]):
                    best = (gain, f, b, left, right)
        return best

    everyone = np.arange(len(x))
    leaves, queue, count = {0: everyone}, [], 1
    depth = {0: 0}

    def push(node):
        if params.max_depth <= 0 or depth[node] < params.max_depth:
            found = split_of(leaves[node])
            if found:
                heapq.heappush(queue, (-found[0], node, found[1:]))

    push(0)
    splits = []
    while queue and len(leaves) < (params.max_leaves or 1 << 60):
        gain, node, (f, b, left, right) = heapq.heappop(queue)
        splits.append((f, b, round(-gain, 6)))
        depth[count] = depth[count + 1] = depth[node] + 1
        leaves[count], leaves[count + 1] = left, right
        del leaves[node]
        push(count)
        push(count + 1)
        count += 2
    value = np.zeros(len(x))
    for rows in leaves.values():
        value[rows] = -params.learning_rate * (g[rows].sum() / step) / (h[rows].sum() / step + params.l2)
    return sorted(splits), value


@pytest.mark.parametrize("params", [
    BoostParams(rounds=2, max_depth=6, max_leaves=20, l2=0.0, min_rows=5, min_hessian=1e-3, max_bins=32),
    BoostParams(rounds=2, max_depth=0, max_leaves=31, l2=0.0, min_rows=20, max_bins=16),
    BoostParams(rounds=2, max_depth=3, l2=1.0, max_bins=20)], ids=["leaf-wise", "no depth", "level-wise"])
def test_trees_equal_a_brute_force_grower(spark, params):
    x, y, w = make()
    train = frame(spark, x, y, w)
    model = boosting.fit(train, None, params)
    cuts = boosting.bin_cuts(train.select(vector_to_array("features").alias("x")), 4, params.max_bins)
    step = 2.0 ** boosting.STEP_BITS / w.max()
    margin = np.full(len(x), model.base)
    for tree in model.trees:
        g, h = boosting.gradients(y, w, margin, step)
        splits, value = brute_tree(x, cuts, g, h, step, params)
        inner = tree.feature >= 0
        assert sorted(zip(tree.feature[inner].tolist(), tree.cut[inner].tolist(), tree.gain[inner].round(6).tolist())) == splits
        got = tree.value[tree.leaves(x, tree.threshold)]
        np.testing.assert_allclose(got, value, rtol=1e-12)
        assert tree.rows[0] == len(x) and tree.n_leaves <= (params.max_leaves or 1 << 60)
        margin = margin + got
    assert len(model.trees) == 2


def test_best_first_differs_from_level_order_and_uses_its_leaves(spark):
    x, y, w = make(seed=5)
    train = frame(spark, x, y, w)
    deep = boosting.fit(train, None, BoostParams(rounds=1, max_depth=0, max_leaves=8, min_rows=5, l2=0.0)).trees[0]
    flat = boosting.fit(train, None, BoostParams(rounds=1, max_depth=3, min_rows=5, l2=0.0)).trees[0]
    assert deep.n_leaves == 8 and flat.n_leaves <= 8
    assert deep.gain.sum() >= flat.gain.sum()


def test_warm_rounds_stop_by_patience_and_repeat_the_long_fit(spark, monkeypatch):
    x, y, w = make(400, seed=8)
    rng = np.random.default_rng(1)
    xv, yv = x[:150], rng.integers(0, 2, 150).astype(float)  # labels that do not follow: the loss turns soon
    train, val = frame(spark, x, y, w), frame(spark, xv, yv, np.ones(150))
    params = BoostParams(rounds=60, learning_rate=0.3, max_depth=3, patience=5)
    model = boosting.fit(train, val, params)
    best = max(1, int(np.argmin(model.losses)))
    assert len(model.trees) == best and model.fitted <= best + 5 < 60
    margin = np.full(len(x), model.base)
    for t in model.trees:
        margin += t.value[t.leaves(x, t.threshold)]
    np.testing.assert_allclose(model.margins(x), margin)
    # the same trees without stopping, and with margins written after every tree
    monkeypatch.setattr(boosting, "MARGIN_EVERY", 1)
    long = boosting.fit(train, None, BoostParams(rounds=model.fitted, learning_rate=0.3, max_depth=3))
    for a, b in zip(model.trees, long.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value, rtol=1e-9)
    # the losses are those of the margins
    m = model.margins(xv)
    want = np.logaddexp(0, np.where(yv > 0, -m, m)).mean()
    assert model.losses[best] == pytest.approx(want, abs=1e-8)


def test_partitions_do_not_change_trees(spark):
    x, y, w = make(600, seed=11)
    params = BoostParams(rounds=3, max_depth=4, max_leaves=9)
    one, many = (boosting.fit(frame(spark, x, y, w, p), None, params) for p in (1, 40))
    for a, b in zip(one.trees, many.trees):
        assert (a.feature == b.feature).all() and (a.value == b.value).all() and (a.rows == b.rows).all()


def test_sampling_scoring_saving_and_attributions(spark, tmp_path):
    x, y, w = make(500, seed=13)
    df = frame(spark, x, y, w)
    model = boosting.fit(df, None, BoostParams(rounds=8, max_depth=3, subsample=0.5, colsample=0.5))
    assert all(150 < t.rows[0] < 350 for t in model.trees)
    assert all(len(set(t.feature[t.feature >= 0].tolist())) <= 2 for t in model.trees)
    model.save(spark, str(tmp_path / "m"))
    back = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))


    scored = back.transform(df).select("id", "margin", vector_to_array("probability")[1].alias("p"), "prediction").orderBy("id").collect()
    want = model.margins(x)
    np.testing.assert_allclose([r.margin for r in scored], want, rtol=1e-12)
    np.testing.assert_allclose([r.p for r in scored], 1 / (1 + np.exp(-want)), rtol=1e-12)
    assert [r.prediction for r in scored] == (want > 0).astype(float).tolist()
    assert model.featureImportances.toArray().sum() == pytest.approx(1)
    big = df.withColumn("id", F.when(F.col("id") > 0, F.col("id") + (1 << 60)))  # a null and ids above 2^53
    sums = {r.id: r.s for r in tree_attributions(big, back, list("abcd"), "id").groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    base = model.base + expected_value(model_trees(back, str(tmp_path / "t")))
    assert set(sums) == {None} | {i + (1 << 60) for i in range(1, 500)}
    for i in range(1, 500, 37):
        assert base + sums[i + (1 << 60)] == pytest.approx(want[i], abs=1e-9)


def test_sums_add_up_in_a_tree_of_stages(spark):
    x, y, w = make(300, seed=17)
    df = frame(spark, x, y, w, 60)
    a = boosting.fit(df, None, BoostParams(rounds=1, max_depth=2))
    import unittest.mock as mock

    with mock.patch.object(boosting, "FAN", 3):
        b = boosting.fit(df, None, BoostParams(rounds=1, max_depth=2))
    assert (a.trees[0].value == b.trees[0].value).all()


def test_nothing_to_split_and_settings_names():
    p = boosting.params_of({"n_estimators": 500, "learning_rate": 0.05, "max_depth": 6, "num_leaves": 63, "subsample": 0.8,
                            "colsample_bytree": 0.8, "early_stopping_rounds": 50}, True, 1)
    assert (p.max_leaves, p.patience, p.subsample, p.colsample, p.min_rows) == (63, 50, 1.0, 0.8, 20)
    q = boosting.params_of({"max_depth": 6, "subsample": 0.8}, False, 1)
    assert (q.max_leaves, q.subsample, q.l2) == (None, 0.8, 1.0)


def test_one_class_gives_no_tree(spark):
    x, _, w = make(50)
    model = boosting.fit(frame(spark, x, np.ones(50), w), None, BoostParams(rounds=5))
    assert model.trees == [] and model.margins(x).shape == (50,)


def test_histograms_of_a_block_equal_row_by_row_sums():
    rng = np.random.default_rng(5)
    widths, n = [9, 2, 1, 2], 700
    first = np.concatenate(([0], np.cumsum(widths)))
    bins = np.column_stack([rng.integers(0, w, n) for w in widths]).astype(np.uint8)
    at = rng.choice([0, 2, 3], n)  # no row in node 1
    g, h = rng.integers(-2 ** 36, 2 ** 36, n).astype(float), rng.integers(0, 2 ** 36, n).astype(float)
    want, got = np.zeros((4, 3, int(first[-1])), np.int64), np.ones((4, 3, int(first[-1])), np.int64)
    for i in range(len(widths)):
        for k, v in enumerate((g, h, np.ones(n))):
            np.add.at(want, (at, k, first[i] + bins[:, i]), v.astype(np.int64))
    boosting._histograms(bins, at, g, h, got, first)
    assert (got == want + 1).all()


def test_cut_points_take_few_literals_of_the_driver(spark, monkeypatch):
    x, y, w = make(200)
    t = frame(spark, x, y, w).select(vector_to_array("features").alias("x"))
    calls, lit = [], F.lit
    monkeypatch.setattr(F, "lit", lambda v: calls.append(v) or lit(v))
    import pyspark.sql.functions.builtin as builtin

    monkeypatch.setattr(builtin, "lit", F.lit)
    boosting.bin_cuts(t, 4, 255)
    assert len(calls) < 50  # 255 a feature before
