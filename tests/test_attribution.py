"""TreeSHAP: exact Shapley values of the path-dependent value function, additivity."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from leadlens.operators.attribution import Tree, expected_value, model_trees, tree_attributions, tree_shap


def _cond_exp(tree, x, subset, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    f = tree.feature[node]
    lft, rgt = tree.left[node], tree.right[node]
    if f in subset:
        nxt = lft if x[f] <= tree.threshold[node] else rgt
        return _cond_exp(tree, x, subset, nxt)
    c = tree.cover[node]
    return (tree.cover[lft] * _cond_exp(tree, x, subset, lft)
            + tree.cover[rgt] * _cond_exp(tree, x, subset, rgt)) / c


def _brute_shap(tree, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for r in range(len(others) + 1):
            for s in itertools.combinations(others, r):
                w = math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                phi[i] += w * (_cond_exp(tree, x, set(s) | {i}) - _cond_exp(tree, x, set(s)))
    return phi


def test_tree_shap_equals_brute_force_shapley():
    # depth-3 tree over 3 features, feature 0 used twice on a path
    left = np.array([1, 3, 5, -1, -1, 7, -1, -1, -1])
    right = np.array([2, 4, 6, -1, -1, 8, -1, -1, -1])
    feat = np.array([0, 1, 0, -1, -1, 2, -1, -1, -1])
    thr = np.array([0.5, 0.3, 0.8, 0, 0, 0.4, 0, 0, 0])
    cover = np.array([100, 40, 60, 10, 30, 45, 15, 20, 25], dtype=float)
    value = np.array([0, 0, 0, 1.0, -2.0, 0, 3.0, 0.5, -1.5])
    t = Tree(left, right, feat, thr, [None] * 9, cover, value, 1.0)
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(20, 3))
    got = tree_shap(t, x)
    for r in range(20):
        np.testing.assert_allclose(got[r], _brute_shap(t, x[r], 3), atol=1e-12)


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_additivity_on_spark_models(spark, kind, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=300)) > 0).astype(float)
    df = spark.createDataFrame([(i, Vectors.dense(*map(float, x[i])), float(y[i])) for i in range(300)],
                               ["id", "features", "label"])
    est = (GBTClassifier(maxIter=5, maxDepth=3, seed=1) if kind == "gbt"
           else RandomForestClassifier(numTrees=4, maxDepth=4, seed=1))
    model = est.fit(df)
    names = ["a", "b", "c", "d"]
    attr = tree_attributions(df, model, names, "id", scratch=str(tmp_path))
    sums = {r["id"]: r["s"] for r in attr.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    base = expected_value(model_trees(model, str(tmp_path / "again")))
    out_col = "rawPrediction" if kind == "gbt" else "probability"
    outs = model.transform(df).select("id", vector_to_array(out_col)[1].alias("o")).collect()
    for r in outs:
        assert base + sums[r["id"]] == pytest.approx(r["o"], abs=1e-9)


def test_dependence_in_one_pass(spark):
    from leadlens.operators.scoring import attribution_dependence

    rows = [(1, "a", 2.0, 0.5), (1, "b", 3.0, -0.5), (2, "a", -1.0, 0.25), (2, "b", 0.0, 0.0), (2, "c", 9.0, 9.0)]
    attr = spark.createDataFrame(rows, "id long, feature string, value double, attribution double")
    got = attribution_dependence(attr, "id", "a", "b").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2.0, 0.5, 3.0), (2, -1.0, 0.25, 0.0)]
