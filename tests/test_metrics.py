"""Metrics against brute-force definitions on small fixtures (FX6-like)."""

import itertools

import numpy as np
import pytest

from leadlens.operators import metrics


def _fixture(spark, n=50, pos=12, seed=42):
    rng = np.random.default_rng(seed)
    p = np.round(rng.uniform(size=n), 2)          # rounded: ties on purpose
    y = np.array([1] * pos + [0] * (n - pos))
    df = spark.createDataFrame([(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "id long, y int, p double")
    return df, y, p


def _auc_pairs(y, p):
    pos = p[y == 1]
    neg = p[y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def _ap(y, p):
    order = sorted(set(p), reverse=True)
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in order:
        sel = p >= t
        tp = (y[sel] == 1).sum()
        prec = tp / sel.sum()
        r = tp / P
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


def test_roc_auc_and_ap(spark):
    df, y, p = _fixture(spark)
    row = metrics.curve_areas(df, "y", "p").first()
    assert row["roc_auc"] == pytest.approx(_auc_pairs(y, p), abs=1e-12)
    assert row["average_precision"] == pytest.approx(_ap(y, p), abs=1e-12)


def test_binary_metrics_keys_and_zero_division(spark):
    df, y, p = _fixture(spark)
    row = metrics.binary_metrics(df, "y", "p", 2.0).first().asDict()
    assert set(row) == {"roc_auc", "pr_auc", "f1", "precision", "recall", "accuracy"}
    assert row["precision"] == 0.0 and row["f1"] == 0.0 and row["recall"] == 0.0


def test_confusion_matrix(spark):
    df, y, p = _fixture(spark)
    r = metrics.confusion_matrix(df, "y", "p", 0.5).first()
    pred = (p >= 0.5).astype(int)
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (
        int(((y == 0) & (pred == 0)).sum()), int(((y == 0) & (pred == 1)).sum()),
        int(((y == 1) & (pred == 0)).sum()), int(((y == 1) & (pred == 1)).sum()))


def test_grid_floats_match_arange():
    g = metrics.grid_points(0.1, 0.9, 0.01)
    assert len(g) == 80 and g[13] == 0.22999999999999995 and g[-1] == 0.8899999999999996
    assert len(metrics.grid_points(0.05, 0.95, 0.01)) == 90


def test_tune_threshold_matches_loop(spark):
    df, y, p = _fixture(spark)
    best_t, best_f1 = 0.5, 0.0
    for t in metrics.grid_points(0.1, 0.9, 0.01):
        pred = p >= t
        tp = int((pred & (y == 1)).sum())
        fp = int((pred & (y == 0)).sum())
        fn = int((~pred & (y == 1)).sum())
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > best_f1:
            best_f1, best_t = f1, t
    r = metrics.tune_threshold(df, "y", "p").first()
    assert r["threshold"] == best_t and r["f1"] == pytest.approx(best_f1)
    assert 0.1 <= r["threshold"] <= 0.9


def test_tune_threshold_all_zero_returns_half(spark):
    df = spark.createDataFrame([(0, 0.95), (0, 0.97), (1, 0.01)], "y int, p double")
    assert metrics.tune_threshold(df, "y", "p").first()["threshold"] == 0.5


def test_pr_curve_endpoint_and_truncation(spark):
    df, y, p = _fixture(spark)
    pts = metrics.pr_curve(df, "y", "p").collect()
    assert any(r["threshold"] is None and r["precision"] == 1.0 and r["recall"] == 0.0 for r in pts)
    assert sum(1 for r in pts if r["recall"] == 1.0) == 1


def test_gains_capture_reaches_one(spark):
    df, y, p = _fixture(spark)
    g = metrics.gains_curve(df, "y", "p", "id").orderBy("bin").collect()
    assert len(g) == 10 and g[-1]["capture"] == 1.0 and sum(r["n"] for r in g) == 50


def test_classification_report_rows(spark):
    df, y, p = _fixture(spark)
    rows = {r["class"]: r for r in metrics.classification_report(df, "y", "p", 0.5).collect()}
    assert set(rows) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rows["0"]["support"] + rows["1"]["support"] == 50
