"""Hypothesis tests on hand-checked fixtures."""

import numpy as np
import pytest

from leadlens.operators import hypothesis, multivariate


def test_chi2_yates_two_by_two(spark):
    # table [[10, 20], [30, 40]]: expected 12/18/28/42, Yates-corrected chi2 = 0.4464
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 40
    df = spark.createDataFrame(rows, "f string, y int")
    r = hypothesis.chi_squared_test(df, ["f"], "y").first()
    assert r["dof"] == 1
    assert r["chi2"] == pytest.approx(0.4464, abs=1e-4)
    assert r["p_value"] == pytest.approx(0.50403, abs=1e-4)


def test_chi2_uses_zero_cells(spark):
    # 3 x 2 table with an empty cell; no correction (dof = 2)
    rows = [("a", 1)] * 5 + [("b", 0)] * 5 + [("c", 1)] * 3 + [("c", 0)] * 3
    df = spark.createDataFrame(rows, "f string, y int")
    obs = np.array([[5, 0], [0, 5], [3, 3]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    want = ((obs - exp) ** 2 / exp).sum()
    r = hypothesis.chi_squared_test(df, ["f"], "y").first()
    assert r["dof"] == 2 and r["chi2"] == pytest.approx(round(want, 4))


def test_welch_sign_and_dof(spark):
    g0 = [1.0, 2.0, 3.0, 4.0, 5.0]
    g1 = [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    df = spark.createDataFrame([(x, 0) for x in g0] + [(x, 1) for x in g1], "x double, y int")
    r = hypothesis.welch_t_test(df, ["x"], "y").first()
    a, b = np.var(g0, ddof=1) / 5, np.var(g1, ddof=1) / 6
    t = (np.mean(g0) - np.mean(g1)) / np.sqrt(a + b)
    dof = (a + b) ** 2 / (a * a / 4 + b * b / 5)
    assert r["t_statistic"] == pytest.approx(round(t, 4))
    assert r["dof"] == pytest.approx(dof)
    assert r["t_statistic"] < 0 and r["mean_group0"] == 3.0
    assert 0 < r["p_value"] < 0.05


def test_welch_needs_two_groups(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 2)], "x double, y int")
    r = hypothesis.welch_t_test(df, ["x"], "y").first()
    assert r["error"] and r["t_statistic"] is None


def test_anova_matches_pooled_t_squared(spark):
    g0 = [1.0, 2.0, 3.0, 4.0]
    g1 = [3.0, 5.0, 7.0, 9.0]
    df = spark.createDataFrame([(x, 0) for x in g0] + [(x, 1) for x in g1], "x double, g int")
    r = hypothesis.anova_test(df, ["x"], "g").first()
    sp2 = (np.var(g0, ddof=1) * 3 + np.var(g1, ddof=1) * 3) / 6
    t = (np.mean(g1) - np.mean(g0)) / np.sqrt(sp2 * (1 / 4 + 1 / 4))
    assert r["f_statistic"] == pytest.approx(round(t * t, 4))
    assert r["n_groups"] == 2


def test_summarise_keeps_errors_last(spark):
    df = spark.createDataFrame([(1.0, "a", 0), (2.0, "b", 1), (3.0, "a", 0), (5.0, "b", 1),
                                (4.0, "a", 1), (2.5, "b", 0)], "x double, c string, y int")
    out = hypothesis.summarise_features(df, ["x"], ["c"], "y").collect()
    assert {r["feature"] for r in out} == {"x", "c"}
    ps = [r["p_value"] for r in out]
    assert ps == sorted(ps)


def test_vif_uncentred(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) + np.array([1.0, 2.0, 0.0])
    x[:, 2] = x[:, 0] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in multivariate.compute_vif(df, ["a", "b", "c"]).collect()}
    g = x.T @ x
    inv = np.linalg.inv(g)
    for i, n in enumerate("abc"):
        assert got[n] == pytest.approx(g[i, i] * inv[i, i], rel=1e-9)
    # sorted descending
    vals = [r["vif"] for r in multivariate.compute_vif(df, ["a", "b", "c"]).collect()]
    assert vals == sorted(vals, reverse=True)


def test_vif_drops_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, k double")
    assert [r["feature"] for r in multivariate.compute_vif(df, ["a", "k"]).collect()] == ["a"]


def _tau_b_brute(x, y):
    n = len(x)
    s = n1 = n2 = 0
    for i in range(n):
        for j in range(i + 1, n):
            dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s += dx * dy
            n1 += dx == 0
            n2 += dy == 0
    n0 = n * (n - 1) / 2
    return s / np.sqrt((n0 - n1) * (n0 - n2))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_kendall_tau_b_matches_pairs(spark, parts):
    from leadlens.operators.kendall import tau_b

    rng = np.random.default_rng(parts)
    x = rng.integers(0, 6, size=300).astype(float)          # many ties
    y = np.round(x * 0.5 + rng.normal(size=300), 1)
    y[:40] = 2.0                                           # a hot tie group
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    assert tau_b(df, "a", "b", num_partitions=parts) == pytest.approx(_tau_b_brute(x, y), abs=1e-12)


def test_count_earlier_smaller():
    from leadlens.operators.kendall import count_earlier_smaller

    rng = np.random.default_rng(3)
    a = rng.integers(0, 20, size=257)
    want = sum(1 for j in range(len(a)) for i in range(j) if a[i] < a[j])
    assert count_earlier_smaller(a) == want


def test_kendall_matrix(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0)], "a double, b double")
    m = {(r["feature_a"], r["feature_b"]): r["corr"]
         for r in multivariate.correlation_matrix(df, ["a", "b"], "kendall").collect()}
    assert m[("a", "b")] == pytest.approx(round(_tau_b_brute([1, 2, 3, 4], [2, 1, 4, 3]), 4))
    assert m[("a", "a")] == 1.0


def test_spearman_average_ranks_with_ties(spark):
    import pandas as pd

    rng = np.random.default_rng(11)
    a = rng.integers(0, 5, size=400).astype(float)
    b = a + rng.normal(size=400)
    b[:150] = 1.0                                    # a value held by over a third of rows
    c = rng.normal(size=400)
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)],
                               "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"]
           for r in multivariate.correlation_matrix(df, ["a", "b", "c"], "spearman").collect()}
    want = pd.DataFrame({"a": a, "b": b, "c": c}).rank().corr()
    for x in "abc":
        for y in "abc":
            assert got[(x, y)] == pytest.approx(round(want.loc[x, y], 4), abs=1e-4)


def test_logit_summary_matches_newton(spark):
    rng = np.random.default_rng(2)
    n = 800
    x = rng.normal(size=(n, 2))
    eta = -0.3 + 1.2 * x[:, 0] - 0.7 * x[:, 1]
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-eta))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)],
                               "a double, b double, y int")
    got = {r["term"]: r for r in multivariate.logit_summary(df, ["a", "b"], "y").collect()}
    X = np.column_stack([np.ones(n), x])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        W = p * (1 - p)
        H = X.T @ (X * W[:, None])
        step = np.linalg.solve(H, X.T @ (y - p))
        beta += step
        if np.abs(step).max() < 1e-12:
            break
    se = np.sqrt(np.diag(np.linalg.inv(H)))
    for name, b, s in zip(["const", "a", "b"], beta, se):
        assert got[name]["coef"] == pytest.approx(b, abs=1e-6)
        assert got[name]["std_err"] == pytest.approx(s, rel=1e-4)
        assert got[name]["z"] == pytest.approx(b / s, rel=1e-4)
