import math
from fractions import Fraction

import numpy as np
import pytest

from leadlens.llm import whitening
from tests.conftest import SF_SMALL

SCHEMA = "vec_id int, embedding array<float>, component int, n int, ids string"


def numbers(rows, scale=64, offset=1_000_000):
    """Rows that take part as exact whole numbers."""
    dims = max((len(v) for _, v in rows if v is not None), default=0)
    out = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [max(-2**62, min(2**62, math.floor(scale * float(np.float32(x))))) + offset for x in v]
            out.append((i, whole + [offset] * (dims - len(v))))
    return out


def exact_covariance(rows):
    n, dims = len(rows), len(rows[0][1])
    s = [sum(x[d] for _, x in rows) for d in range(dims)]
    cov = [[sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for _, x in rows) for b in range(dims)] for a in range(dims)]
    return np.array([[float(Fraction(c, n ** 3)) for c in row] for row in cov]), s


def check(spark, rows, components=6):
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA).repartition(3)
    got, model = whitening.whiten(df, components)
    got = got.collect()
    want = numbers(rows)
    n = len(want)
    assert model.centre.n == n
    cov, s = exact_covariance(want)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = len(model.eigenvalues)
    assert k == min(components, int((values > 1e-10 * values[0]).sum()))
    assert np.allclose(model.eigenvalues, values[:k], rtol=1e-11)
    assert np.abs(cov @ model.components - model.components * model.eigenvalues).max() < 1e-12 * values[0]
    assert np.abs(model.components.T @ model.components - np.eye(k)).max() < 1e-13
    assert np.allclose(model.explained, values[:k] / np.trace(cov), rtol=1e-11)
    assert model.identity_error < 1e-9
    square = [sum((n * x - t) ** 2 for x, t in zip(v, s)) for _, v in want]
    assert sorted((r.vec_id is not None, r.vec_id or 0, r.deviation) for r in got) == sorted(
        (i is not None, i or 0, q if q < 1 << 63 else None) for (i, _), q in zip(want, square))
    white = np.array([r.whitened for r in got])
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-9
    return got, model


def test_equals_exact_covariance_with_nulls_copies_and_odd_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(20) * np.linspace(0.5, 3, 20)).tolist()) for i in range(200)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 20), (303, [float("inf")]), (304, []), (305, [0.5]),
             (None, [1.0] * 20), (7, rows[7][1]), (7, rows[8][1])]
    got, model = check(spark, rows)
    assert len(model.eigenvalues) == 6
    first = next(r for r in got if r.vec_id == 3)
    want = numbers(rows)
    x = np.array([[float(Fraction(len(want) * a - t, len(want))) for a, t in zip(v, exact_covariance(want)[1])] for i, v in want if i == 3])
    assert np.allclose(x @ model.basis, first.whitened, rtol=1e-11, atol=1e-12)


def test_fewer_rows_than_components_equal_rows_and_none(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, rng.standard_normal(12).tolist()) for i in range(4)], components=8)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)], [(1, []), (2, [])]):
        df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)
        got, model = whitening.whiten(df)
        assert got.count() == 0 and model is None


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i, [float(rng.integers(-9, 9)) * 1e15, float(rng.integers(-9, 9)), 1e20]) for i in range(30)], components=1)


@pytest.mark.parametrize("spread", ["flat", "steep", "equal", "low rank"])
def test_jacobi_davidson_reaches_double_precision(spread):
    rng = np.random.default_rng(4)
    dims, wanted = 300, 12
    values = {"flat": np.linspace(1, 1.2, dims), "steep": np.logspace(-9, 3, dims), "equal": np.repeat([1.0, 5.0, 5.0], 100),
              "low rank": np.where(np.arange(dims) < 5, 2.0, 0.0)}[spread]
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    calls = []

    def product(x):
        calls.append(x.shape[1])
        return a @ x

    theta, u, residuals = whitening.jacobi_davidson(product, dims, wanted)
    want = np.linalg.eigvalsh(a)[::-1][:wanted]
    assert np.allclose(theta, want, rtol=1e-12, atol=1e-12 * want[0])
    assert np.linalg.norm(a @ u - u * theta, axis=0).max() < 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(wanted)).max() < 1e-13
    assert (residuals < 1e-12).all() and len(calls) < 200


def test_minres_solves_symmetric_systems():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((40, 40))
    a, b = a + a.T, rng.standard_normal((40, 3))
    b[:, 2] = 0
    x = whitening.minres(lambda t: a @ t, b, 80, least=1e-12)
    assert np.abs(a @ x - b).max() < 1e-8


def test_sums_are_added_in_a_tree(spark):
    x = np.random.default_rng(7).standard_normal((400, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(100)
    found = whitening.materialize(whitening.blocks(df), "test-blocks")
    centre = whitening.centre_of(found)
    y = np.floor(64 * x)
    y -= y.mean(axis=0)
    got = whitening.Passes(found, centre, whitening.FAN ** 2 + 1).product(np.eye(5))
    assert np.allclose(got, y.T @ y / 400, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_query_against_numpy(spark, sf):
    rows = whitening.query(spark, sf).toPandas()
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(data.embedding.tolist(), float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    assert list(rows.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(rows) == 32 * n and (rows.n == n).all() and rows.identity_error.max() < 1e-9
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[data.vec_id].to_numpy()
    want = c @ (vectors / np.sqrt(values))
    signs = np.sign((wide * want).sum(axis=0))
    assert np.allclose(wide, want * signs, atol=1e-8)
    share = rows.drop_duplicates("component").set_index("component").explained.sort_index().to_numpy()
    assert np.allclose(share, values / (c * c).sum() * n, rtol=1e-10)
    one = rows[rows.component == 1].set_index("vec_id").deviation.loc[data.vec_id].to_numpy()
    assert (one == ((n * x - s) ** 2).sum(axis=1)).all()
