import math

import numpy as np
import pytest

from leadlens.llm import topk
from tests.conftest import SF_SMALL
from tests.oracle_util import compare, duck


def brute(rows, queries, k=10):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in sorted(good, reverse=True) if i in queries}.items():
        found = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, queries, **kw):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id int, embedding array<float>, score int, n int").repartition(3)
    return sorted(tuple(r) for r in topk.top_k(df, df.filter(df.vec_id.isin(*queries)), **kw).collect())


def test_equals_brute_force_with_ties_nulls_and_odd_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 20) / 1024).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(40)]  # copies: ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 20), (503, [float("inf")]), (504, []), (505, [0.5]),
             (None, [1.0] * 20), (7, rows[7][1])]
    queries = [0, 5, 7, 100, 401, 500, 504, 505]
    assert run(spark, rows, queries) == brute(rows, queries)


def test_few_rows_large_values_and_none(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, 3.0]), (2, [-3e38, 1.0])]
    assert run(spark, rows, [0, 1]) == brute(rows, [0, 1])
    assert run(spark, rows, [9]) == []
    assert run(spark, [(1, [1.0])], [1]) == []


def test_bounds_drop_candidates_but_no_result():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(64, 3000)) * 100
    x[8:] *= 0.05  # most mass lies in the first block
    x = np.floor(x)
    ids = np.arange(3000)
    best = topk.Best(5, 10)
    for lo in range(0, 3000, 1000):
        topk.search_block(best, ids[:5], x[:, :5], ids[lo:lo + 1000], x[:, lo:lo + 1000])
    for i in range(5):
        s = x[:, i] @ x
        want = sorted((-s[j], j) for j in range(3000) if j != i)[:10]
        assert [(-a, b) for a, b in zip(best.scores[i], best.ids[i])] == want


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_oracle(spark, sf):
    ok, message = compare(topk.query(spark, sf), duck(sf), topk.SQL)
    assert ok, message
