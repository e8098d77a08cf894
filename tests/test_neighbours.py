"""Neighbours by the index of nominal tuples against brute force, and the approximate join's recall."""

import numpy as np
import pytest

from leadlens.operators import neighbours
from leadlens.operators.smote import exact_knn

GROUPS = [[2, 3, 4], [5, 6], [7, 8, 9, 10], [11, 12, 13]]


def make(n, seed=1, unseen=False, hot=False):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 14))
    x[:, :2] = rng.normal(size=(n, 2)).round(2) * [1.0, 0.6]
    x[::50, 0] += 6  # rows far from all others
    for g in GROUPS:
        pick = rng.integers(0, len(g), n)
        if hot:
            pick[: n // 2] = 0
        x[np.arange(n), np.array(g)[pick]] = 1
    if unseen:
        x[5, GROUPS[0]] = 0
        x[6, GROUPS[2]] = 0
    return x


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


def brute(x, k):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    ids = np.arange(len(x))
    return {i * 3: [j * 3 for j in np.lexsort((ids, d[i]))[:k]] for i in ids}


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {})[r["nb_rank"]] = r["nb_id"]
    return {i: [v[r] for r in sorted(v)] for i, v in out.items()}


@pytest.mark.parametrize("n,kw", [(300, {}), (120, {"unseen": True}), (500, {"hot": True})])
def test_equals_brute_force(spark, n, kw, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbours, "FAR_ROWS", 16)
    x = make(n, **kw)
    got, visited = neighbours.nominal_knn(frame(spark, x), "id", "v", 5, GROUPS, block_rows=16)
    assert lists(got) == brute(x, 5)
    assert 0 < visited < n * (n - 1)


def test_small_and_not_one_hot_inputs(spark):
    x = make(4)
    got, _ = neighbours.nominal_knn(frame(spark, x), "id", "v", 5, GROUPS)
    assert lists(got) == brute(x, 3)
    x = make(40)
    x[3, 2] = 0.5  # no indicator any more
    got, _ = neighbours.nominal_knn(frame(spark, x), "id", "v", 5, GROUPS)
    assert lists(got) == brute(x, 5)


def test_visited_pairs_stay_far_below_all_pairs(spark):
    per_row = []
    for n in (400, 1600):
        _, visited = neighbours.nominal_knn(frame(spark, make(n, seed=3)), "id", "v", 5, GROUPS)
        per_row.append(visited / n)
    assert per_row[1] < 2 * per_row[0] and per_row[1] < 0.25 * 1600


def test_lsh_recall_and_arguments(spark):
    x = make(400, seed=9)
    df = frame(spark, x)
    want = {r["id"]: set() for r in df.collect()}
    for r in exact_knn(df, "id", "v", 5).collect():
        want[r["id"]].add((r["nb_id"]))
    got = lists(neighbours.knn(df, "id", "v", 5, method="lsh", radius=4.0))
    hit = sum(len(want[i] & set(got.get(i, []))) for i in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    with pytest.raises(ValueError):
        neighbours.knn(df, "id", "v", 5, method="lsh")
    with pytest.raises(ValueError):
        neighbours.knn(df, "id", "v", 5, method="other")


def test_only_rows_in_reach_are_compared():
    import types

    import numpy as np

    from leadlens.operators import neighbours

    class Watched(np.ndarray):
        looked = 0

        def __getitem__(self, key):
            Watched.looked += 1
            return super().__getitem__(key)

    rng = np.random.default_rng(1)

    def side(n, first):
        z = rng.normal(size=(n, 2))
        return types.SimpleNamespace(ids=np.arange(first, first + n), s=z[:, 0], v=z, codes=np.ones((n, 1), "<i4").view(Watched))

    q, c = side(300, 0), side(400, 1000)
    d, found = np.full((300, 2), 0.5), np.full((300, 2), -1, np.int64)
    assert neighbours.nearest(q, c, d, found, 2, 1, 1, 2) == 0  # all have two neighbours nearer than the root of 2
    assert Watched.looked == 0 and (found == -1).all()
    d[:] = np.inf
    neighbours.nearest(q, c, d, found, 2, 0, 0, 2)
    every = np.sqrt(((q.v[:, None] - c.v[None]) ** 2).sum(-1))
    np.testing.assert_allclose(d, np.sort(every, 1)[:, :2])
    assert (found == 1000 + np.argsort(every, 1)[:, :2]).all()


def test_only_rows_that_ask_travel_and_only_lists_are_left(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from leadlens import session

    apply = PandasCogroupedOps.applyInArrow

    def bounded(self, func, schema):
        def run(left, right):
            rows = sum(len(b) // 8 for b in {b.as_py() for b in left["ids"]})  # a block may ask by many keys
            if rows > 30:
                raise ValueError(f"{rows} rows ask")
            return func(left, right)
        return apply(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", bounded)
    x = make(500, seed=5)
    for g in GROUPS:  # dense tuples, where only the rows far out (a 50th) ask other tuples
        x[:, g] = 0
        x[:, g[0]] = 1
    x[:200, GROUPS[0][:2]] = 0, 1
    before = len(session._written)
    got, _ = neighbours.nominal_knn(frame(spark, x), "id", "v", 5, GROUPS, block_rows=64)
    assert [p for p in session._written[before:] if "/knn-lists-" not in p] == []
    assert lists(got) == brute(x, 5)
