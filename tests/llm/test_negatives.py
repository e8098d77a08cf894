import math

import numpy as np
import pytest

from leadlens.llm import negatives
from tests.conftest import SF_SMALL
from tests.oracle_util import compare, duck

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def brute(rows, anchors, positives=5, wanted=3):
    good = [(i, label, [max(-2**62, min(2**62, math.floor(256 * float(x)))) for x in v]) for i, label, v in rows
            if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, q in {r[0]: r for r in sorted(good, reverse=True) if r[0] in anchors}.values():
        score = [(max(LEAST, min(MOST, sum(a * b for a, b in zip(q, v)))), j, other) for j, other, v in good if j != i]
        for p, pid in sorted(((s, j) for s, j, other in score if other == label), key=lambda t: (-t[0], t[1]))[:positives]:
            inside = sorted((-s, j) for s, j, other in score if other != label and 50 * p <= 100 * s <= 95 * p)[:wanted]
            out += [(i, pid, r + 1, j, p, -s) for r, (s, j) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, anchors, **kw):
    df = spark.createDataFrame([(i, label, v, 7, 8) for i, label, v in rows],
                               "vec_id int, label int, embedding array<float>, rank int, n int").repartition(3)
    got = negatives.mine(df, df.filter(df.vec_id.isin(*anchors)), **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_strassen_is_exact_for_any_shape():
    rng = np.random.default_rng(3)
    for shape in ((1, 1, 1), (17, 33, 65), (40, 64, 100), (37, 70, 41), (0, 5, 3), (4, 0, 4)):
        a, b = rng.integers(-1 << 20, 1 << 20, shape[:2]), rng.integers(-1 << 20, 1 << 20, shape[1:])
        assert (negatives.strassen(a, b, leaf=3) == a @ b).all()
    big = rng.integers(1 << 55, 1 << 60, (20, 6))
    want = np.clip(big.astype(object) @ big.T.astype(object), LEAST, MOST)
    assert (negatives.scores(big, big) == want.astype(np.int64)).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(5)
    found, ids = rng.integers(-4, 5, (6, 400)), rng.permutation(400)
    allowed = rng.random((6, 400)) < 0.7
    for cuts in ([0, 400], [0, 7, 100, 399, 400]):
        heap = negatives.Heaps(6, 5)
        for lo, hi in zip(cuts, cuts[1:]):
            heap.merge(np.arange(6), found[:, lo:hi], allowed[:, lo:hi], ids[lo:hi])
        for r in range(6):
            want = sorted((-found[r, c], ids[c]) for c in range(400) if allowed[r, c])[:5]
            assert [(-s, i) for s, i in zip(heap.scores[r], heap.ids[r])] == want


def test_equals_brute_force_with_ties_nulls_and_odd_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(4)), (rng.integers(-3, 5, 20) / 256).tolist()) for i in range(400)]
    rows += [(500 + i, i % 4, rows[5][2]) for i in range(40)]  # copies: ties
    rows += [(600, 1, None), (601, 1, [1.0, None]), (602, 1, [float("nan")] * 20), (603, 2, [float("inf")]), (604, 0, []),
             (605, 0, [0.5]), (None, 1, [1.0] * 20), (606, None, [0.01] * 20), (7, 3, rows[7][2]), (5, 2, rows[5][2])]
    anchors = [0, 5, 7, 100, 503, 600, 604, 605, 606]
    want = brute(rows, anchors)
    assert len(want) > 50
    assert run(spark, rows, anchors) == want
    assert run(spark, rows, anchors, group_rows=50, anchor_rows=3) == want


def test_large_values_one_label_and_none(spark):
    rows = [(0, 1, [1e20, 1.0]), (1, 1, [1e20, 3.0]), (2, 2, [3e16, 1.0]), (3, 2, [1e14, -9.0])]
    assert run(spark, rows, [0, 1]) == brute(rows, [0, 1])
    assert run(spark, rows, [9]) == []
    assert run(spark, [(i, 1, [1.0, 2.0]) for i in range(9)], [0]) == []


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_oracle(spark, sf):
    ok, message = compare(negatives.query(spark, sf), duck(sf), negatives.SQL)
    assert ok, message
