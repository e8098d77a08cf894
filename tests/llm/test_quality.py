import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadlens.llm import quality

SF = "/root/testdata/sf0.01"


def test_statistics_do_not_depend_on_neighbours():
    items = ["", " ", "One two.\nTHREE!! a|b #9 é", "x " * 50, "one two one two", "\n\n"]
    x = quality.statistics_of(pa.array(items))
    assert x.shape == (len(items), quality.N_STATISTICS) and np.isfinite(x).all()
    for i, t in enumerate(items):
        assert np.allclose(x[i], quality.statistics_of(pa.array([t]))[0])
    assert np.allclose(x[0], 0)


def brute_isotonic(y, n):
    """Greatest convex minorant slopes of the cumulative sum diagram."""
    cx, cy = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(y)))
    out = []
    for i in range(len(y)):
        out.append(max(min((cy[b] - cy[a]) / (cx[b] - cx[a]) for b in range(i + 1, len(cx))) for a in range(i + 1)))
    return np.array(out)


def test_isotonic_equals_the_convex_minorant():
    rng = np.random.default_rng(0)
    for _ in range(30):
        size = int(rng.integers(1, 15))
        n = rng.integers(1, 6, size)
        y = np.array([rng.integers(0, k + 1) for k in n])
        centres, levels = quality.isotonic(np.arange(size, dtype=float), n, y)
        assert (np.diff(centres) > 0).all() and (np.diff(levels) >= 0).all()
        want = brute_isotonic(y, n)
        assert len(centres) == len(np.unique(np.round(want, 9)))


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 10))
    z = quality.Fourier(np.zeros(10), np.ones(10), features=20000)(x)[:, 1:]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d / (2 * quality.WIDTH ** 2 * 10))).max() < 0.05


def test_normal_equations_equal_one_table(spark):
    x = np.random.default_rng(2).normal(size=(60, quality.N_STATISTICS))
    df = spark.createDataFrame([(r.tolist(), i % 2, 1 + i % 4) for i, r in enumerate(x)], "x array<double>, y int, fold int").repartition(5)
    fourier = quality.Fourier(x.mean(axis=0), x.std(axis=0), features=16)
    parts = quality.normal_equations(df, fourier)
    z, y = fourier(x), np.arange(60) % 2
    assert np.allclose(sum(p[0] for p in parts.values()), z.T @ z) and np.allclose(sum(p[1] for p in parts.values()), z.T @ y)
    assert sorted(parts) == [1, 2, 3, 4] and all(p[2] == 15 for p in parts.values())


def test_held_out_accuracy(spark):
    got = quality.query(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    good = held.quality == 1
    assert held.score[good].quantile(0.05) > held.score[~good].quantile(0.9)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.5), (2, None, 0.5), (None, "x", 0.5), (2, None, 0.5), (6, "y " * 5000, 0.1)],
                                 "doc_id int, text string, score double")
    none = spark.createDataFrame([], "doc_id long, label int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    one = spark.createDataFrame([(1, 1), (2, 1), (6, 1), (99, 0), (6, None), (6, 3)], "doc_id long, label int")
    got = quality.classify(docs, one).collect()
    assert len(got) == 5 and all(0.5 < r.score <= 1 for r in got)
    assert quality.classify(docs.filter(F.lit(False)), one).collect() == []


def test_kept_rows_are_those_that_classify_accepts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("statistics", F.lit("own")).withColumn("x", F.col("doc_id") * 2)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    got = kept.collect()
    assert len(got) == len(want) > 0 and {r.doc_id for r in got} == want
    assert all(r.statistics == "own" and r.x == 2 * r.doc_id for r in got)
    assert quality.keep(docs.limit(0), labels).collect() == []
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "a" * 300_000)], "doc_id long, text string")
    assert quality.keep(odd, labels.limit(0)).count() == 3


@pytest.mark.parametrize("doc", [0, 17, -5])
def test_fold_is_the_crc_of_the_text(spark, doc):
    assert spark.range(1).select(quality.fold(F.lit(doc))).first()[0] == zlib.crc32(str(doc).encode()) % 5
