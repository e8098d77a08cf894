"""Encoder, split and weights invariants (FX3, FX4)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.operators import features


def _fx3(spark, n=300, seed=42):
    """FX3-like synthetic contacts: 12 % positives, 5 jobs, 4 education levels."""
    rng = np.random.default_rng(seed)
    n_yes = max(10, int(n * 0.12))
    jobs = ["admin.", "technician", "retired", "services", "student"]
    edu = ["basic.4y", "high.school", "university.degree", "unknown"]
    rows = []
    for i in range(n):
        rows.append((i, int(rng.integers(18, 80)), jobs[i % 5], edu[i % 4],
                     999 if i % 3 else int(rng.integers(1, 30)), float(rng.uniform(-3, 2)),
                     1 if i < n_yes else 0))
    return spark.createDataFrame(rows, "id long, age int, job string, education string, "
                                       "pdays int, euribor3m double, y int")


def test_split_sizes_and_class_rates(spark):
    df = _fx3(spark)
    s = features.stratified_split(df, "y", "id", seed=42, test_size=0.2, val_size=0.1)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 300
    assert counts["test"] == 60
    rate = df.agg(F.avg("y")).first()[0]
    for part in ("train", "val", "test"):
        r = s.where(F.col("split") == part).agg(F.avg("y")).first()[0]
        assert abs(r - rate) < 0.05
    assert s.select("id").distinct().count() == 300


def test_split_is_deterministic(spark):
    df = _fx3(spark)
    a = features.stratified_split(df, "y", "id").select("id", "split")
    b = features.stratified_split(df, "y", "id").select("id", "split")
    assert a.exceptAll(b).count() == 0


def test_encoder_fit_on_train_and_unseen(spark):
    train = spark.createDataFrame([(j, float(i)) for i, j in enumerate(["admin.", "technician", "retired"] * 10)],
                                  "job string, x double")
    test = spark.createDataFrame([("admin.", 1.0), ("exclusive_test_only_job", 2.0)] * 5, "job string, x double")
    enc = features.FeatureEncoder(numerical=["x"], nominal=["job"]).fit(train)
    assert enc.categories["job"] == ["admin.", "retired", "technician"]
    out = enc.transform(test).collect()
    unseen = [r for r in out if r["ohe__job_admin."] == 0.0]
    assert unseen and all(r["ohe__job_retired"] == 0.0 and r["ohe__job_technician"] == 0.0 for r in unseen)
    # population std of 0..29
    assert enc.stds["x"] == pytest.approx(np.std(np.arange(30)))
    assert all(v is not None for r in out for v in r)


def test_ordinal_unknown_and_order(spark):
    order = ["illiterate", "basic.4y", "unknown"]
    df = spark.createDataFrame([("illiterate",), ("unknown",), ("phd",), (None,)], "e string")
    vals = [r[0] for r in df.select(features.ordinal_expr("e", order)).collect()]
    assert vals == [0.0, 2.0, -1.0, -1.0]


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    enc = features.FeatureEncoder(numerical=["x"]).fit(df)
    assert [r[0] for r in enc.transform(df).collect()] == [0.0, 0.0]


def test_drop_first_dummies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, c string")
    out = features.one_hot(df, ["c"], drop_first=True)
    assert out.columns == ["id", "c_b", "c_c"]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,)] * 10 + [(0,)] * 30, "y int")
    w = {r["y"]: r["weight"] for r in features.balanced_weights(df, "y").collect()}
    assert w[1] == pytest.approx(40 / (2 * 10)) and w[0] == pytest.approx(40 / (2 * 30))


def test_encoder_refuses_id_like_columns(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        features.FeatureEncoder(nominal=["c"], max_categories=50).fit(df)


def test_split_without_strata_takes_quotas_of_the_whole_table(spark):
    import hashlib

    df = _fx3(spark)
    s = features.stratified_split(df, "y", "id", seed=7, test_size=0.25, val_size=0.15, stratify=False)
    got = {r["id"]: r["split"] for r in s.collect()}
    order = sorted(range(300), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    want = {i: "test" if k < 75 else "val" if k < 120 else "train" for k, i in enumerate(order)}
    assert got == want


def test_split_tiny_classes_and_null_class(spark):
    df = spark.createDataFrame([(i, None if i == 5 else int(i > 3)) for i in range(6)], "id long, y int")
    got = features.stratified_split(df, "y", "id").collect()
    assert len(got) == 6 and {r["split"] for r in got} <= {"train", "test", "val"}
