"""Cleaning / scalar expressions (reference test invariants)."""

import pytest
from pyspark.sql import functions as F

from leadlens.functions import scalar
from leadlens.operators import cleaning
from leadlens.settings import Settings


def test_clean_recodes_and_maps(spark):
    df = spark.createDataFrame([(999, 10, "yes"), (5, 20, "no"), (999, 30, "maybe")],
                               "pdays int, duration int, y string")
    out = cleaning.clean(df, Settings()).collect()
    assert [r["pdays"] for r in out] == [-1, 5, -1]
    assert [r["y"] for r in out] == [1, 0, None]
    assert "duration" not in out[0].asDict()


def test_drop_leakage_ignores_missing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert cleaning.drop_leakage(df, ["duration"]).columns == ["a"]


def test_validate_customers(spark):
    full = {n: (1 if t == "int" else 1.5 if t == "double" else "x") for n, t in cleaning.CUSTOMER_FIELDS}
    rows = [dict(full), {**full, "age": None}]
    df = spark.createDataFrame(rows)
    out = cleaning.validate_customers(df).collect()
    assert out[0]["_errors"] == []
    assert out[1]["_errors"] == ["age: field required"]
    missing = cleaning.validate_customers(df.drop("euribor3m")).first()
    assert "euribor3m: field required" in missing["_errors"]


def test_empty_batch_rejected(spark):
    with pytest.raises(ValueError):
        cleaning.require_non_empty(spark.createDataFrame([], "a int"))


def test_prediction_record_uses_unrounded_probability(spark):
    df = spark.createDataFrame([(0.22996,), (0.23,), (0.9,)], "p double")
    out = df.select(*scalar.format_prediction("p", 0.23)).collect()
    assert out[0]["probability_of_subscription"] == 0.23 and out[0]["prediction_class"] == 0
    assert out[1]["prediction_class"] == 1 and out[1]["recommendation"].startswith("Call")
    assert all(r["threshold_used"] == 0.23 for r in out)


def test_relative_time(spark):
    df = spark.createDataFrame([(s,) for s in [0, 9, 10, 59, 60, 3599, 3600, 86399, 86400, 200000]], "s long")
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    ts = F.timestamp_seconds(F.unix_timestamp(now) - F.col("s"))
    got = [r[0] for r in df.select(scalar.relative_time(ts, now)).collect()]
    assert got == ["just now", "just now", "10s ago", "59s ago", "1m ago", "59m ago", "1h ago",
                   "23h ago", "1d ago", "2d ago"]


def test_tiers(spark):
    df = spark.createDataFrame([(60.0,), (59.9,), (30.0,), (29.99,)], "p double")
    assert [r[0] for r in df.select(scalar.tier("p")).collect()] == ["high", "medium", "medium", "low"]
    assert df.select(scalar.lead_tier("p")).first()[0] == "High Priority"


def test_canonical_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`emp.var.rate` double, euribor3m double")
    assert scalar.canonical_names(df).columns == ["emp_var_rate", "euribor3m"]
    assert scalar.canonical_names(scalar.canonical_names(df), "dotted").columns == ["emp.var.rate", "euribor3m"]


def test_split_valid(spark):
    full = {n: (1 if t == "int" else 1.5 if t == "double" else "x") for n, t in cleaning.CUSTOMER_FIELDS}
    df = spark.createDataFrame([dict(full), {**full, "age": None}, {**full, "campaign": None}])
    good, bad = cleaning.split_valid(df)
    assert good.count() == 1 and bad.count() == 2 and "_errors" not in good.columns


def test_research_log_append_and_latest(spark, tmp_path):
    from leadlens.operators.logs import latest
    from leadlens.sources.logs import append_research_log, research_records

    qs = spark.createDataFrame([(f"q{i}", f"a{i}", i) for i in range(15)], "query string, answer string, i int") \
              .withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("i")))
    path = str(tmp_path / "research")
    append_research_log(research_records(qs, ts_col="ts"), path)
    log = spark.read.parquet(path).withColumn("rid", F.monotonically_increasing_id())
    assert log.count() == 15 and log.first()["logged_at"].endswith(" UTC")
    recent = latest(log, 10, ts="timestamp", tie="rid", cols=("query", "timestamp")).collect()
    assert [r["query"] for r in recent] == [f"q{i}" for i in range(14, 4, -1)]


def test_tier_distribution_keeps_empty_tiers(spark):
    from leadlens.operators.logs import tier_distribution

    df = spark.createDataFrame([(0.9,), (0.95,), (None,)], "probability double")
    got = {r["tier"]: r["n"] for r in tier_distribution(df).collect()}
    assert got == {"high": 2, "medium": 0, "low": 0}
