"""Stream scoring equals batch scoring; live tier counts equal the batch counts."""

import os

from pyspark.sql import functions as F

from leadlens.operators import models, scoring
from leadlens.operators.features import FeatureEncoder
from leadlens.operators.logs import tier_distribution
from leadlens.streaming.scoring import (file_stream, latest_tier_counts, run_to_completion,
                                        score_stream, state_session, tier_counts_stream)


def _fixture(spark):
    rows = [(i, float(i % 17), ["a", "b", "c"][i % 3], 999 if i % 4 else i % 30, i % 2)
            for i in range(400)]
    return spark.createDataFrame(rows, "id long, x double, c string, pdays int, y int")


def test_stream_scoring_matches_batch(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    df = _fixture(spark)
    enc = FeatureEncoder(numerical=["x", "pdays"], nominal=["c"]).fit(df)
    data = models.assemble(enc.transform(df, keep=["id", "y"]), enc.feature_names(), "y")
    model = LogisticRegression(maxIter=20).fit(data)
    batch = scoring.score_batch(df, enc, model, 0.5, id_cols=["id"])

    src = str(tmp_path / "src")
    df.repartition(4).write.parquet(src)
    q = score_stream(file_stream(spark, src, max_files=1), enc, model, 0.5, str(tmp_path / "sink"),
                     str(tmp_path / "ckpt"), id_cols=["id"])
    run_to_completion(q)
    streamed = spark.read.parquet(str(tmp_path / "sink")).drop("timestamp", "logged_at")
    assert streamed.count() == 400
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_tier_counts_live_in_the_state_store(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    src, checkpoint = str(tmp_path / "p"), str(tmp_path / "ckpt")
    small = state_session(spark, 2)
    seen = []
    for epoch in range(12):
        probs = spark.createDataFrame([(i / 100.0,) for i in range(100)] + [(None,)], "probability double")
        probs.coalesce(1).write.mode("append").parquet(src)
        run_to_completion(tier_counts_stream(file_stream(small, src, max_files=1), checkpoint))
        live = {r["tier"]: r["n"] for r in latest_tier_counts(spark, checkpoint).collect()}
        assert live == {"high": 40 * (epoch + 1), "medium": 30 * (epoch + 1), "low": 30 * (epoch + 1)}
        seen.append(latest_tier_counts(spark, checkpoint).count())
    assert set(seen) == {3}                     # three rows, however many epochs
    assert not os.path.exists(str(tmp_path / "sink"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    batch = {r["tier"]: r["n"] for r in tier_distribution(spark.read.parquet(src).where("probability IS NOT NULL")).collect()}
    assert live == batch
    states = [n for n in os.listdir(os.path.join(checkpoint, "state", "0")) if n.isdigit()]
    assert len(states) == 2


def test_prediction_log_stream_appends_once(spark, tmp_path):
    from leadlens.sources.logs import log_records
    from leadlens.streaming.scoring import append_prediction_log

    src = str(tmp_path / "req")
    spark.createDataFrame([(i, i / 10.0) for i in range(10)], "id long, p double").repartition(2).write.parquet(src)
    stream = file_stream(spark, src)
    recs = log_records(stream.withColumn("probability_of_subscription", F.round("p", 4)),
                       ["probability_of_subscription"], ["id", "p"])
    sink, ck = str(tmp_path / "log"), str(tmp_path / "ck")
    run_to_completion(append_prediction_log(recs, sink, ck))
    run_to_completion(append_prediction_log(recs, sink, ck))      # restart: nothing new to log
    out = spark.read.parquet(sink)
    assert out.count() == 10
    assert out.where(F.col("logged_at").endswith(" UTC")).count() == 10
    assert {r["input"]["id"] for r in out.collect()} == set(range(10))
