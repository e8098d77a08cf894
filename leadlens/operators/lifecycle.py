"""Train, log, select, save, reload and evaluate in one chain.

Everything that a later session needs lies under one folder:

    runs/        one append per model as soon as it is fitted: parameters, metrics, threshold
    best/        model, encoder and card of the model with the highest validation PR-AUC
    scores/      the best model's label and probability on the test rows
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import load_scorer, save_scorer
from .models import (evaluate_model, feature_importance, log_run, model_card, model_comparison, probability, select_best, train_one)


def save_results(spark: SparkSession, results: Sequence[dict], encoder, base: str) -> dict:
    """Log every result under ``base``/runs, save the best model with its card; returns the best."""
    for r in results:
        log_run(spark, r, f"{base}/runs")
    best = select_best(list(results))
    save_scorer(spark, f"{base}/best", best["model"], encoder, model_card(best))
    return best


def train_all_saved(spark: SparkSession, data: DataFrame, encoder, settings, base: str, names: Sequence[str],
                    seed: int = 42) -> DataFrame:
    """M7, M8: fit the models of ``names`` on ``data`` (features, label, split), log each, save the
    best; returns the comparison with ``selected``."""
    results = []
    for name in names:
        results.append(train_one(name, data, settings, seed))
        log_run(spark, results[-1], f"{base}/runs")
    best = select_best(results)
    save_scorer(spark, f"{base}/best", best["model"], encoder, model_card(best))
    return model_comparison(spark, results).withColumn("selected", F.col("name") == best["name"])


def evaluate_saved(spark: SparkSession, base: str, test: DataFrame) -> dict[str, DataFrame]:
    """M9: the metric tables of the saved best model on ``test`` (features, label), with feature
    importance; ``scores`` (label, p) is written under ``base`` and read back."""
    model, encoder, card = load_scorer(spark, f"{base}/best")
    probability(model, test).select("label", "p").write.mode("overwrite").parquet(f"{base}/scores")
    scores = spark.read.parquet(f"{base}/scores")
    tables = evaluate_model(model, test, card["tuned_threshold"], scores)
    tables["importance"] = feature_importance(model, encoder.feature_names())
    tables["scores"] = scores
    return tables


def logged(spark: SparkSession, base: str) -> DataFrame:
    """The run log: run, model, kind, key, value."""
    return spark.read.parquet(f"{base}/runs")
