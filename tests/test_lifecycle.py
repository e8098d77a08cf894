"""The chain train -> log -> select -> save -> reload -> evaluate, with metrics recomputed in SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from leadlens.operators import lifecycle, models
from leadlens.operators.features import FeatureEncoder
from leadlens.settings import Settings

from .conftest import SF_SMALL

METRICS_SQL = """
WITH s AS (SELECT label, p, p >= {t} AS hit FROM read_parquet('{path}/*.parquet')),
c AS (SELECT count(*) FILTER (WHERE hit AND label = 1) AS tp, count(*) FILTER (WHERE hit AND label = 0) AS fp,
             count(*) FILTER (WHERE NOT hit AND label = 1) AS fn, count(*) FILTER (WHERE NOT hit AND label = 0) AS tn FROM s),
r AS (SELECT label, p, (SELECT count(*) FROM s q WHERE q.label = 0 AND q.p < s.p)
             + 0.5 * (SELECT count(*) FROM s q WHERE q.label = 0 AND q.p = s.p) AS below FROM s)
SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, tp / (tp + fn) AS recall,
       2 * tp / (2 * tp + fp + fn) AS f1,
       (SELECT sum(below) FROM r WHERE label = 1) / ((tp + fn) * (fp + tn)) AS roc_auc
FROM c"""


def _data(spark):
    rng = np.random.default_rng(7)
    n = 500
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(scale=0.8, size=n) > 0.8).astype(int)
    split = np.where(np.arange(n) % 10 < 7, "train", np.where(np.arange(n) % 10 < 8, "val", "test"))
    raw = spark.createDataFrame([(i, *map(float, a), int(t), str(s)) for i, (a, t, s) in enumerate(zip(x, y, split))],
                                "id long, a double, b double, c double, y int, split string")
    enc = FeatureEncoder(numerical=["a", "b", "c"]).fit(raw.where("split = 'train'"))
    return enc, models.assemble(enc.transform(raw, keep=["id", "split", "y"]), enc.feature_names(), "y").cache()


@pytest.mark.parametrize("names", [["LogisticRegression", "LightGBM"], ["XGBoost"]])
def test_saved_best_model_is_evaluated_from_its_files(spark, tmp_path, names):
    enc, data = _data(spark)
    s = Settings()
    p = s.models
    small = s.with_(models=type(p)(logistic_regression=dict(p.logistic_regression, max_iter=30), random_forest=p.random_forest,
                                   xgboost=dict(p.xgboost, n_estimators=5), lightgbm=dict(p.lightgbm, n_estimators=5)))
    base = str(tmp_path / "life")
    table = lifecycle.train_all_saved(spark, data, enc, small, base, names).collect()
    assert [r["name"] for r in table] == names and sum(r["selected"] for r in table) == 1
    best = next(r for r in table if r["selected"])
    assert best["val_pr_auc"] == max(r["val_pr_auc"] for r in table)
    log = lifecycle.logged(spark, base)
    assert {r[0] for r in log.select("model").distinct().collect()} == set(names)
    tables = lifecycle.evaluate_saved(spark, base, data.where(F.col("split") == "test"))
    got = tables["metrics"].first().asDict()
    t = best["threshold"]
    want = duckdb.connect().execute(METRICS_SQL.format(t=t, path=f"{base}/scores")).df().iloc[0]
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=5.1e-5), name  # four decimals
    for name in ("roc_auc", "pr_auc", "f1"):
        assert got[name] == pytest.approx(best[f"test_{name}"], abs=1e-9)
    assert tables["importance"].count() == 3 and tables["scores"].count() == 100


def test_queries_agree_with_the_log(spark):
    q = entry_mod.queries()
    rows = q["train_all_saved"](spark, SF_SMALL).collect()
    assert {r["agrees"] for r in rows} == {True, None} and sum(r["agrees"] is True for r in rows) == 3
    assert len({r["model"] for r in rows if r["saved"]}) == 1
    found = {(r["part"], r["key"]): r["value"] for r in q["evaluate_saved"](spark, SF_SMALL).collect()}
    for key in ("accuracy", "f1", "pr_auc", "roc_auc"):
        assert found["metrics", key] == pytest.approx(found["logged", key], abs=1e-9)
    assert any(part == "importance" for part, _ in found)


def test_queries_outlive_a_cleaned_scratch_folder(spark):
    from leadlens.session import cleanup_scratch

    q = entry_mod.queries()
    before = q["train_leaf_wise"](spark, SF_SMALL).count()
    cleanup_scratch(spark)
    assert q["train_leaf_wise"](spark, SF_SMALL).count() == before
    assert q["train_all_saved"](spark, SF_SMALL).where("agrees").count() == 3
    assert q["tree_attribution_rank"](spark, SF_SMALL).count() == 37


def test_every_held_out_row_is_scored_once(spark, tmp_path, monkeypatch):
    met, real = spark.sparkContext.accumulator(0), models.probability

    def counted(model, df):
        @F.udf("double")
        def seen(p):
            met.add(1)
            return p
        return real(model, df).withColumn("p", seen("p"))

    for module in (models, lifecycle):
        monkeypatch.setattr(module, "probability", counted)
    enc, data = _data(spark)
    base = str(tmp_path / "life")
    lifecycle.train_all_saved(spark, data, enc, Settings(), base, ["LogisticRegression"])
    assert met.value == 50 + 100
    tables = lifecycle.evaluate_saved(spark, base, data.where(F.col("split") == "test"))
    for name in ("metrics", "confusion", "roc", "report"):
        assert tables[name].count()
    assert met.value == 50 + 100 + 100
