"""Sources and sinks: CSV, JSON (object or array), splits, encoder and scorer artifacts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leadlens.operators.features import FeatureEncoder, build_features
from leadlens.settings import Settings
from leadlens.sources import files


_DOMAINS = {"job": ["admin.", "technician", "retired"], "marital": ["single", "married", "divorced"],
            "education": ["basic.4y", "high.school", "unknown"], "default": ["no", "unknown"], "housing": ["yes", "no"],
            "loan": ["yes", "no"], "contact": ["telephone", "cellular"], "month": ["jun", "nov", "mar"],
            "day_of_week": ["wed", "fri"], "poutcome": ["failure", "success"]}


def _bank_rows(n=60, seed=17):
    """Rows drawn from the columns' domains: a third has an earlier contact, a quarter says yes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = {}
        for f in files.CONTACT_SCHEMA.fields:
            if f.name in _DOMAINS:
                row[f.name] = rng.choice(_DOMAINS[f.name])
            elif f.dataType.simpleString() == "int":
                row[f.name] = rng.randint(18, 90)
            else:
                row[f.name] = round(rng.uniform(-50, 5000), 3)
        row["pdays"] = 999 if i % 3 else rng.randint(0, 19)
        row["y"] = "yes" if i % 4 == 0 else "no"
        rows.append(row)
    return rows


def test_csv_scan_with_declared_schema(spark, tmp_path):
    rows = _bank_rows()
    header = ";".join(f.name for f in files.CONTACT_SCHEMA.fields)
    lines = [header] + [";".join(str(r[f.name]) for f in files.CONTACT_SCHEMA.fields) for r in rows]
    p = tmp_path / "bank.csv"
    p.write_text("\n".join(lines))
    df = files.read_contacts(spark, str(p))
    assert df.count() == 60 and df.schema["emp.var.rate"].dataType.simpleString() == "double"
    assert df.where(F.col("pdays") == 999).count() == 40


def test_json_object_and_array(spark, tmp_path):
    one = {k: v for k, v in _bank_rows()[0].items() if k not in ("duration", "y")}
    assert files.read_customers_json(spark, json.dumps(one)).count() == 1
    assert files.read_customers_json(spark, json.dumps([one, one, one])).count() == 3
    p = tmp_path / "c.json"
    p.write_text(json.dumps([one, one]))
    df = files.read_customers_json(spark, str(p))
    assert df.count() == 2 and df.first()["nr.employed"] == one["nr.employed"]


def test_build_features_and_split_files(spark, tmp_path):
    rows = _bank_rows()
    df = spark.createDataFrame([tuple(r[f.name] for f in files.CONTACT_SCHEMA.fields) for r in rows],
                               files.CONTACT_SCHEMA).withColumn("cid", F.monotonically_increasing_id())
    settings = Settings(numerical=("age", "pdays"), categorical=("job", "education"), smote_k=3)
    out = str(tmp_path / "splits")
    enc, encoded = build_features(df, settings, "cid", out_path=out)
    assert enc.feature_names()[:3] == ["num__age", "num__pdays", "ord__education"]
    train = files.read_split(spark, out, "train")
    counts = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    assert counts[0] == counts[1]                       # SMOTE balanced the train split
    assert files.read_split(spark, out, "test").where("synthetic").count() == 0
    assert "duration" not in encoded.columns


def test_encoder_and_scorer_round_trip(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    from leadlens.operators import models, scoring

    df = spark.createDataFrame([(float(i), ["a", "b"][i % 2], i % 2) for i in range(50)], "x double, c string, y int")
    enc = FeatureEncoder(numerical=["x"], nominal=["c"]).fit(df)
    files.save_encoder(spark, enc, str(tmp_path / "enc"))
    assert files.load_encoder(spark, str(tmp_path / "enc")).to_json() == enc.to_json()
    model = LogisticRegression(maxIter=10).fit(models.assemble(enc.transform(df, keep=["y"]), enc.feature_names()))
    files.save_scorer(spark, str(tmp_path / "scorer"), model, enc, {"tuned_threshold": 0.5})
    m2, e2, card = files.load_scorer(spark, str(tmp_path / "scorer"))
    a = scoring.score_batch(df, enc, model, 0.5).collect()
    b = scoring.score_batch(df, e2, m2, card["tuned_threshold"]).collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        files.load_scorer(spark, str(tmp_path / "missing"))


def test_score_and_log_appends_records(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegression

    from leadlens.operators import models, scoring

    df = spark.createDataFrame([(i, float(i), ["a", "b"][i % 2], i % 2) for i in range(20)],
                               "id long, x double, c string, y int")
    enc = FeatureEncoder(numerical=["x"], nominal=["c"]).fit(df)
    model = LogisticRegression(maxIter=10).fit(models.assemble(enc.transform(df, keep=["y"]), enc.feature_names()))
    log = str(tmp_path / "log")
    out = scoring.score_and_log(df, enc, model, 0.5, ["x", "c"], log, id_cols=["id"])
    assert out.count() == 20 and set(out.columns) >= {"id", "prediction_class", "recommendation"}
    logged = spark.read.parquet(log)
    assert logged.count() == 20
    assert set(logged.select("input.*").columns) == {"x", "c"}
    assert logged.where(F.col("output.threshold_used") == 0.5).count() == 20
