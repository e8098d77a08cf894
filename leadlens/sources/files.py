"""File sources and sinks.

Everything goes through Spark readers and writers, so paths may be local folders
in tests or shared storage on a cluster.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.boosting import BoostedTrees
from ..operators.features import FeatureEncoder

# FX1: the raw contact table, declared instead of inferred
CONTACT_SCHEMA = T.StructType([
    T.StructField("age", T.IntegerType()), T.StructField("job", T.StringType()),
    T.StructField("marital", T.StringType()), T.StructField("education", T.StringType()),
    T.StructField("default", T.StringType()), T.StructField("housing", T.StringType()),
    T.StructField("loan", T.StringType()), T.StructField("contact", T.StringType()),
    T.StructField("month", T.StringType()), T.StructField("day_of_week", T.StringType()),
    T.StructField("duration", T.IntegerType()), T.StructField("campaign", T.IntegerType()),
    T.StructField("pdays", T.IntegerType()), T.StructField("previous", T.IntegerType()),
    T.StructField("poutcome", T.StringType()), T.StructField("emp.var.rate", T.DoubleType()),
    T.StructField("cons.price.idx", T.DoubleType()), T.StructField("cons.conf.idx", T.DoubleType()),
    T.StructField("euribor3m", T.DoubleType()), T.StructField("nr.employed", T.DoubleType()),
    T.StructField("y", T.StringType()),
])

# FX2: a scoring request is FX1 without duration and y
CUSTOMER_SCHEMA = T.StructType([f for f in CONTACT_SCHEMA.fields if f.name not in ("duration", "y")])


def read_contacts(spark: SparkSession, path: str, sep: str = ";",
                  schema: T.StructType = CONTACT_SCHEMA) -> DataFrame:
    """Delimited scan with a header and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def write_contacts_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """S3: one Parquet table partitioned by split (train / val / test)."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """One split; the partition filter prunes the other folders."""
    return spark.read.parquet(path).where(F.col(split_col) == split).drop(split_col)


def save_encoder(spark: SparkSession, encoder: FeatureEncoder, path: str) -> None:
    """Fitted encoder parameters and feature names as a one-row JSON text table."""
    spark.createDataFrame([(encoder.to_json(), json.dumps(encoder.feature_names()))],
                          "encoder string, feature_names string") \
         .coalesce(1).write.mode("overwrite").json(path)


def load_encoder(spark: SparkSession, path: str) -> FeatureEncoder:
    row = spark.read.json(path).first()
    return FeatureEncoder.from_json(row["encoder"])


def _exists(spark: SparkSession, path: str) -> bool:
    from ..session import path_exists

    return path_exists(spark, path)


def save_scorer(spark: SparkSession, base: str, model, encoder: FeatureEncoder, card: dict) -> None:
    """Model (Spark ML writer, or the boosted trees' own), encoder and model card under one folder."""
    if isinstance(model, BoostedTrees):
        model.save(spark, f"{base}/model")
    else:
        model.write().overwrite().save(f"{base}/model")
    save_encoder(spark, encoder, f"{base}/encoder")
    card = dict(card, model_class=type(model).__name__)
    spark.createDataFrame([(json.dumps(card),)], "card string").coalesce(1) \
         .write.mode("overwrite").text(f"{base}/card")


def load_scorer(spark: SparkSession, base: str):
    """(model, encoder, card); a missing artifact is an error naming it."""
    from pyspark.ml import classification

    for name in ("model", "encoder", "card"):
        if not _exists(spark, f"{base}/{name}"):
            raise FileNotFoundError(f"Missing artifact: {base}/{name}. Train and save a model first.")
    card = json.loads(spark.read.text(f"{base}/card").first()[0])
    if card["model_class"] == BoostedTrees.__name__:
        model = BoostedTrees.load(spark, f"{base}/model")
    else:
        model = getattr(classification, card["model_class"]).load(f"{base}/model")
    return model, load_encoder(spark, f"{base}/encoder"), card


def save_pipeline(base: str, encoder: FeatureEncoder, model) -> None:
    """Encoder and a Spark ML model as one ``PipelineModel`` under ``base``."""
    from pyspark.ml import PipelineModel

    from ..operators.encoder_stage import EncoderStage

    PipelineModel([EncoderStage(encoder=encoder), model]).write().overwrite().save(base)


def load_pipeline(spark: SparkSession, base: str):
    """The saved ``PipelineModel``: its ``transform`` takes raw contacts."""
    from pyspark.ml import PipelineModel

    if not _exists(spark, base):
        raise FileNotFoundError(f"Missing artifact: {base}. Save a pipeline first.")
    return PipelineModel.load(base)


def customers_of_json(df: DataFrame, col: str, schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """S6 on a column of JSON texts, each an object or an array of objects."""
    text = F.ltrim(F.col(col))
    many = F.from_json(text, T.ArrayType(schema))
    one = F.array(F.from_json(text, schema))
    return df.select(F.explode(F.when(F.startswith(text, F.lit("[")), many).otherwise(one)).alias("c")).select("c.*")


def read_customers_json(spark: SparkSession, text_or_path: str,
                        schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """Customers from inline JSON or a JSON file; a single object or an array
    of objects (a top-level array becomes one row per element)."""
    s = text_or_path.lstrip()
    if s.startswith("{") or s.startswith("["):
        return customers_of_json(spark.createDataFrame([(s,)], "j string"), "j", schema)
    return spark.read.schema(schema).option("multiLine", True).json(text_or_path)
