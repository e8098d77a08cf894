"""The training-data pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes every stage's rows as Parquet in the shared checkpoint folder and
reads them back, so a lost executor costs at most one stage.

Decisions reach rows by doc_id (a row's own number where doc_ids repeat) where a stage compares
documents, and row by row elsewhere, so rows with a null doc_id pass through near-duplicate removal
and are judged by all other stages; rows that repeat both doc_id and text are copies, of which one
stays, and rows that share only the doc_id are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import decontaminate, minhash, packing, pii, quality
from leadlens.llm.common import table
from leadlens.llm.tokenize import vocabulary_path
from leadlens.operators.ordered import ordered_scan
from leadlens.session import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  It learns from the labelled rows of
    ``docs`` outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.keep(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates: five-word shingles,
    similarity 0.8 or more."""
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return _drop_near_duplicates(docs, "doc_id")
    # rows that share a doc_id can differ in their text: each takes a number of its own, in doc_id's order
    apart = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    numbered = ordered_scan(apart, by=[], order=["doc_id", "text"], row_number="__number")
    return _drop_near_duplicates(numbered, "__number").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def _drop_near_duplicates(docs: DataFrame, key: str) -> DataFrame:
    found = minhash.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"), similarity=80)
    gone = materialize(found.filter("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "duplicates")
    return docs.join(gone.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = decontaminate.leaks(keyed.select(F.col("row_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = materialize(found.select(F.col("doc_id").alias("row_key")).distinct(), "leaks")
    return keyed.join(gone.hint("shuffle_hash"), "row_key", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows."""
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: Stages that learn models or compare sketches have no SQL; tests/llm/test_pipeline.py checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
