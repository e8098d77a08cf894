"""Structured Streaming paths.

* ``score_stream`` -- readStream -> the same ``score_rows`` expressions -> a
  Parquet sink with a checkpoint (exactly-once file sink), append mode.
* ``append_prediction_log`` -- the log append as a stream (T2).
* ``tier_counts_stream`` -- live tier counts.  Three keys, so the state is
  bounded without a watermark.  The totals live in the query's state store alone:
  there is no sink, and ``latest_tier_counts`` reads them from the checkpoint with
  the ``statestore`` source, so an epoch adds no table rows or files of its own.

Tests and the registered query drive them with ``trigger(availableNow=True)``
over a Parquet file source, which makes a stream run to completion
deterministically.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tier, utc_text
from ..operators.scoring import rejected_rows, score_rows
from ..session import is_file, scratch_path


def file_stream(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    """A Parquet file source over a folder (or one file, via a glob filter on its
    folder); the schema is read from the files when not given."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if is_file(spark, path):
        reader = reader.option("pathGlobFilter", path.rstrip("/").rsplit("/", 1)[-1])
        path = path.rstrip("/").rsplit("/", 1)[0]
    return reader.parquet(path)


def score_stream(stream: DataFrame, encoder, model, threshold: float, sink_path: str,
                 checkpoint: str, id_cols=(), available_now: bool = True):
    """Score valid records as they arrive; appends prediction records to Parquet."""
    out = score_rows(stream, encoder, model, threshold, id_cols=id_cols)
    out = out.withColumn("timestamp", F.current_timestamp()) \
             .withColumn("logged_at", utc_text("timestamp"))
    w = out.writeStream.format("parquet").option("path", sink_path) \
           .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def reject_stream(stream: DataFrame, encoder, sink_path: str, checkpoint: str, id_cols=(),
                  available_now: bool = True):
    """The error output of T1: ids and errors of the records that are not scored."""
    w = rejected_rows(stream, encoder, id_cols).writeStream.format("parquet").option("path", sink_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def append_prediction_log(records: DataFrame, sink_path: str, checkpoint: str,
                          available_now: bool = True):
    """A stream of log records appended to a Parquet table (exactly once)."""
    w = records.writeStream.format("parquet").option("path", sink_path) \
               .option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def state_session(spark: SparkSession, partitions: int = 4) -> SparkSession:
    """A session of the same application whose streams keep their state in ``partitions`` state-store
    partitions (fixed in a checkpoint when its query first starts); the given session's settings
    stay as they are."""
    other = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return other


def tier_counts_stream(stream: DataFrame, checkpoint: str, prob: str = "probability", available_now: bool = True):
    """Running counts per tier (high / medium / low), kept in the state under ``checkpoint``.

    The state holds three keys: start the stream from a :func:`state_session` to keep it in a few
    partitions instead of one per shuffle partition; map-side partial aggregation absorbs the
    volume.
    """
    pct = F.round(F.col(prob), 4) * 100
    named = stream.where(F.col(prob).isNotNull()).select(tier(pct).alias("tier"))
    counts = named.groupBy("tier").agg(F.count("*").alias("n"))
    w = counts.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_completion(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def tier_counts_from_table(spark: SparkSession, table_path: str, prob_expr,
                           base: str | None = None) -> DataFrame:
    """Run T3 over a Parquet table as a file stream and return its totals as a batch."""
    base = base or scratch_path(spark, "tier-stream")
    src = file_stream(state_session(spark), table_path).select(prob_expr.alias("probability"))
    run_to_completion(tier_counts_stream(src, os.path.join(base, "ckpt")))
    return latest_tier_counts(spark, os.path.join(base, "ckpt"))


def latest_tier_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Totals after the last epoch, from the state store under ``checkpoint``."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.tier").alias("tier"), F.col("value.count").alias("n"))
