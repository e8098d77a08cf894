"""Prediction / research logs as tables (S8, S9, FX8).

The supplied ``events`` table stands in for the prediction log: probability =
``props.k / 100``, timestamp = ``ts``, newest-first order = (ts desc, event_id desc).
Appends go to a Parquet table in the shared checkpoint folder (or any path the
caller names); a stream of records uses ``streaming.append_prediction_log``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import utc_text
from .tables import read_table

PROBABILITY_SQL = "CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) / 100.0"


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, probability, label (purchase = 1)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "ts", "user_id", "event_type",
        (F.get_json_object("props", "$.k").cast("int").cast("double") / F.lit(100.0)).alias("probability"),
        (F.col("event_type") == "purchase").cast("int").alias("label"))


def log_records(inputs: DataFrame, outputs_struct_cols: list[str], input_cols: list[str],
                ts_col: str | None = None) -> DataFrame:
    """Shape rows as ``{input struct, output struct, timestamp, logged_at}``."""
    ts = F.col(ts_col) if ts_col else F.current_timestamp()
    return inputs.select(
        F.struct(*[F.col(f"`{c}`") for c in input_cols]).alias("input"),
        F.struct(*[F.col(c) for c in outputs_struct_cols]).alias("output"),
        ts.alias("timestamp"), utc_text(ts).alias("logged_at"))


def append_prediction_log(records: DataFrame, path: str) -> None:
    """Append prediction records (batch)."""
    records.write.mode("append").parquet(path)


def research_records(questions: DataFrame, query_col: str = "query",
                     answer_col: str = "answer", ts_col: str | None = None) -> DataFrame:
    ts = F.col(ts_col) if ts_col else F.current_timestamp()
    return questions.select(F.col(query_col).alias("query"), F.col(answer_col).alias("answer"),
                            ts.alias("timestamp"), utc_text(ts).alias("logged_at"))


def append_research_log(records: DataFrame, path: str) -> None:
    """Append research (question, answer) records."""
    records.write.mode("append").parquet(path)


# -- records without a schema ------------------------------------------------------


def variant_records(records: DataFrame, fields: list[str], ts_col: str | None = None) -> DataFrame:
    """JSON texts as VARIANT columns with the log's times.  Records of any shape go into one table;
    a text that is not JSON becomes NULL."""
    ts = F.col(ts_col) if ts_col else F.current_timestamp()
    return records.select(*[F.try_parse_json(F.col(f"`{c}`")).alias(c) for c in fields], ts.alias("timestamp"),
                          utc_text(ts).alias("logged_at"))


def log_field(column: str, path: str, kind: str, default=None):
    """A field of a VARIANT column; ``default`` where the record, the path or the type is missing."""
    found = F.try_variant_get(F.col(column), path, kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def variant_summary(log: DataFrame, column: str = "output", path: str = "$.probability_of_subscription",
                    cut: float = 0.5) -> DataFrame:
    """One row over records of any shape: records, those with a probability, positive ones, and the mean
    of the probabilities there are (0 without any)."""
    p = log_field(column, path, "double")
    return log.agg(F.count(F.lit(1)).alias("records"), F.count(p).alias("scored"),
                   F.sum(F.when(p >= cut, 1).otherwise(0)).cast("long").alias("positive"),
                   F.coalesce(F.round(F.avg(p), 6), F.lit(0.0)).alias("mean_probability"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
