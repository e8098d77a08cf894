"""Scoring (Q1-Q5) and linear attributions.

``score_rows`` is a pure DataFrame transformation -- validation, sentinel recode,
encoder expressions, ``model.transform``, prediction record -- so the very same
function scores a batch and a stream (``streaming.score_stream``).  Rows that lack a field
of the encoder or hold a value of the wrong type are never scored: ``rejected_rows`` lists
them with their errors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import format_prediction, recode_sentinel
from .cleaning import require_non_empty, validate_customers
from .features import FeatureEncoder
from .models import assemble


class LinearScorer:
    """A logistic model given by its coefficients (from a card, a table or another system); scores like
    a fitted Spark ML classifier, in the JVM alone."""

    def __init__(self, coefficients: Sequence[float], intercept: float):
        self.coefficients, self.intercept = [float(c) for c in coefficients], float(intercept)

    def transform(self, df: DataFrame, features_col: str = "features") -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        terms = F.zip_with(vector_to_array(features_col), F.array(*[F.lit(c) for c in self.coefficients]), lambda x, c: x * c)
        p = 1 / (1 + F.exp(-(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + F.lit(self.intercept))))
        return df.withColumn("probability", array_to_vector(F.array(1 - p, p)))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Q5: fill fields a form omits -- missing columns are added, NULLs coalesced."""
    out = df
    for c, v in defaults.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(v)))
        else:
            out = out.withColumn(c, F.lit(v))
    return out


def request_fields(encoder: FeatureEncoder) -> list[tuple[str, str]]:
    """The fields that a row must carry to be scored, with their types."""
    return ([(c, "double") for c in encoder.numerical]
            + [(c, "string") for c in [*encoder.ordinal, *encoder.nominal]])


def _checked(df: DataFrame, encoder: FeatureEncoder) -> DataFrame:
    """``df`` with its fields checked (column ``_errors``), its own columns untouched."""
    fields = request_fields(encoder)
    names = [f"__in{i}" for i in range(len(df.columns))]
    copy = df.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    checked = validate_customers(copy, fields)
    return checked.select(*[F.col(n).alias(c) for c, n in zip(df.columns, names)], "_errors")


def rejected_rows(df: DataFrame, encoder: FeatureEncoder, id_cols: Sequence[str] = ()) -> DataFrame:
    """Ids and ``errors`` of the rows that ``score_rows`` leaves out."""
    bad = _checked(df, encoder).where(F.size("_errors") > 0)
    return bad.select(*id_cols, F.col("_errors").alias("errors"))


def score_batch(df: DataFrame, encoder: FeatureEncoder, model, threshold: float, **kw) -> DataFrame:
    """Q1/Q2: ``score_rows`` on a batch; an empty batch is an error."""
    return score_rows(require_non_empty(df, "scoring"), encoder, model, threshold, **kw)


def score_rows(df: DataFrame, encoder: FeatureEncoder, model, threshold: float,
               id_cols: Sequence[str] = (), pdays_col: str | None = "pdays",
               sentinel: int = 999, fill: int = -1) -> DataFrame:
    """Ids + probability_of_subscription, prediction_class, recommendation, threshold_used of
    the valid rows.  A single row is just a one-row DataFrame (no second path)."""
    from pyspark.ml.functions import vector_to_array

    x = _checked(df, encoder).where(F.size("_errors") == 0).drop("_errors")
    if pdays_col and pdays_col in x.columns:
        x = x.withColumn(pdays_col, recode_sentinel(pdays_col, sentinel, fill))
    enc = encoder.transform(x, keep=list(id_cols))
    vec = assemble(enc.withColumn("__y", F.lit(0)), encoder.feature_names(), "__y")
    scored = model.transform(vec).withColumn("__p", vector_to_array("probability")[1])
    return scored.select(*id_cols, *format_prediction("__p", threshold))


def linear_attributions(df: DataFrame, encoder: FeatureEncoder, coefficients: Sequence[float],
                        intercept: float, background_means: Mapping[str, float],
                        id_col: str) -> DataFrame:
    """M10 (linear models, exact): attribution_i = coef_i * (x_i - mean_i) in the
    margin (log-odds) space; base = intercept + sum(coef_i * mean_i), so
    base + sum(attribution) = margin.  Long form: id, feature, value, attribution."""
    names = encoder.feature_names()
    enc = encoder.transform(df, keep=[id_col])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value"),
                               (F.lit(float(c)) * (F.col(f"`{n}`") - F.lit(float(background_means[n]))))
                               .alias("attribution"))
                      for n, c in zip(names, coefficients)])
    return enc.select(id_col, F.inline(pairs))


def attribution_base(coefficients: Sequence[float], intercept: float, names: Sequence[str],
                     background_means: Mapping[str, float]) -> float:
    return float(intercept + sum(c * background_means[n] for n, c in zip(names, coefficients)))


def attribution_rank(attr: DataFrame, top_n: int | None = None) -> DataFrame:
    """Mean |attribution| per feature, descending (global importance)."""
    out = attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution")) \
              .orderBy(F.desc("mean_abs_attribution"), "feature")
    return out.limit(top_n) if top_n else out


def attribution_dependence(attr: DataFrame, id_col: str, feature: str, other: str) -> DataFrame:
    """Per row, the feature value, its attribution and the interacting feature's value, in
    one pass over the attributions."""
    def of(name, column):
        return F.max(F.when(F.col("feature") == name, F.col(column)))

    return attr.where(F.col("feature").isin(feature, other)).groupBy(id_col).agg(
        of(feature, "value").alias(feature), of(feature, "attribution").alias("attribution"), of(other, "value").alias(other))


def explain_row(attr: DataFrame, id_col: str, row_id) -> DataFrame:
    """All contributions of one row ordered by absolute size."""
    return attr.where(F.col(id_col) == row_id).orderBy(F.desc(F.abs("attribution")), "feature")


def score_and_log(df: DataFrame, encoder: FeatureEncoder, model, threshold: float,
                  input_cols: Sequence[str], log_path: str | None = None,
                  id_cols: Sequence[str] = ()) -> DataFrame:
    """Q3: score, and append the log records {input, output, timestamp, logged_at}
    when ``log_path`` is given (single-request logging in the original)."""
    from ..functions.scalar import utc_text

    keep = list(dict.fromkeys(list(id_cols) + list(input_cols)))
    scored = score_batch(df, encoder, model, threshold, id_cols=keep)
    out_cols = ["probability_of_subscription", "prediction_class", "recommendation", "threshold_used"]
    if log_path:
        ts = F.current_timestamp()
        rec = scored.select(F.struct(*[F.col(f"`{c}`") for c in input_cols]).alias("input"),
                            F.struct(*out_cols).alias("output"), ts.alias("timestamp"),
                            utc_text(ts).alias("logged_at"))
        rec.write.mode("append").parquet(log_path)
    return scored.select(*id_cols, *out_cols)
