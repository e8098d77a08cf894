"""Cleaning and validation operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import map_values, recode_sentinel
from ..settings import Settings
from ..sources.files import CUSTOMER_SCHEMA

# request schema: the contact fields a request must carry, all required
CUSTOMER_FIELDS = [(f.name, f.dataType.simpleString()) for f in CUSTOMER_SCHEMA.fields]


def drop_leakage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the configured columns that are present (missing ones are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def clean(df: DataFrame, settings: Settings) -> DataFrame:
    """Load-time cleaning: drop leakage columns, recode the sentinel, map the target."""
    out = drop_leakage(df, settings.drop_cols)
    if settings.pdays_col in out.columns:
        out = out.withColumn(settings.pdays_col,
                             recode_sentinel(settings.pdays_col, settings.pdays_not_contacted,
                                             settings.pdays_fill_value))
    return out.withColumn(settings.target, map_values(settings.target, settings.target_map))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: select columns and drop rows with any NULL (or NaN) among them."""
    return df.select(*cols).dropna("any")


def string_columns(df: DataFrame) -> list[str]:
    """Names of string columns (schema only, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def drop_constant(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns among ``cols`` whose sample standard deviation is > 0.

    One aggregation pass for all columns; only k numbers reach the driver.
    """
    if not cols:
        return []
    row = df.agg(*[F.stddev_samp(F.col(f"`{c}`").cast("double")).alias(f"s{i}")
                   for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"s{i}"] is not None and row[f"s{i}"] > 0]


def require_non_empty(df: DataFrame, what: str = "Customer list") -> DataFrame:
    """Reject an empty batch (batch only; a stream is never 'empty')."""
    if df.isEmpty():
        raise ValueError(f"{what}: there is no row to work on")
    return df


def validate_customers(df: DataFrame, fields=CUSTOMER_FIELDS) -> DataFrame:
    """Per-row required-field and type check.

    Adds ``_errors array<string>`` (empty when the row is valid) and casts the
    fields to their declared types; a value that does not cast is an error, as is
    a missing column or NULL.  Split good and bad rows with ``size(_errors) = 0``.
    """
    checks = []
    casts = {}
    for name, typ in fields:
        if name not in df.columns:
            checks.append(F.lit(f"{name}: field required"))
            casts[name] = F.lit(None).cast(typ)
            continue
        src = F.col(f"`{name}`")
        cast = src.try_cast(typ) if typ != "string" else src.cast("string")
        if typ in ("double", "float"):
            cast = F.nanvl(cast, F.lit(None).cast(typ))
        casts[name] = cast
        checks.append(F.when(src.isNull(), F.lit(f"{name}: field required"))
                       .when(cast.isNull(), F.lit(f"{name}: not a valid {typ}")))
    errors = F.filter(F.array(*checks), lambda x: x.isNotNull())
    others = [F.col(f"`{c}`") for c in df.columns if c not in casts]
    return df.select(*others, *[v.alias(k) for k, v in casts.items()],
                     errors.alias("_errors"))


def active_features(df: DataFrame, id_col: str, feature_cols: Sequence[str],
                    limit: int = 10) -> DataFrame:
    """Per row, the first ``limit`` features (in column order) with value > 0."""
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"),
                               F.col(f"`{c}`").cast("double").alias("value"))
                      for i, c in enumerate(feature_cols)])
    kept = F.slice(F.filter(pairs, lambda s: s["value"] > 0), 1, limit)
    return (df.select(id_col, F.posexplode(kept).alias("rank0", "f"))
              .select(id_col, (F.col("rank0") + 1).alias("rank"),
                      F.col("f.feature").alias("feature"), F.col("f.value").alias("value")))


def split_valid(df: DataFrame, fields=CUSTOMER_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(valid rows without ``_errors``, invalid rows with their ``_errors``)."""
    checked = validate_customers(df, fields)
    good = checked.where(F.size("_errors") == 0).drop("_errors")
    bad = checked.where(F.size("_errors") > 0)
    return good, bad
