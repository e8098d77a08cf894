"""Profiling aggregates (A1, A9-A12, D1-D4 helpers, L8).

Each operator is a single aggregation; multi-column profiles unpivot first and
group once instead of scanning the table once per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div


def _q(c: str):
    return F.col(f"`{c}`")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """A1: contingency table in long form (a, b, n) over complete cases."""
    return (df.where(_q(a).isNotNull() & _q(b).isNotNull())
              .groupBy(_q(a).alias(a), _q(b).alias(b)).agg(F.count("*").alias("n")))


def value_share(df: DataFrame, col: str, decimals: int | None = None) -> DataFrame:
    """Share of each value in percent (``value_counts(normalize=True) * 100``).

    The total is a scalar subquery (one number), not a window over all rows.
    """
    counts = df.groupBy(_q(col).alias(col)).agg(F.count("*").alias("n"))
    pct = F.col("n") * 100.0 / scalar(df, F.count("*"))
    if decimals is not None:
        pct = F.round(pct, decimals)
    return counts.select(col, "n", pct.alias("pct"))


def scalar(df: DataFrame, agg) -> object:
    """A one-value aggregate usable inside another query's expressions."""
    return df.select(agg).scalar()


def unpivot_strings(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids..., feature, value) with every listed column cast to string."""
    return df.select(*ids, *[_q(c).cast("string").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), "feature", "value")


def unknown_share(df: DataFrame, cols: Sequence[str] | None = None,
                  marker: str = "unknown", decimals: int = 2) -> DataFrame:
    """A10: percent of rows equal to ``marker`` per string column, kept when > 0."""
    from .cleaning import string_columns

    cols = list(cols) if cols is not None else string_columns(df)
    row = df.agg(*[F.avg(F.when(_q(c) == marker, 1.0).otherwise(0.0)).alias(c) for c in cols])
    long = row.unpivot([], cols, "feature", "share")
    return (long.where(F.col("share") > 0)
                .select("feature", F.round(F.col("share") * 100.0, decimals).alias("pct")))


def category_by_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Counts per (feature, value, target) for several columns in one pass."""
    return (unpivot_strings(df, cols, [target])
              .groupBy("feature", "value", target).agg(F.count("*").alias("n")))


def profile(df: DataFrame) -> DataFrame:
    """Column, dtype, non-null count and row count (``df.info()`` / shape)."""
    cols = df.columns
    row = df.agg(F.count("*").alias("__rows"),
                 *[F.count(_q(c)).alias(f"__nn{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                 F.col(f"__nn{i}").alias("non_null")) for i, c in enumerate(cols)]))
    return row.select(stacked.alias("s"), "__rows").select(
        "s.position", "s.column", "s.dtype", "s.non_null", F.col("__rows").alias("n_rows"))


def rate_by(df: DataFrame, key: str | object, target: str, decimals: int = 4,
            name: str | None = None) -> DataFrame:
    """Rows and positive rate per key (``groupBy(k).agg(avg(y))``)."""
    k = _q(key) if isinstance(key, str) else key
    name = name or (key if isinstance(key, str) else "bucket")
    return df.groupBy(k.alias(name)).agg(
        F.count("*").alias("n"),
        F.round(F.avg(_q(target).cast("double")), decimals).alias("rate"))


def capped_bucket(c: str, cap: int) -> object:
    """D2: '1', '2', ..., '<cap>+' from a count column."""
    col = _q(c)
    return F.when(col >= cap, F.lit(f"{cap}+")).otherwise(col.cast("string"))


def relative_rate(df: DataFrame, key: str, target: str, decimals: int = 4) -> DataFrame:
    """D3: group rate, overall rate and their ratio."""
    g = df.groupBy(_q(key).alias(key)).agg(
        F.count("*").alias("n"), F.sum(_q(target).cast("double")).alias("pos"))
    overall = scalar(df, F.avg(_q(target).cast("double")))
    rate = F.col("pos") / F.col("n")
    return g.select(key, "n", F.round(rate, decimals).alias("rate"),
                    F.round(overall, decimals).alias("overall_rate"),
                    F.round(safe_div(rate, overall), decimals).alias("relative"))


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First rows in a stated order (a deterministic ``head()``)."""
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """A fixed-size reproducible sample -- the n rows with the smallest
    md5(seed:id).  Planned as TakeOrderedAndProject (per-task top n, then merge)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), _q(id_col).cast("string")))
    return df.orderBy(key, _q(id_col)).limit(n)
