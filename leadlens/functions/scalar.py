"""Column expressions shared by batch and streaming code paths.

Everything here is a plain Catalyst expression, so it stays inside whole-stage
codegen and behaves identically in ``score_batch`` and ``score_stream``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import (PDAYS_FILL_VALUE, PDAYS_NOT_CONTACTED, RECOMMEND_NO, RECOMMEND_YES,
                        TIER_HIGH, TIER_MEDIUM)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode_sentinel(c: Column | str, sentinel=PDAYS_NOT_CONTACTED, fill=PDAYS_FILL_VALUE) -> Column:
    """Replace a sentinel value (999 = never contacted) by the fill value."""
    c = _c(c)
    return F.when(c == F.lit(sentinel), F.lit(fill)).otherwise(c)


def map_values(c: Column | str, mapping: Mapping) -> Column:
    """Dictionary map; values outside the mapping become NULL."""
    c = _c(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr if expr is not None else F.lit(None)


def classify(p: Column | str, threshold: float | Column) -> Column:
    """1 when p >= threshold, else 0; NULL when p is NULL or NaN."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.nanvl(_c(p).cast("double"), F.lit(None).cast("double")) >= t).cast("int")


def recommendation(cls: Column | str) -> Column:
    """C11: recommendation text from the predicted class."""
    return F.when(_c(cls) == 1, F.lit(RECOMMEND_YES)).when(_c(cls) == 0, F.lit(RECOMMEND_NO))


def format_prediction(p: Column | str, threshold: float | Column) -> list[Column]:
    """The four-field prediction record; the class uses the unrounded p."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    cls = classify(p, t)
    known = F.nanvl(_c(p).cast("double"), F.lit(None).cast("double"))
    return [F.round(known, 4).alias("probability_of_subscription"),
            cls.alias("prediction_class"),
            recommendation(cls).alias("recommendation"),
            t.cast("double").alias("threshold_used")]


def tier(pct: Column | str) -> Column:
    """A23 key: high (>= 60 %), medium (>= 30 %), low."""
    pct = _c(pct)
    return F.when(pct >= TIER_HIGH, "high").when(pct >= TIER_MEDIUM, "medium").otherwise("low")


def lead_tier(pct: Column | str) -> Column:
    """Display name of the lead tier."""
    pct = _c(pct)
    return (F.when(pct >= TIER_HIGH, "High Priority")
             .when(pct >= TIER_MEDIUM, "Medium Priority").otherwise("Low Priority"))


def percent_text(pct: Column | str, decimals: int = 1) -> Column:
    """C14: ``f"{p:.1f}%"``."""
    return F.concat(F.format_string(f"%.{decimals}f", _c(pct).cast("double")), F.lit("%"))


def utc_text(ts: Column | str) -> Column:
    """``%Y-%m-%d %H:%M:%S UTC`` (session time zone is UTC)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss 'UTC'")


def iso_text(ts: Column | str) -> Column:
    """C4: ISO-8601 text with microseconds when present."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_iso(text: Column | str) -> Column:
    """ISO text with ``Z`` or an offset; naive text is taken as UTC."""
    t = F.regexp_replace(_c(text), "Z$", "+00:00")
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
                      F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")),
                      F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")))


def elapsed_seconds(ts: Column | str, now: Column | str) -> Column:
    """Whole seconds from ts to now, truncated like ``int(delta.total_seconds())``."""
    # microsecond difference without a detour through the session time zone
    micros = F.timestamp_diff("MICROSECOND", _c(ts), _c(now))
    return F.when(micros >= 0, F.floor(micros / 1_000_000)) \
            .otherwise(F.ceil(micros / 1_000_000)).cast("long")


def relative_time(ts: Column | str, now: Column | str) -> Column:
    """C7: 'just now' / '42s ago' / '5m ago' / '3h ago' / '2d ago' (floor division)."""
    s = elapsed_seconds(ts, now)
    return (F.when(s < 10, F.lit("just now"))
             .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
             .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
             .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
             .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago"))))


def json_field(c: Column | str, path: str) -> Column:
    """Nested field of a JSON text column; NULL when missing."""
    return F.get_json_object(_c(c), path)


def canonical_names(df: DataFrame, to: str = "underscore") -> DataFrame:
    """P10: ``emp.var.rate`` <-> ``emp_var_rate``."""
    if to == "underscore":
        mapping = {c: c.replace(".", "_") for c in df.columns if "." in c}
    else:
        dotted = {"emp_var_rate": "emp.var.rate", "cons_price_idx": "cons.price.idx",
                  "cons_conf_idx": "cons.conf.idx", "nr_employed": "nr.employed"}
        mapping = {c: dotted[c] for c in df.columns if c in dotted}
    return df.withColumnsRenamed(mapping) if mapping else df


def safe_div(num: Column, den: Column) -> Column:
    """Zero division -> 0 (the metric convention), ANSI-safe."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
