"""Prediction-log analytics.

Latest-N reads are ``orderBy(...).limit(n)``, which Spark plans as
``TakeOrderedAndProject``: every task keeps its own top n, so only n rows per
task reach the final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import iso_text, lead_tier, relative_time, tier


def latest(df: DataFrame, n: int = 100, ts: str = "ts", tie: str = "event_id",
           cols: tuple = ()) -> DataFrame:
    """L1/L2: newest n rows (ts desc, tie desc), projected."""
    out = df.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    return out.select(*cols) if cols else out


def recent_activity(df: DataFrame, prob: str = "probability", ts: str = "ts",
                    tie: str = "event_id", n: int = 10) -> DataFrame:
    """L3: the ten newest log entries, those holding a probability, listed oldest
    first: probability x 100 (1 dp), ISO time."""
    top = latest(df, n, ts, tie).where(F.col(prob).isNotNull())
    return top.select(F.col(tie), F.round(F.col(prob) * 100, 1).alias("probability"),
                      iso_text(ts).alias("timestamp"), F.col(ts).alias("__ts")) \
              .orderBy(F.asc("__ts"), F.asc(tie)).drop("__ts")


def tier_distribution(df: DataFrame, prob: str = "probability") -> DataFrame:
    """Counts of high (>= 60 %), medium (>= 30 %) and low, on the 4-dp rounded
    probability times 100.  Always three rows."""
    pct = F.round(F.col(prob), 4) * 100
    row = df.where(F.col(prob).isNotNull()).agg(
        F.count(F.when(tier(pct) == "high", 1)).alias("high"),
        F.count(F.when(tier(pct) == "medium", 1)).alias("medium"),
        F.count(F.when(tier(pct) == "low", 1)).alias("low"))
    return row.unpivot([], ["high", "medium", "low"], "tier", "n")


def usage_summary(predictions: DataFrame, questions: DataFrame | None = None,
                  prob: str = "probability", ts: str = "ts", tie: str = "event_id",
                  window: int = 100) -> DataFrame:
    """Totals, average probability of the latest ``window`` predictions (x100,
    1 dp) and the tier counts among them.  One row."""
    last = latest(predictions, window, ts, tie).where(F.col(prob).isNotNull())
    pct = F.round(F.col(prob), 4) * 100
    stats = last.agg(
        F.round(F.avg(pct), 1).alias("avg_probability"),
        F.count(F.when(tier(pct) == "high", 1)).alias("tier_high"),
        F.count(F.when(tier(pct) == "medium", 1)).alias("tier_medium"),
        F.count(F.when(tier(pct) == "low", 1)).alias("tier_low"))
    total_q = questions.select(F.count("*")).scalar() if questions is not None else F.lit(0)
    return stats.select(
        predictions.select(F.count("*")).scalar().alias("total_predictions"),
        total_q.alias("total_questions"),
        F.coalesce(F.col("avg_probability"), F.lit(0.0)).alias("avg_probability"),
        "tier_high", "tier_medium", "tier_low")


def usage_record(predictions: DataFrame, questions: DataFrame, prob: str = "probability",
                 ts: str = "ts", tie: str = "event_id", text: str = "query",
                 asked: str = "ts", asked_tie: str = "question_id", window: int = 100, n: int = 10) -> DataFrame:
    """The whole analytics record as one row -- totals, average probability, a map of
    the tier counts, the ten newest predictions (oldest first) and the ten newest questions
    (newest first), each with its ISO time."""
    def listed(df, order, *cols):
        # at most n rows
        return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, *cols))),
                                  lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("x"))

    recent = latest(predictions, n, ts, tie).where(F.col(prob).isNotNull()).select(
        F.col(ts).alias("__o1"), F.col(tie).alias("__o2"), F.round(F.col(prob) * 100, 1).alias("probability"), iso_text(ts).alias("timestamp"))
    newest = latest(questions, n, asked, asked_tie).select(F.col(text).alias("query"), F.col(asked).alias("__o1"), F.col(asked_tie).alias("__o2"))
    place = F.row_number().over(Window.orderBy(F.desc("__o1"), F.desc("__o2")))  # at most n rows
    newest = newest.select(place.alias("__at"), "query", iso_text("__o1").alias("timestamp"))
    summary = usage_summary(predictions, questions, prob, ts, tie, window)
    return summary.select(
        F.lit(True).alias("available"), "total_predictions", "total_questions", "avg_probability",
        F.create_map(F.lit("high"), "tier_high", F.lit("medium"), "tier_medium", F.lit("low"), "tier_low").alias("tier_distribution"),
        listed(recent, ["__o1", "__o2"], "probability", "timestamp").scalar().alias("recent_activity"),
        listed(newest, ["__at"], "query", "timestamp").scalar().alias("recent_questions"))


def with_relative_time(df: DataFrame, ts: str = "ts", now=None) -> DataFrame:
    """C7 applied to a log; ``now`` defaults to the newest timestamp in the log
    (a scalar subquery), which keeps results reproducible."""
    now_col = now if now is not None else df.select(F.max(ts)).scalar()
    return df.withColumn("age", relative_time(ts, now_col))


def with_tier_labels(df: DataFrame, prob: str = "probability") -> DataFrame:
    """Lead tier display name and percent text."""
    pct = F.col(prob) * 100
    return df.withColumn("lead_tier", lead_tier(pct)) \
             .withColumn("percent", F.concat(F.format_string("%.1f", pct), F.lit("%")))
