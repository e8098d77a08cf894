"""Binary-classification evaluation on (label, score) tables.

Every curve starts from one aggregation to distinct scores (map-side combined),
then takes running sums in descending score order with the skew-safe
``ordered_scan`` -- never a global single-task window over the rows.  Threshold
grids are handled by bucketing each score against the (literal) grid, so a
grid of g points costs one aggregation to g + 1 buckets, not g scans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..settings import ANALYSIS_GRID, THRESHOLD_GRID
from .ordered import ordered_scan
from .profiling import scalar


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def grid_points(start: float, stop: float, step: float) -> list[float]:
    """Same floats as ``numpy.arange(start, stop, step)``: start + i * ((start + step) - start)."""
    n = math.ceil((stop - start) / step)
    delta = (start + step) - start
    return [start + i * delta for i in range(n)]


def _prepared(df: DataFrame, label: str, score: str) -> DataFrame:
    """Label and score; a NaN score is unknown, like NULL, and never a positive."""
    s = F.nanvl(_q(score).cast("double"), F.lit(None).cast("double"))
    return df.select(_q(label).cast("int").alias("__y"), s.alias("__s"))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) per distinct score."""
    p = _prepared(df, label, score)
    return p.groupBy(F.col("__s").alias("score")).agg(
        F.sum("__y").cast("long").alias("pos"), F.sum(1 - F.col("__y")).cast("long").alias("neg"))


def cumulative_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, descending: score, pos, neg, cumulative tp/fp, the
    previous point's tp/fp (0 before the first) and the totals P and N."""
    counts = score_counts(df, label, score)
    s = ordered_scan(counts, by=[], order=[F.col("score").desc()],
                     running={"tp": "pos", "fp": "neg"})
    P = counts.select(F.sum("pos")).scalar()
    N = counts.select(F.sum("neg")).scalar()
    return s.select("score", "pos", "neg", "tp", "fp",
                    (F.col("tp") - F.col("pos")).alias("prev_tp"),
                    (F.col("fp") - F.col("neg")).alias("prev_fp"),
                    P.alias("P"), N.alias("N"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the origin with a
    NULL threshold (all intermediate points kept)."""
    c = cumulative_counts(df, label, score)
    pts = c.select(F.col("score").alias("threshold"),
                   safe_div(F.col("fp"), F.col("N")).alias("fpr"),
                   safe_div(F.col("tp"), F.col("P")).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) per distinct score, cut after full recall
    is first reached, plus the (precision 1, recall 0) end point with NULL threshold."""
    c = cumulative_counts(df, label, score)
    pts = (c.where(F.col("prev_tp") < F.col("P"))
            .select(F.col("score").alias("threshold"),
                    safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div(F.col("tp"), F.col("P")).alias("recall")))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)],
                                          "threshold double, precision double, recall double")
    return pts.unionByName(end)


def curve_areas(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: roc_auc (trapezoid, ties get half credit), average_precision
    (step sum of precision x recall increments) and pr_auc_trapezoid."""
    c = cumulative_counts(df, label, score)
    tpr, prev_tpr = safe_div(F.col("tp"), F.col("P")), safe_div(F.col("prev_tp"), F.col("P"))
    fpr, prev_fpr = safe_div(F.col("fp"), F.col("N")), safe_div(F.col("prev_fp"), F.col("N"))
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    prev_prec = F.when(F.col("prev_tp") + F.col("prev_fp") == 0, F.lit(1.0)) \
                 .otherwise(safe_div(F.col("prev_tp"), F.col("prev_tp") + F.col("prev_fp")))
    return c.agg(
        F.sum((fpr - prev_fpr) * (tpr + prev_tpr) / 2).alias("roc_auc"),
        F.sum((tpr - prev_tpr) * prec).alias("average_precision"),
        F.sum((tpr - prev_tpr) * (prec + prev_prec) / 2).alias("pr_auc_trapezoid"))


def confusion_matrix(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row tn, fp, fn, tp at ``score >= threshold``."""
    p = _prepared(df, label, score).withColumn("__p", (F.col("__s") >= F.lit(threshold)).cast("int"))
    return p.agg(
        F.sum(((F.col("__y") == 0) & (F.col("__p") == 0)).cast("long")).alias("tn"),
        F.sum(((F.col("__y") == 0) & (F.col("__p") == 1)).cast("long")).alias("fp"),
        F.sum(((F.col("__y") == 1) & (F.col("__p") == 0)).cast("long")).alias("fn"),
        F.sum(((F.col("__y") == 1) & (F.col("__p") == 1)).cast("long")).alias("tp"))


def _prf(tp: Column, fp: Column, fn: Column):
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    f1 = safe_div(2 * tp, 2 * tp + fp + fn)
    return precision, recall, f1


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float,
                   decimals: int = 4) -> DataFrame:
    """roc_auc, pr_auc (average precision), f1, precision, recall, accuracy."""
    cm = confusion_matrix(df, label, score, threshold)
    areas = curve_areas(df, label, score)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    precision, recall, f1 = _prf(tp, fp, fn)
    r = lambda c: F.round(c, decimals)
    return cm.select(
        r(areas.select("roc_auc").scalar()).alias("roc_auc"),
        r(areas.select("average_precision").scalar()).alias("pr_auc"),
        r(f1).alias("f1"), r(precision).alias("precision"), r(recall).alias("recall"),
        r(safe_div(tp + tn, tp + tn + fp + fn)).alias("accuracy"))


def classification_report(df: DataFrame, label: str, score: str, threshold: float,
                          decimals: int = 4) -> DataFrame:
    """Per-class precision / recall / f1 / support, accuracy, macro and
    weighted averages (rows '0', '1', 'accuracy', 'macro avg', 'weighted avg')."""
    cm = confusion_matrix(df, label, score, threshold)
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    p1, r1, f1 = _prf(tp, fp, fn)
    p0, r0, f0 = _prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    total = s0 + s1
    acc = safe_div(tp + tn, total)
    r = lambda c: F.round(c, decimals)
    row = lambda name, p, rc, f, s: F.struct(
        F.lit(name).alias("class"), r(p).alias("precision"), r(rc).alias("recall"),
        r(f).alias("f1_score"), s.cast("long").alias("support"))
    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", none, none, acc, total),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total),
        row("weighted avg", safe_div(p0 * s0 + p1 * s1, total), safe_div(r0 * s0 + r1 * s1, total),
            safe_div(f0 * s0 + f1 * s1, total), total))
    return cm.select(F.inline(rows))


def _grid_counts(df: DataFrame, label: str, score: str, grid: list[float]) -> DataFrame:
    """For each grid index i: threshold t_i and the confusion counts at score >= t_i.

    Each row is bucketed by how many grid points are <= its score (Spark ML's
    ``Bucketizer``: a binary search in the JVM), so one aggregation to
    len(grid)+1 buckets serves every threshold.  The bucket table is bounded by
    the grid size.
    """
    from pyspark.ml.feature import Bucketizer

    spark = df.sparkSession
    p = _prepared(df, label, score)
    # bucket b = number of grid points <= score (a JVM binary search per row)
    splits = [float("-inf")] + [float(t) for t in grid] + [float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="__s", outputCol="__b",
                          handleInvalid="keep").transform(p.where(F.col("__s").isNotNull()))
    buckets = bucketed.groupBy(F.col("__b").cast("int").alias("b")).agg(
        F.sum("__y").cast("long").alias("pos"), F.sum(1 - F.col("__y")).cast("long").alias("neg"))
    idx = spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)] + [(len(grid), None)],
                                "b int, t double")
    full = idx.join(F.broadcast(buckets), "b", "left").fillna(0, ["pos", "neg"])
    # suffix sums over at most len(grid)+1 rows
    w = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    P = F.sum("pos").over(Window.partitionBy())
    N = F.sum("neg").over(Window.partitionBy())
    s = full.select("b", "t", F.sum("pos").over(w).alias("tp_ge"),
                    F.sum("neg").over(w).alias("fp_ge"), P.alias("P"), N.alias("N"))
    # predicted positive at t_i <=> bucket > i, i.e. the suffix starting at b = i + 1
    nxt = s.select((F.col("b") - 1).alias("i"), F.col("tp_ge").alias("tp"),
                   F.col("fp_ge").alias("fp"), "P", "N")
    return idx.where(F.col("t").isNotNull()).select(F.col("b").alias("i"), "t").join(nxt, "i")


def threshold_curve(df: DataFrame, label: str, score: str, grid: tuple = ANALYSIS_GRID,
                    decimals: int | None = None) -> DataFrame:
    """Precision, recall and F1 at each grid threshold."""
    g = _grid_counts(df, label, score, grid_points(*grid))
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    precision, recall, f1 = _prf(tp, fp, fn)
    r = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    return g.select(F.col("t").alias("threshold"), r(precision).alias("precision"),
                    r(recall).alias("recall"), r(f1).alias("f1"))


def tune_threshold(df: DataFrame, label: str, score: str, grid: tuple = THRESHOLD_GRID) -> DataFrame:
    """Grid threshold with the highest F1; ties go to the lowest
    threshold, and when every F1 is 0 the threshold is 0.5.  One row:
    threshold, f1."""
    curve = threshold_curve(df, label, score, grid)
    best = curve.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(0.5)).alias("threshold"),
                       F.col("f1"))


def gains_curve(df: DataFrame, label: str, score: str, id_col: str, bins: int = 10,
                decimals: int = 4) -> DataFrame:
    """Rows ranked by score (desc, id asc) cut into ``bins`` equal-count bins;
    per bin: rows, positives, cumulative capture of positives and lift."""
    p = df.select(_q(id_col).alias("__id"), _q(label).cast("long").alias("__y"),
                  _q(score).cast("double").alias("__s"))
    ranked = ordered_scan(p, by=[], order=[F.col("__s").desc(), F.col("__id")], row_number="__rn")
    n = scalar(p, F.count("*"))
    total_pos = scalar(p, F.sum("__y"))
    binned = ranked.select(((F.col("__rn") - 1) * bins / n).cast("long").alias("bin0"), "__y", "__s")
    per = binned.groupBy((F.col("bin0") + 1).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("__y").alias("positives"),
        F.min("__s").alias("min_score"), F.max("__s").alias("max_score"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)   # <= bins rows
    cum_pos = F.sum("positives").over(w)
    cum_n = F.sum("n").over(w)
    base = total_pos / n
    return per.select(
        "bin", "n", "positives", "min_score", "max_score",
        cum_pos.alias("cum_positives"),
        F.round(safe_div(cum_pos, F.lit(1) * total_pos), decimals).alias("capture"),
        F.round(safe_div(cum_n, F.lit(1) * n), decimals).alias("population"),
        F.round(safe_div(safe_div(F.col("positives"), F.col("n")), base), decimals).alias("lift"))
