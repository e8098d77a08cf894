"""Multivariate statistics.

VIF and Pearson correlations need only k x k sums, computed in one aggregation
pass; the k x k algebra (k = number of features) runs on the driver.  Spearman
ranks distinct values with the skew-safe scan.  The logit summary is Spark ML's
binomial GLM.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cleaning import complete_cases, drop_constant


def _q(c):
    return F.col(f"`{c}`")


def gram_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Uncentred X'X over complete cases, one pass (k(k+1)/2 sums)."""
    k = len(features)
    x = complete_cases(df, features)
    aggs = [F.sum(_q(features[i]).cast("double") * _q(features[j]).cast("double")).alias(f"g{i}_{j}")
            for i in range(k) for j in range(i, k)]
    row = x.agg(*aggs).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def compute_vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factor per feature, sorted descending.

    No intercept is added, so each auxiliary regression is uncentred and
    VIF_i = (X'X)_ii * [(X'X)^-1]_ii.  Zero-variance columns are dropped first.
    """
    spark = df.sparkSession
    clean = complete_cases(df, features)
    kept = drop_constant(clean, features)
    schema = T.StructType([T.StructField("feature", T.StringType()),
                           T.StructField("vif", T.DoubleType())])
    if not kept:
        return spark.createDataFrame([], schema)
    g = gram_matrix(clean, kept)
    inv = np.linalg.pinv(g) if np.linalg.cond(g) > 1e15 else np.linalg.inv(g)
    vif = np.diag(g) * np.diag(inv)
    rows = [(f, float(v)) for f, v in zip(kept, vif)]
    return spark.createDataFrame(rows, schema).orderBy(F.desc("vif"))


def _long_matrix(spark: SparkSession, features: Sequence[str], m, decimals: int) -> DataFrame:
    rows = [(a, b, None if m[i][j] is None or np.isnan(m[i][j]) else round(float(m[i][j]), decimals))
            for i, a in enumerate(features) for j, b in enumerate(features)]
    schema = "feature_a string, feature_b string, corr double"
    return spark.createDataFrame(rows, schema)


def _pearson(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """k x k correlations in one aggregation; NaN in the row and column (diagonal included) of
    a column without variance."""
    k = len(names)
    aggs = [F.covar_pop(_q(names[i]), _q(names[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1, k)]
    aggs += [F.stddev_pop(_q(n)).alias(f"s{i}") for i, n in enumerate(names)]
    row = df.agg(*aggs).first()
    m = np.full((k, k), np.nan)
    varies = [row[f"s{i}"] is not None and row[f"s{i}"] > 0 for i in range(k)]
    for i in range(k):
        if varies[i]:
            m[i, i] = 1.0
        for j in range(i + 1, k):
            if varies[i] and varies[j]:
                m[i, j] = m[j, i] = row[f"c{i}_{j}"] / (row[f"s{i}"] * row[f"s{j}"])
    return m


def correlation_matrix(df: DataFrame, features: Sequence[str], method: str = "pearson",
                       decimals: int = 4) -> DataFrame:
    """Correlation matrix in long form (feature_a, feature_b, corr) over
    complete cases, rounded to ``decimals``; NULL where a column does not vary.

    pearson  -- one aggregation of covariances and deviations (numerically stable updates);
    spearman -- Pearson of average ranks (:func:`average_ranks`, skew-safe);
    kendall  -- tau-b from distributed inversion counts (:func:`kendall_tau_b`).
    """
    spark = df.sparkSession
    features = list(features)
    clean = complete_cases(df, features).select(*[_q(f).cast("double").alias(f) for f in features])
    k = len(features)
    if method == "pearson":
        return _long_matrix(spark, features, _pearson(clean, features), decimals)
    if method == "spearman":
        ranked = average_ranks(clean, features)
        return _long_matrix(spark, features, _pearson(ranked, [f"__r{i}" for i in range(k)]), decimals)
    if method == "kendall":
        from .kendall import tau_b_pairs

        pairs = [(features[i], features[j]) for i in range(k) for j in range(i + 1, k)]
        taus = tau_b_pairs(clean, pairs) if pairs else {}
        ends = clean.agg(*[f(_q(c)).alias(f"{n}{i}") for i, c in enumerate(features)
                           for n, f in (("lo", F.min), ("hi", F.max))]).first()
        m = np.full((k, k), np.nan)
        for i in range(k):
            if ends[f"lo{i}"] is not None and ends[f"lo{i}"] < ends[f"hi{i}"]:
                m[i, i] = 1.0
        for (a, b), v in taus.items():
            i, j = features.index(a), features.index(b)
            m[i, j] = m[j, i] = v
        return _long_matrix(spark, features, m, decimals)
    raise ValueError(f"unknown method {method!r}")


def average_ranks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``__r{i}``: the average rank (ties share the mean of their positions)
    of every feature value.  Values are counted first, so a value held by a third
    of the rows is one row of the rank table; ranks are running counts over the
    distinct values (skew-safe scan) and are attached by a join per column, which
    AQE turns into a broadcast when the rank table is small or splits when a key
    is skewed."""
    from .ordered import ordered_scan

    feats = list(features)
    long = df.select(*[_q(f).cast("double").alias(f"c{i}") for i, f in enumerate(feats)]) \
             .unpivot([], [f"c{i}" for i in range(len(feats))], "__f", "__val")
    counts = long.groupBy("__f", "__val").agg(F.count("*").alias("__n"))
    # one scan ranks every feature: running counts over each feature's distinct values
    scan = ordered_scan(counts, by=["__f"], order=["__val"], running={"__cum": "__n"})
    ranks = scan.select("__f", "__val", (F.col("__cum") - F.col("__n") + (F.col("__n") + 1) / 2.0)
                        .alias("__rank"))
    out = df
    for i, f in enumerate(feats):
        r = ranks.where(F.col("__f") == f"c{i}").select(F.col("__val"), F.col("__rank").alias(f"__r{i}"))
        out = out.join(r, _q(f).cast("double") == r["__val"]).drop("__val")
    return out


def kendall_tau_b(df: DataFrame, x: str, y: str) -> float:
    """Kendall's tau-b of two columns, exact, without enumerating pairs
    (two range-partitioned inversion-count passes, see ``operators.kendall``)."""
    from .kendall import tau_b

    return tau_b(df, x, y)


def logit_summary(df: DataFrame, features: Sequence[str], target: str,
                  max_iter: int = 100) -> DataFrame:
    """A5: binomial-logit fit with an intercept; term, coef, std_err, z, p_value.

    Spark's GLM summary reports the intercept last; it is listed first here as
    ``const``, as a statsmodels user expects.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    features = list(features)
    clean = complete_cases(df, features + [target]).select(
        *[_q(f).cast("double").alias(f.replace(".", "_")) for f in features],
        _q(target).cast("double").alias("__label"))
    names = [f.replace(".", "_") for f in features]
    vec = VectorAssembler(inputCols=names, outputCol="__features").transform(clean)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="__features",
                                      labelCol="__label", maxIter=max_iter, fitIntercept=True)
    model = glm.fit(vec)
    s = model.summary
    coefs = [model.intercept] + list(model.coefficients)
    se = [s.coefficientStandardErrors[-1]] + list(s.coefficientStandardErrors[:-1])
    pv = [s.pValues[-1]] + list(s.pValues[:-1])
    terms = ["const"] + features
    rows = [(t, float(c), float(e), float(c / e) if e else None, float(p))
            for t, c, e, p in zip(terms, coefs, se, pv)]
    return df.sparkSession.createDataFrame(
        rows, "term string, coef double, std_err double, z double, p_value double")
