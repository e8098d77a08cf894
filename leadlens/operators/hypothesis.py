"""Hypothesis tests per feature.

All features of one kind are tested in one pass: numeric columns are aggregated as
they are by target (count, mean, sample variance), categorical ones are unpivoted to
(feature, value, target) for their cell counts.  The per-feature
closed forms then run on a table with one row per feature, and only the
p-values go through a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_pvalue, f_pvalue, t_pvalue
from .profiling import unpivot_strings


def group_moments(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, target, n, mean, var) with the sample variance (ddof = 1): one aggregation by target
    over the columns as they are, then one row per feature and target."""
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f"`{f}`").cast("double")
        x = F.when(~F.isnan(x), x)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}")]
    wide = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").alias(target)).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var"))
                     for i, f in enumerate(features)])
    return wide.select(F.col(f"`{target}`"), F.inline(rows)).where(F.col("n") > 0).select("feature", F.col(f"`{target}`"), "n", "mean", "var")


def welch_statistics(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A3 without p-values: Welch's t (group0 - group1, groups ordered by target
    ascending), Welch-Satterthwaite degrees of freedom and the group means."""
    m = group_moments(df, features, target)
    s = F.struct("n", "mean", "var")
    per = m.groupBy("feature").agg(F.count("*").alias("n_groups"),
                                   F.min_by(s, F.col(target)).alias("g0"),
                                   F.max_by(s, F.col(target)).alias("g1"))
    a = F.try_divide(F.col("g0.var"), F.col("g0.n"))
    b = F.try_divide(F.col("g1.var"), F.col("g1.n"))
    se2 = a + b
    t = F.try_divide(F.col("g0.mean") - F.col("g1.mean"), F.sqrt(se2))
    dof = F.try_divide(se2 * se2, F.try_divide(a * a, F.col("g0.n") - 1)
                       + F.try_divide(b * b, F.col("g1.n") - 1))
    two = F.col("n_groups") == 2
    return per.select(
        "feature", "n_groups",
        F.when(two, F.col("g0.n")).alias("n0"), F.when(two, F.col("g1.n")).alias("n1"),
        F.when(two, F.round("g0.mean", 4)).alias("mean_group0"),
        F.when(two, F.round("g1.mean", 4)).alias("mean_group1"),
        F.when(two, t).alias("t_raw"), F.when(two, dof).alias("dof"),
        F.when(~two, F.lit(f"two groups are compared, but {target} does not have two values"))
         .alias("error"))


def welch_t_test(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A3: feature, t_statistic (4 dp), p_value, dof, mean_group0/1, significant, error."""
    st = welch_statistics(df, features, target)
    p = t_pvalue(F.col("t_raw"), F.col("dof"))
    return st.select("feature", F.round("t_raw", 4).alias("t_statistic"),
                     p.alias("p_value"), "dof", "mean_group0", "mean_group1",
                     (p < 0.05).alias("significant"), "error")


def anova_statistics(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """A4 without p-values: F from per-group (n, mean, var); SSB uses the grand mean."""
    m = group_moments(df, features, group)
    w = Window.partitionBy("feature")           # rows here = features x groups, not data rows
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    parts = m.select("feature", "n", (F.col("n") * (F.col("mean") - grand) ** 2).alias("ssb"),
                     ((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw"))
    agg = parts.groupBy("feature").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"),
                                       F.sum("ssb").alias("ssb"), F.sum("ssw").alias("ssw"))
    d1 = F.col("n_groups") - 1
    d2 = F.col("n") - F.col("n_groups")
    f = F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))
    return agg.select("feature", "n_groups", d1.alias("df_between"), d2.alias("df_within"),
                      f.alias("f_raw"))


def anova_test(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """A4: feature, f_statistic (4 dp), p_value, n_groups, significant."""
    st = anova_statistics(df, features, group)
    p = f_pvalue(F.col("f_raw"), F.col("df_between"), F.col("df_within"))
    return st.select("feature", F.round("f_raw", 4).alias("f_statistic"), p.alias("p_value"),
                     "n_groups", (p < 0.05).alias("significant"))


def chi2_statistics(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A2 without p-values: chi-square of independence per feature over the full
    r x c contingency table (zero cells included), Yates-corrected when dof = 1."""
    long = (unpivot_strings(df, features, [target])
            .where(F.col("value").isNotNull() & F.col(target).isNotNull()))
    cells = long.groupBy("feature", "value", target).agg(F.count("*").alias("o"))
    rows = cells.groupBy("feature", "value").agg(F.sum("o").alias("row_n"))
    cols = cells.groupBy("feature", target).agg(F.sum("o").alias("col_n"))
    tot = cells.groupBy("feature").agg(F.sum("o").alias("N"),
                                       F.count_distinct("value").alias("r"),
                                       F.count_distinct(target).alias("c"))
    grid = (rows.join(cols, "feature").join(tot, "feature")
                .join(cells, ["feature", "value", target], "left")
                .select("feature", "r", "c",
                        F.coalesce(F.col("o"), F.lit(0)).cast("double").alias("o"),
                        (F.col("row_n") * F.col("col_n") / F.col("N")).alias("e")))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    dev = F.abs(F.col("o") - F.col("e"))
    dev = F.when(dof == 1, F.greatest(dev - 0.5, F.lit(0.0))).otherwise(dev)
    terms = grid.select("feature", dof.alias("dof"), (dev * dev / F.col("e")).alias("term"))
    return terms.groupBy("feature").agg(
        F.first("dof").alias("dof"),
        F.when(F.first("dof") == 0, F.lit(0.0)).otherwise(F.sum("term")).alias("chi2_raw"))


def chi_squared_test(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A2: feature, chi2 (4 dp), p_value, dof, significant."""
    st = chi2_statistics(df, features, target)
    p = chi2_pvalue(F.col("chi2_raw"), F.col("dof"))
    return st.select("feature", F.round("chi2_raw", 4).alias("chi2"), p.alias("p_value"),
                     F.col("dof").cast("int").alias("dof"), (p < 0.05).alias("significant"))


def summarise_features(df: DataFrame, numerical: Sequence[str], categorical: Sequence[str],
                       target: str) -> DataFrame:
    """One row per feature -- Welch t for numerical, chi-square for categorical --
    failures kept as rows with ``error``, sorted by p-value (failures last)."""
    parts = []
    if numerical:
        t = welch_t_test(df, numerical, target)
        parts.append(t.select("feature", F.lit("numerical").alias("type"),
                              F.col("t_statistic").alias("statistic"), "p_value",
                              "significant", "error"))
    if categorical:
        c = chi_squared_test(df, categorical, target)
        parts.append(c.select("feature", F.lit("categorical").alias("type"),
                              F.col("chi2").alias("statistic"), "p_value", "significant",
                              F.lit(None).cast("string").alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.asc_nulls_last("p_value"), "type", "feature")
