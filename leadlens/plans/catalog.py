"""Registered queries: one Spark plan per operator family, each with a DuckDB
oracle where the result is expressible in SQL.

Every query reads the supplied tables (or data Spark derives from them) in full.
Binding of the reference's roles to the tables (FIXTURES FX7-FX9):
``contacts`` view for the contact table, ``events`` as the prediction log
(probability = props.k / 100, label = purchase), ``conversations`` for chat and
research questions, ``documents`` / ``embeddings`` for retrieval.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import format_prediction, lead_tier, percent_text
from ..operators import cleaning, features, hypothesis, logs, metrics, multivariate, profiling
from ..settings import (CONTACTS_CATEGORICAL, CONTACTS_NUMERICAL, PRIORITY_ORDER, RECOMMEND_NO,
                        RECOMMEND_YES, contacts_settings)
from ..session import materialize
from ..sources.logs import PROBABILITY_SQL, prediction_log
from ..sources.tables import CONTACTS_SQL, contacts, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NUM = list(CONTACTS_NUMERICAL)
CAT = list(CONTACTS_CATEGORICAL)
SEED = 42


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def clean_contacts(spark: SparkSession, sf: str, history: bool = True) -> DataFrame:
    return cleaning.clean(contacts(spark, sf, history), contacts_settings())


# --- shared SQL fragments ------------------------------------------------------
WITH_CONTACTS = f"WITH contacts AS ({CONTACTS_SQL})"
CLEAN_CTE = f"""{WITH_CONTACTS},
clean AS (
  SELECT contact_id, customer_id, segment, region, priority, month, day_of_week,
         total_price, acct_balance, previous,
         CAST(CASE WHEN pdays = 999 THEN -1 ELSE pdays END AS INTEGER) AS pdays,
         poutcome,
         CAST(CASE WHEN y = 'yes' THEN 1 WHEN y = 'no' THEN 0 END AS INTEGER) AS y
  FROM contacts)"""
LOG_CTE = f"""WITH plog AS (
  SELECT event_id, ts, user_id, event_type, {PROBABILITY_SQL} AS probability,
         CAST(event_type = 'purchase' AS INTEGER) AS label
  FROM events)"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _num_long(table: str, cols: list[str], key: str) -> str:
    return _union([f"SELECT '{c}' AS feature, {key}, CAST({c} AS DOUBLE) AS value FROM {table} "
                   f"WHERE {c} IS NOT NULL AND {key} IS NOT NULL" for c in cols])


def _str_long(table: str, cols: list[str], key: str) -> str:
    return _union([f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {key} FROM {table} "
                   f"WHERE {c} IS NOT NULL AND {key} IS NOT NULL" for c in cols])


# --- step 1: sources and cleaning ---------------------------------------------

@query("contacts", CONTACTS_SQL)
def q_contacts(spark, sf):
    return contacts(spark, sf)


@query("clean_contacts", f"{CLEAN_CTE} SELECT * FROM clean")
def q_clean_contacts(spark, sf):
    return clean_contacts(spark, sf)


# --- step 2: profiles ----------------------------------------------------------

@query("crosstab_segment_y", f"""{CLEAN_CTE}
SELECT segment, y, count(*) AS n FROM clean
WHERE segment IS NOT NULL AND y IS NOT NULL GROUP BY segment, y""")
def q_crosstab(spark, sf):
    return profiling.crosstab(clean_contacts(spark, sf, history=False), "segment", "y")


@query("value_share_priority", f"""{WITH_CONTACTS}
SELECT priority, count(*) AS n,
       round(CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM contacts), 4) AS pct
FROM contacts GROUP BY priority""")
def q_value_share(spark, sf):
    return profiling.value_share(contacts(spark, sf, history=False), "priority", decimals=4)


_STRING_COLS = ["segment", "region", "priority", "month", "day_of_week", "poutcome", "y"]


@query("marker_share", f"""{WITH_CONTACTS}
SELECT feature, pct FROM (
""" + _union([f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} = 'nonexistent' THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS pct FROM contacts"
              for c in _STRING_COLS]) + """
) WHERE pct > 0""")
def q_marker_share(spark, sf):
    # share of the "no previous contact" marker per string column (A10 with the
    # marker this table uses; the bank table's marker is "unknown")
    return profiling.unknown_share(contacts(spark, sf), marker="nonexistent")


@query("category_by_target", f"""{CLEAN_CTE}
SELECT feature, value, y, count(*) AS n FROM (
{_union([f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, y FROM clean" for c in ["segment", "priority", "poutcome"]])}
) GROUP BY feature, value, y""")
def q_category_by_target(spark, sf):
    return profiling.category_by_target(clean_contacts(spark, sf), ["segment", "priority", "poutcome"], "y")


_CONTACT_TYPES = [("contact_id", "bigint"), ("customer_id", "bigint"), ("segment", "string"),
                  ("region", "string"), ("priority", "string"), ("month", "string"),
                  ("day_of_week", "string"), ("total_price", "double"), ("acct_balance", "double"),
                  ("previous", "int"), ("pdays", "int"), ("poutcome", "string"), ("y", "string")]


@query("profile_contacts", f"""{WITH_CONTACTS}
""" + _union([f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) AS n_rows FROM contacts"
              for i, (c, t) in enumerate(_CONTACT_TYPES)]))
def q_profile(spark, sf):
    return profiling.profile(contacts(spark, sf))


@query("rate_by_weekday", f"""{CLEAN_CTE}
SELECT day_of_week, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 4) AS rate FROM clean GROUP BY day_of_week""")
def q_rate_weekday(spark, sf):
    return profiling.rate_by(clean_contacts(spark, sf, history=False), "day_of_week", "y")


@query("rate_by_month", f"""{CLEAN_CTE}
SELECT month, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 4) AS rate FROM clean GROUP BY month""")
def q_rate_month(spark, sf):
    return profiling.rate_by(clean_contacts(spark, sf, history=False), "month", "y")


@query("rate_by_contact_count", f"""{CLEAN_CTE}
SELECT contacts, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 4) AS rate FROM (
  SELECT CASE WHEN previous + 1 >= 4 THEN '4+' ELSE CAST(previous + 1 AS VARCHAR) END AS contacts, y FROM clean)
GROUP BY contacts""")
def q_rate_contacts(spark, sf):
    df = clean_contacts(spark, sf).withColumn("n_contacts", F.col("previous") + 1)
    return profiling.rate_by(df, profiling.capped_bucket("n_contacts", 4), "y", name="contacts")


@query("relative_rate_poutcome", f"""{CLEAN_CTE}
SELECT poutcome, count(*) AS n,
       round(sum(CAST(y AS DOUBLE)) / count(*), 4) AS rate,
       round((SELECT avg(CAST(y AS DOUBLE)) FROM clean), 4) AS overall_rate,
       round((sum(CAST(y AS DOUBLE)) / count(*)) / (SELECT avg(CAST(y AS DOUBLE)) FROM clean), 4) AS relative
FROM clean GROUP BY poutcome""")
def q_relative_rate(spark, sf):
    return profiling.relative_rate(clean_contacts(spark, sf), "poutcome", "y")


@query("head_contacts", f"{WITH_CONTACTS} SELECT * FROM contacts ORDER BY contact_id LIMIT 5")
def q_head(spark, sf):
    return profiling.head(contacts(spark, sf), ["contact_id"], 5)


# --- step 3: statistics --------------------------------------------------------

@query("welch_t_stats", f"""{CLEAN_CTE},
m AS (SELECT feature, y, count(*) AS n, avg(value) AS mean, var_samp(value) AS var
      FROM ({_num_long('clean', NUM, 'y')}) GROUP BY feature, y),
g AS (SELECT feature, count(*) AS n_groups,
             min_by(n, y) AS n0, min_by(mean, y) AS m0, min_by(var, y) AS v0,
             max_by(n, y) AS n1, max_by(mean, y) AS m1, max_by(var, y) AS v1
      FROM m GROUP BY feature)
SELECT feature, n0, n1, round(m0, 4) AS mean_group0, round(m1, 4) AS mean_group1,
       round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 4) AS t_statistic,
       round(power(v0 / n0 + v1 / n1, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1)), 4) AS dof
FROM g""")
def q_welch(spark, sf):
    st = hypothesis.welch_statistics(clean_contacts(spark, sf), NUM, "y")
    return st.select("feature", "n0", "n1", "mean_group0", "mean_group1",
                     F.round("t_raw", 4).alias("t_statistic"), F.round("dof", 4).alias("dof"))


@query("chi2_stats", f"""{CLEAN_CTE},
cells AS (SELECT feature, value, y, count(*) AS o FROM ({_str_long('clean', CAT, 'y')}) GROUP BY feature, value, y),
rows_ AS (SELECT feature, value, sum(o) AS row_n FROM cells GROUP BY feature, value),
cols_ AS (SELECT feature, y, sum(o) AS col_n FROM cells GROUP BY feature, y),
tot AS (SELECT feature, sum(o) AS N, count(DISTINCT value) AS r, count(DISTINCT y) AS c FROM cells GROUP BY feature),
grid AS (
  SELECT r_.feature, t.r, t.c, CAST(coalesce(cells.o, 0) AS DOUBLE) AS o,
         CAST(r_.row_n AS DOUBLE) * c_.col_n / t.N AS e
  FROM rows_ r_ JOIN cols_ c_ ON r_.feature = c_.feature JOIN tot t ON t.feature = r_.feature
  LEFT JOIN cells ON cells.feature = r_.feature AND cells.value = r_.value AND cells.y = c_.y),
terms AS (
  SELECT feature, (r - 1) * (c - 1) AS dof,
         power(CASE WHEN (r - 1) * (c - 1) = 1 THEN greatest(abs(o - e) - 0.5, 0.0) ELSE abs(o - e) END, 2) / e AS term
  FROM grid)
SELECT feature, CAST(first(dof) AS BIGINT) AS dof,
       round(CASE WHEN first(dof) = 0 THEN 0.0 ELSE sum(term) END, 4) AS chi2
FROM terms GROUP BY feature""")
def q_chi2(spark, sf):
    st = hypothesis.chi2_statistics(clean_contacts(spark, sf), CAT, "y")
    return st.select("feature", F.col("dof").cast("long").alias("dof"), F.round("chi2_raw", 4).alias("chi2"))


@query("anova_priority_stats", f"""{CLEAN_CTE},
m AS (SELECT feature, priority, count(*) AS n, avg(value) AS mean, var_samp(value) AS var
      FROM ({_union([f"SELECT '{c}' AS feature, priority, CAST({c} AS DOUBLE) AS value FROM clean WHERE {c} IS NOT NULL AND priority IS NOT NULL" for c in ["total_price", "acct_balance"]])})
      GROUP BY feature, priority),
w AS (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand FROM m),
a AS (SELECT feature, count(*) AS k, sum(n) AS N, sum(n * power(mean - grand, 2)) AS ssb,
             sum((n - 1) * coalesce(var, 0.0)) AS ssw FROM w GROUP BY feature)
SELECT feature, k AS n_groups, k - 1 AS df_between, CAST(N - k AS BIGINT) AS df_within,
       round((ssb / (k - 1)) / (ssw / (N - k)), 4) AS f_statistic FROM a""")
def q_anova(spark, sf):
    st = hypothesis.anova_statistics(clean_contacts(spark, sf, history=False), ["total_price", "acct_balance"], "priority")
    return st.select("feature", "n_groups", "df_between", "df_within",
                     F.round("f_raw", 4).alias("f_statistic"))


def _simpson(f: str, upper: str, n: int = 20000) -> str:
    """Integral of ``f`` (in x) from 0 to ``upper``, for a query that groups over range(0, n + 1) i."""
    f = f.replace("{x}", f"(i * ({upper}) / {n})")
    return f"sum(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * ({f})) * any_value(({upper}) / {n}) / 3"


_STEPS = "range(0, 20001) steps(i)"
# upper tails as 1 - integral of the density (after a square-root substitution where it is
# singular at 0)
T_P = "greatest(0, 1 - 2 * " + _simpson(
    "exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * power(1 + {x} * {x} / dof, -(dof + 1) / 2)", "abs(t)") + ")"
CHI2_P = "greatest(0, 1 - " + _simpson(
    "2 * power({x}, dof - 1) * exp(-{x} * {x} / 2 - (dof / 2.0) * ln(2) - lgamma(dof / 2.0))", "sqrt(chi)") + ")"
F_P = "greatest(0, 1 - " + _simpson(
    "2 * power({x}, d1 - 1) * power(1 - {x} * {x}, d2 / 2.0 - 1) * exp(lgamma((d1 + d2) / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0))",
    "sqrt(d1 * f / (d1 * f + d2))") + ")"


def _raw(sql: str, **columns: str) -> str:
    """The statistics query ``sql`` without its rounding, as a derived table."""
    body = sql.split(CLEAN_CTE, 1)[1].lstrip(",\n")
    head, tail = body.rsplit("\nSELECT", 1)
    source = " FROM " + re.split(r"\sFROM ", tail)[-1]
    return head + "\n," + f"raw AS (SELECT feature, {', '.join(f'{e} AS {n}' for n, e in columns.items())}{source})"


_T_RAW = _raw(ORACLES["welch_t_stats"], t="(m0 - m1) / sqrt(v0 / n0 + v1 / n1)",
              dof="power(v0 / n0 + v1 / n1, 2) / (power(v0 / n0, 2) / (n0 - 1) + power(v1 / n1, 2) / (n1 - 1))")
_CHI_RAW = _raw(ORACLES["chi2_stats"], dof="CAST(first(dof) AS DOUBLE)", chi="CASE WHEN first(dof) = 0 THEN 0.0 ELSE sum(term) END")
_F_RAW = _raw(ORACLES["anova_priority_stats"], k="k", n="N", d1="CAST(k - 1 AS DOUBLE)", d2="CAST(N - k AS DOUBLE)",
              f="(ssb / (k - 1)) / (ssw / (N - k))")


@query("summarise_features", f"""WITH t AS ({CLEAN_CTE}, {_T_RAW} SELECT * FROM raw),
c AS ({CLEAN_CTE}, {_CHI_RAW} SELECT * FROM raw),
p AS (SELECT feature, 'numerical' AS type, any_value(t) AS statistic, {T_P} AS p FROM t, {_STEPS} GROUP BY feature
      UNION ALL
      SELECT feature, 'categorical', any_value(chi), CASE WHEN any_value(dof) = 0 THEN 1.0 ELSE {CHI2_P} END FROM c, {_STEPS} GROUP BY feature)
SELECT feature, type, round(statistic, 4) AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant, CAST(NULL AS VARCHAR) AS error FROM p""")
def q_summarise(spark, sf):
    """Flagship: Welch t for numerical, chi-square for categorical, sorted by p."""
    out = hypothesis.summarise_features(clean_contacts(spark, sf), NUM, CAT, "y")
    return out.withColumn("p_value", F.round("p_value", 6))


@query("anova_priority", f"""WITH a AS ({CLEAN_CTE}, {_F_RAW} SELECT * FROM raw)
SELECT feature, round(any_value(f), 4) AS f_statistic, round({F_P}, 6) AS p_value, any_value(k) AS n_groups, {F_P} < 0.05 AS significant FROM a, {_STEPS} GROUP BY feature""")
def q_anova_full(spark, sf):
    out = hypothesis.anova_test(clean_contacts(spark, sf, history=False), ["total_price", "acct_balance"], "priority")
    return out.select("feature", "f_statistic", F.round("p_value", 6).alias("p_value"), "n_groups", "significant")


_VIF = ["total_price", "acct_balance", "pdays"]


@query("vif_contacts", f"""{CLEAN_CTE},
g AS (SELECT sum(total_price * total_price) AS a, sum(total_price * acct_balance) AS b,
             sum(total_price * pdays) AS c, sum(acct_balance * acct_balance) AS d,
             sum(acct_balance * pdays) AS e, sum(CAST(pdays AS DOUBLE) * pdays) AS f
      FROM clean WHERE total_price IS NOT NULL AND acct_balance IS NOT NULL AND pdays IS NOT NULL),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS dt FROM g)
SELECT 'total_price' AS feature, round(a * (d * f - e * e) / dt, 4) AS vif FROM det
UNION ALL SELECT 'acct_balance', round(d * (a * f - c * c) / dt, 4) FROM det
UNION ALL SELECT 'pdays', round(f * (a * d - b * b) / dt, 4) FROM det""")
def q_vif(spark, sf):
    v = multivariate.compute_vif(clean_contacts(spark, sf), _VIF)
    return v.select("feature", F.round("vif", 4).alias("vif"))


_CORR = ["total_price", "acct_balance", "previous", "pdays"]


@query("corr_pearson", f"""{CLEAN_CTE}
""" + _union([f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
              + ("1.0 AS corr" if a == b else f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 4) AS corr FROM clean")
              for a in _CORR for b in _CORR]))
def q_corr_pearson(spark, sf):
    return multivariate.correlation_matrix(clean_contacts(spark, sf), _CORR, "pearson")


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
                   for c in _CORR)


@query("corr_spearman", f"""{CLEAN_CTE},
rk AS (SELECT {_RANKS} FROM clean)
""" + _union([f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
              + ("1.0 AS corr" if a == b else f"round(corr(CAST(r_{a} AS DOUBLE), CAST(r_{b} AS DOUBLE)), 4) AS corr FROM rk")
              for a in _CORR for b in _CORR]))
def q_corr_spearman(spark, sf):
    return multivariate.correlation_matrix(clean_contacts(spark, sf), _CORR, "spearman")


def _logit_sql(features: list[str], units: list[float], rounds: int = 9) -> str:
    """Newton steps of the binomial logit, each a weighted Gram matrix solved by elimination with the
    identity beside it; features are in ``units`` until the end."""
    k = len(features) + 1
    ks = range(k)
    col = "a{}_{}".format
    xs = ", ".join(["CAST(1 AS DOUBLE) AS x0"] + [f"CAST({f} AS DOUBLE) / {u!r} AS x{i}" for i, (f, u) in enumerate(zip(features, units), 1)])
    steps = [f"obs AS MATERIALIZED (SELECT {xs}, CAST(y AS DOUBLE) AS y FROM clean WHERE "
             + " AND ".join(f"{f} IS NOT NULL" for f in [*features, "y"]) + ")",
             "beta0 AS MATERIALIZED (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in ks) + ")"]
    for it in range(1, rounds + 1):
        eta = " + ".join(f"b{i} * x{i}" for i in ks)
        gram = [f"sum(p * (1 - p) * x{r} * x{c}) AS {col(r, c)}" for r in ks for c in ks]
        gram += [f"CAST({int(r == c)} AS DOUBLE) AS {col(r, k + c)}" for r in ks for c in ks]
        gram += [f"sum((y - p) * x{r}) AS {col(r, 2 * k)}" for r in ks]
        steps.append(f"e{it}_0 AS MATERIALIZED (SELECT {', '.join(gram)} FROM (SELECT obs.*, 1 / (1 + exp(-({eta}))) AS p FROM obs, beta{it - 1}))")
        for j in ks:
            cells = [(f"{col(r, c)} / {col(j, j)}" if r == j else f"{col(r, c)} - {col(r, j)} * {col(j, c)} / {col(j, j)}") + f" AS {col(r, c)}"
                     for r in ks for c in range(2 * k + 1)]
            steps.append(f"e{it}_{j + 1} AS MATERIALIZED (SELECT {', '.join(cells)} FROM e{it}_{j})")
        last = "SELECT " + ", ".join([f"b{i} + {col(i, 2 * k)} AS b{i}" for i in ks] + [f"sqrt({col(i, k + i)}) AS s{i}" for i in ks])
        steps.append(f"beta{it} AS MATERIALIZED ({last} FROM beta{it - 1}, e{it}_{k})")
    terms = _union([f"SELECT '{t}' AS term, b{i} / {u!r} AS coef, s{i} / {u!r} AS std_err FROM beta{rounds}"
                    for i, (t, u) in enumerate(zip(["const", *features], [1.0, *units]))])
    tail = "greatest(0, 1 - 2 * " + _simpson("exp(-{x} * {x} / 2) / sqrt(2 * pi())", "abs(z)") + ")"
    body = ",\n".join(steps)
    return f"""{CLEAN_CTE},
{body},
terms AS (SELECT *, coef / std_err AS z FROM ({terms}))
SELECT term, printf('%.3e', any_value(coef)) AS coef, printf('%.3e', any_value(std_err)) AS std_err,
       round(any_value(z), 3) AS z, round({tail}, 5) AS p_value
FROM terms, {_STEPS} GROUP BY term"""


@query("logit_summary", _logit_sql(NUM, [{"total_price": 1e5, "acct_balance": 1e4, "pdays": 1e3}.get(f, 1.0) for f in NUM]))
def q_logit(spark, sf):
    """Coefficients and errors to four digits, as text (their sizes differ by powers of ten)."""
    out = multivariate.logit_summary(clean_contacts(spark, sf), NUM, "y")
    return out.select("term", F.format_string("%.3e", "coef").alias("coef"), F.format_string("%.3e", "std_err").alias("std_err"),
                      F.round("z", 3).alias("z"), F.round("p_value", 5).alias("p_value"))


# --- step 4: features ----------------------------------------------------------

TEST_SIZE, VAL_SIZE = 0.2, 0.1
SPLIT_CTE = f"""{CLEAN_CTE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('{SEED}:' || CAST(contact_id AS VARCHAR)), contact_id) AS r,
                  count(*) OVER (PARTITION BY y) AS n_c FROM clean),
q AS (SELECT *, floor(n_c * CAST({TEST_SIZE} AS DOUBLE) + 0.5) AS t FROM ranked),
split AS (SELECT * EXCLUDE (r, n_c, t, v),
                 CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split
          FROM (SELECT *, floor((n_c - t) * CAST({VAL_SIZE / (1 - TEST_SIZE)} AS DOUBLE) + 0.5) AS v FROM q))"""


def split_contacts(spark, sf, history: bool = True) -> DataFrame:
    return features.stratified_split(clean_contacts(spark, sf, history), "y", "contact_id", SEED,
                                     TEST_SIZE, VAL_SIZE)


@query("stratified_split", f"{SPLIT_CTE} SELECT contact_id, y, split FROM split")
def q_split(spark, sf):
    return split_contacts(spark, sf, history=False).select("contact_id", "y", "split")


@query("split_sizes", f"{SPLIT_CTE} SELECT split, y, count(*) AS n FROM split GROUP BY split, y")
def q_split_sizes(spark, sf):
    return split_contacts(spark, sf, history=False).groupBy("split", "y").agg(F.count("*").alias("n"))


@query("scaler_params", f"""{SPLIT_CTE}
""" + _union([f"SELECT '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
              f"round(stddev_pop(CAST({c} AS DOUBLE)), 6) AS std FROM split WHERE split = 'train'" for c in NUM]))
def q_scaler(spark, sf):
    train = split_contacts(spark, sf).where(F.col("split") == "train")
    p = features.scaler_params(train, NUM)
    return p.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_NOMINAL = ["segment", "region", "month", "day_of_week", "poutcome"]
# category domains of the supplied tables, used only to spell out the oracle's columns
_DOMAINS = {
    "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "region": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"],
    "month": sorted(["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]),
    "day_of_week": sorted(["mon", "tue", "wed", "thu", "fri", "sat", "sun"]),
    "poutcome": ["failure", "nonexistent", "success"],
}


def _encoder_sql(digits: int | None = 6) -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in NUM)
    def r(e):
        return f"round({e}, {digits})" if digits is not None else e

    nums = ", ".join(r(f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END") + f" AS num__{c}"
                     for c in NUM)
    order = ", ".join(f"'{v}'" for v in PRIORITY_ORDER)
    ordc = f"CAST(coalesce(list_position([{order}], priority), 0) - 1 AS DOUBLE) AS ord__priority"
    ohe = ", ".join(f"CAST(coalesce(CAST({c} AS VARCHAR) = '{v}', false) AS DOUBLE) AS \"ohe__{c}_{v}\""
                    for c in _NOMINAL for v in _DOMAINS[c])
    return f"""{SPLIT_CTE},
st AS (SELECT {stats} FROM split WHERE split = 'train')
SELECT contact_id, split, y, {nums}, {ordc}, {ohe} FROM split, st"""


def encoder_for(train: DataFrame) -> features.FeatureEncoder:
    return features.FeatureEncoder(numerical=NUM, ordinal={"priority": list(PRIORITY_ORDER)},
                                   nominal=_NOMINAL).fit(train)


@query("encoded_features", _encoder_sql())
def q_encoded(spark, sf):
    split = split_contacts(spark, sf)
    enc = encoder_for(split.where(F.col("split") == "train"))
    out = enc.transform(split, keep=["contact_id", "split", "y"])
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("num__") else F.col(f"`{c}`")
                        for c in out.columns])


@query("dummies_drop_first", f"""{WITH_CONTACTS}
SELECT contact_id, """ + ", ".join(
    f"CAST({c} = '{v}' AS DOUBLE) AS \"{c}_{v}\"" for c in ["segment", "poutcome"] for v in _DOMAINS[c][1:])
    + " FROM contacts")
def q_dummies(spark, sf):
    return features.one_hot(contacts(spark, sf), ["segment", "poutcome"], drop_first=True,
                            keep=["contact_id"])


@query("balanced_weights", f"""{CLEAN_CTE}
SELECT y, count(*) AS n_c,
       round((SELECT count(*) FROM clean) / ((SELECT count(DISTINCT y) FROM clean) * CAST(count(*) AS DOUBLE)), 6) AS weight
FROM clean GROUP BY y""")
def q_weights(spark, sf):
    w = features.balanced_weights(clean_contacts(spark, sf), "y")
    return w.select("y", "n_c", F.round("weight", 6).alias("weight"))


# --- step 5: evaluation on a fixed score (events: k / 100, purchase) ----------

CUM_CTE = f"""{LOG_CTE},
sc AS (SELECT probability AS score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
       FROM plog GROUP BY probability),
cum AS (SELECT score, pos, neg,
               sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
               (SELECT sum(pos) FROM sc) AS P, (SELECT sum(neg) FROM sc) AS N FROM sc),
cc AS (SELECT *, tp - pos AS prev_tp, fp - neg AS prev_fp FROM cum)"""


def _plog(spark, sf):
    return prediction_log(spark, sf)


@query("confusion_matrix_050", f"""{LOG_CTE}
SELECT CAST(sum(CASE WHEN label = 0 AND probability < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
       CAST(sum(CASE WHEN label = 0 AND probability >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
       CAST(sum(CASE WHEN label = 1 AND probability < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
       CAST(sum(CASE WHEN label = 1 AND probability >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp
FROM plog""")
def q_cm(spark, sf):
    return metrics.confusion_matrix(_plog(spark, sf), "label", "probability", 0.5)


@query("curve_areas", f"""{CUM_CTE}
SELECT round(sum((CAST(fp AS DOUBLE) / N - CAST(prev_fp AS DOUBLE) / N) * (CAST(tp AS DOUBLE) / P + CAST(prev_tp AS DOUBLE) / P) / 2), 6) AS roc_auc,
       round(sum((CAST(tp AS DOUBLE) / P - CAST(prev_tp AS DOUBLE) / P) * (CAST(tp AS DOUBLE) / (tp + fp))), 6) AS average_precision,
       round(sum((CAST(tp AS DOUBLE) / P - CAST(prev_tp AS DOUBLE) / P) *
                 (CAST(tp AS DOUBLE) / (tp + fp) + CASE WHEN prev_tp + prev_fp = 0 THEN 1.0 ELSE CAST(prev_tp AS DOUBLE) / (prev_tp + prev_fp) END) / 2), 6) AS pr_auc_trapezoid
FROM cc""")
def q_areas(spark, sf):
    a = metrics.curve_areas(_plog(spark, sf), "label", "probability")
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@query("roc_curve", f"""{CUM_CTE}
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT score, round(CAST(fp AS DOUBLE) / N, 6), round(CAST(tp AS DOUBLE) / P, 6) FROM cc""")
def q_roc(spark, sf):
    r = metrics.roc_curve(_plog(spark, sf), "label", "probability")
    return r.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("pr_curve", f"""{CUM_CTE}
SELECT score AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision,
       round(CAST(tp AS DOUBLE) / P, 6) AS recall FROM cc WHERE prev_tp < P
UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0""")
def q_pr(spark, sf):
    r = metrics.pr_curve(_plog(spark, sf), "label", "probability")
    return r.select("threshold", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"))


_M = f"""CAST(sum(CASE WHEN label = 1 AND probability >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
       CAST(sum(CASE WHEN label = 0 AND probability >= 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
       CAST(sum(CASE WHEN label = 1 AND probability < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
       CAST(sum(CASE WHEN label = 0 AND probability < 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS tn"""


@query("binary_metrics_050", f"""{CUM_CTE},
cm AS (SELECT {_M} FROM plog),
ar AS (SELECT sum((CAST(fp AS DOUBLE) / N - CAST(prev_fp AS DOUBLE) / N) * (CAST(tp AS DOUBLE) / P + CAST(prev_tp AS DOUBLE) / P) / 2) AS roc,
              sum((CAST(tp AS DOUBLE) / P - CAST(prev_tp AS DOUBLE) / P) * (CAST(tp AS DOUBLE) / (tp + fp))) AS ap FROM cc)
SELECT round(roc, 4) AS roc_auc, round(ap, 4) AS pr_auc,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS f1,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
       round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy
FROM cm, ar""")
def q_metrics(spark, sf):
    return metrics.binary_metrics(_plog(spark, sf), "label", "probability", 0.5)


def _d(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


@query("classification_report_050", f"""{LOG_CTE},
cm AS (SELECT {_M} FROM plog),
k AS (SELECT *, {_d('tp', 'tp + fp')} AS p1, {_d('tp', 'tp + fn')} AS r1, {_d('2 * tp', '2 * tp + fp + fn')} AS f1,
             {_d('tn', 'tn + fn')} AS p0, {_d('tn', 'tn + fp')} AS r0, {_d('2 * tn', '2 * tn + fn + fp')} AS f0,
             tp + fn AS s1, tn + fp AS s0 FROM cm)
SELECT '0' AS class, round(p0, 4) AS precision, round(r0, 4) AS recall, round(f0, 4) AS f1_score, CAST(s0 AS BIGINT) AS support FROM k
UNION ALL SELECT '1', round(p1, 4), round(r1, 4), round(f1, 4), CAST(s1 AS BIGINT) FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, round({_d('tp + tn', 's0 + s1')}, 4), CAST(s0 + s1 AS BIGINT) FROM k
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), CAST(s0 + s1 AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round({_d('p0 * s0 + p1 * s1', 's0 + s1')}, 4), round({_d('r0 * s0 + r1 * s1', 's0 + s1')}, 4),
                 round({_d('f0 * s0 + f1 * s1', 's0 + s1')}, 4), CAST(s0 + s1 AS BIGINT) FROM k""")
def q_report(spark, sf):
    return metrics.classification_report(_plog(spark, sf), "label", "probability", 0.5)


def _grid_sql(start, stop, step) -> str:
    return f"""grid AS (SELECT i, CAST({start} AS DOUBLE) + i * ((CAST({start} AS DOUBLE) + CAST({step} AS DOUBLE)) - CAST({start} AS DOUBLE)) AS t
              FROM range(0, CAST(ceil((CAST({stop} AS DOUBLE) - CAST({start} AS DOUBLE)) / CAST({step} AS DOUBLE)) AS BIGINT)) r(i)),
gc AS (SELECT g.t, CAST(count(p.label) FILTER (WHERE p.label = 1) AS DOUBLE) AS tp,
              CAST(count(p.label) FILTER (WHERE p.label = 0) AS DOUBLE) AS fp,
              (SELECT CAST(sum(label) AS DOUBLE) FROM plog) AS P
       FROM grid g LEFT JOIN plog p ON p.probability >= g.t GROUP BY g.t),
cur AS (SELECT t AS threshold, {_d('tp', 'tp + fp')} AS precision, {_d('tp', 'P')} AS recall,
               {_d('2 * tp', '2 * tp + fp + (P - tp)')} AS f1 FROM gc)"""


@query("threshold_curve", f"""{LOG_CTE}, {_grid_sql(0.05, 0.95, 0.01)}
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cur""")
def q_threshold_curve(spark, sf):
    return metrics.threshold_curve(_plog(spark, sf), "label", "probability", decimals=6)


@query("tune_threshold", f"""{LOG_CTE}, {_grid_sql(0.1, 0.9, 0.01)}
SELECT CASE WHEN f1 > 0 THEN threshold ELSE 0.5 END AS threshold, round(f1, 6) AS f1
FROM cur ORDER BY f1 DESC, threshold ASC LIMIT 1""")
def q_tune(spark, sf):
    t = metrics.tune_threshold(_plog(spark, sf), "label", "probability")
    return t.select("threshold", F.round("f1", 6).alias("f1"))


@query("gains_curve", f"""{LOG_CTE},
rk AS (SELECT label, probability, row_number() OVER (ORDER BY probability DESC, event_id) AS rn,
              count(*) OVER () AS n_all, sum(label) OVER () AS pos_all FROM plog),
b AS (SELECT CAST(floor((rn - 1) * 10 / n_all) AS BIGINT) + 1 AS bin, count(*) AS n, sum(label) AS positives,
             min(probability) AS min_score, max(probability) AS max_score, first(n_all) AS n_all, first(pos_all) AS pos_all
      FROM rk GROUP BY 1)
SELECT bin, n, CAST(positives AS BIGINT) AS positives, min_score, max_score,
       CAST(sum(positives) OVER (ORDER BY bin) AS BIGINT) AS cum_positives,
       round(sum(positives) OVER (ORDER BY bin) / pos_all, 4) AS capture,
       round(sum(n) OVER (ORDER BY bin) / n_all, 4) AS population,
       round((CAST(positives AS DOUBLE) / n) / (CAST(pos_all AS DOUBLE) / n_all), 4) AS lift
FROM b""")
def q_gains(spark, sf):
    g = metrics.gains_curve(_plog(spark, sf), "label", "probability", "event_id")
    return g.select("bin", "n", F.col("positives").cast("long").alias("positives"), "min_score",
                    "max_score", F.col("cum_positives").cast("long").alias("cum_positives"),
                    "capture", "population", "lift")


# --- step 6: log analytics -----------------------------------------------------

@query("latest_predictions", f"""{LOG_CTE}
SELECT event_id, ts, probability FROM plog ORDER BY ts DESC, event_id DESC LIMIT 100""")
def q_latest(spark, sf):
    return logs.latest(_plog(spark, sf), 100, cols=("event_id", "ts", "probability"))


@query("usage_summary", f"""{LOG_CTE},
last AS (SELECT round(probability, 4) * 100 AS pct FROM plog ORDER BY ts DESC, event_id DESC LIMIT 100)
SELECT (SELECT count(*) FROM plog) AS total_predictions,
       (SELECT count(*) FROM conversations WHERE role = 'user') AS total_questions,
       coalesce(round(avg(pct), 1), 0.0) AS avg_probability,
       count(*) FILTER (WHERE pct >= 60) AS tier_high,
       count(*) FILTER (WHERE pct >= 30 AND pct < 60) AS tier_medium,
       count(*) FILTER (WHERE pct < 30) AS tier_low
FROM last""")
def q_usage(spark, sf):
    questions = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    return logs.usage_summary(_plog(spark, sf), questions)


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"


@query("usage_record", f"""{LOG_CTE},
last AS (SELECT round(probability, 4) * 100 AS pct FROM plog WHERE probability IS NOT NULL ORDER BY ts DESC, event_id DESC LIMIT 100),
act AS (SELECT event_id, ts, probability FROM plog ORDER BY ts DESC, event_id DESC LIMIT 10),
ask AS (SELECT event_id, ts, user_id FROM plog WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 10)
SELECT true AS available, (SELECT count(*) FROM plog) AS total_predictions,
       (SELECT count(*) FROM plog WHERE event_type = 'click') AS total_questions,
       coalesce(round(avg(pct), 1), 0.0) AS avg_probability,
       'high=' || count(*) FILTER (WHERE pct >= 60) || ',medium=' || count(*) FILTER (WHERE pct >= 30 AND pct < 60)
         || ',low=' || count(*) FILTER (WHERE pct < 30) AS tier_distribution,
       (SELECT string_agg(printf('%.1f', round(probability * 100, 1)) || '@' || {_iso('ts')}, ';' ORDER BY ts, event_id)
        FROM act WHERE probability IS NOT NULL) AS recent_activity,
       (SELECT string_agg('user ' || user_id || '@' || {_iso('ts')}, ';' ORDER BY ts DESC, event_id DESC) FROM ask) AS recent_questions
FROM last""")
def q_usage_record(spark, sf):
    """The whole analytics record; its map and arrays as text, so that any engine compares them.
    Click events stand for questions, since they carry a time."""
    plog = _plog(spark, sf)
    asked = plog.where(F.col("event_type") == "click").select(
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"), "ts", F.col("event_id").alias("question_id"))
    r = logs.usage_record(plog, asked)
    tiers = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.col("tier_distribution")[k].cast("string")) for k in ("high", "medium", "low")])
    acts = F.transform("recent_activity", lambda x: F.concat(F.format_string("%.1f", x["probability"]), F.lit("@"), x["timestamp"]))
    asks = F.transform("recent_questions", lambda x: F.concat(x["query"], F.lit("@"), x["timestamp"]))
    return r.withColumn("tier_distribution", tiers).withColumn("recent_activity", F.array_join(acts, ";")) \
            .withColumn("recent_questions", F.array_join(asks, ";"))


@query("recent_activity", f"""{LOG_CTE}
SELECT event_id, probability, timestamp FROM (
  SELECT event_id, round(probability * 100, 1) AS probability,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, ts
  FROM plog ORDER BY ts DESC, event_id DESC LIMIT 10)
WHERE probability IS NOT NULL""")
def q_recent(spark, sf):
    return logs.recent_activity(_plog(spark, sf))


@query("tier_distribution", f"""{LOG_CTE}
SELECT tier, count(*) FILTER (WHERE t = tier) AS n FROM (
  SELECT CASE WHEN round(probability, 4) * 100 >= 60 THEN 'high'
              WHEN round(probability, 4) * 100 >= 30 THEN 'medium' ELSE 'low' END AS t FROM plog
  WHERE probability IS NOT NULL), (VALUES ('high'), ('medium'), ('low')) v(tier)
GROUP BY tier""")
def q_tiers(spark, sf):
    return logs.tier_distribution(_plog(spark, sf))


@query("prediction_records", f"""{LOG_CTE}
SELECT event_id, round(probability, 4) AS probability_of_subscription,
       CAST(probability >= 0.5 AS INTEGER) AS prediction_class,
       CASE WHEN probability >= 0.5 THEN '{RECOMMEND_YES}' ELSE '{RECOMMEND_NO}' END AS recommendation,
       0.5 AS threshold_used,
       CASE WHEN round(probability, 4) * 100 >= 60 THEN 'High Priority'
            WHEN round(probability, 4) * 100 >= 30 THEN 'Medium Priority' ELSE 'Low Priority' END AS lead_tier,
       printf('%.1f', round(probability, 4) * 100) || '%' AS percent
FROM plog""")
def q_records(spark, sf):
    p = _plog(spark, sf)
    rec = p.select("event_id", *format_prediction("probability", 0.5))
    pct = F.col("probability_of_subscription") * 100
    return rec.select("*", lead_tier(pct).alias("lead_tier"), percent_text(pct).alias("percent"))


@query("relative_age", f"""{LOG_CTE}
SELECT event_id, CASE
  WHEN s < 10 THEN 'just now'
  WHEN s < 60 THEN CAST(s AS VARCHAR) || 's ago'
  WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
  WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago'
  ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age
FROM (SELECT event_id, (epoch_us((SELECT max(ts) FROM plog)) - epoch_us(ts)) // 1000000 AS s FROM plog)""")
def q_age(spark, sf):
    return logs.with_relative_time(_plog(spark, sf)).select("event_id", "age")


@query("recent_questions", """
SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'
ORDER BY conv_id DESC, turn DESC LIMIT 10""")
def q_questions(spark, sf):
    c = read_table(spark, sf, "conversations").where(F.col("role") == "user")
    return logs.latest(c, 10, ts="conv_id", tie="turn").select(
        "conv_id", "turn", F.col("text").alias("query"))


# --- display labels (J3 / C12) ------------------------------------------------
# fixed values: month and weekday display names of the form
MONTH_LABELS = {"jan": "January", "feb": "February", "mar": "March", "apr": "April",
                "may": "May", "jun": "June", "jul": "July", "aug": "August",
                "sep": "September", "oct": "October", "nov": "November", "dec": "December"}
DAY_LABELS = {"mon": "Monday", "tue": "Tuesday", "wed": "Wednesday", "thu": "Thursday",
              "fri": "Friday"}


def _values(d: dict) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in d.items())


@query("label_lookup", f"""{WITH_CONTACTS}
SELECT c.contact_id, coalesce(m.label, c.month) AS month_label, coalesce(d.label, c.day_of_week) AS day_label
FROM contacts c
LEFT JOIN (VALUES {_values(MONTH_LABELS)}) m(code, label) ON c.month = m.code
LEFT JOIN (VALUES {_values(DAY_LABELS)}) d(code, label) ON c.day_of_week = d.code""")
def q_labels(spark, sf):
    from ..operators.labels import with_labels

    df = contacts(spark, sf)
    out = with_labels(df, {"month": MONTH_LABELS, "day_of_week": DAY_LABELS})
    return out.select("contact_id", F.col("month_label"), F.col("day_of_week_label").alias("day_label"))


# --- step 7: retrieval ---------------------------------------------------------
from ..operators import retrieval  # noqa: E402

CHUNK, OVERLAP, DIMS, TOP_K = 512, 64, 256, 5
STEP = CHUNK - OVERLAP
TOKENS_SQL = r"""CASE WHEN s = '' THEN []::VARCHAR[] ELSE string_split_regex(s, '\s+') END"""
CHUNKS_CTE = rf"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS tok
           FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)),
c AS (SELECT doc_id, tok, unnest(generate_series(0, greatest(len(tok) - {OVERLAP} - 1, 0), {STEP})) AS st
      FROM t WHERE len(tok) > 0),
chunks AS (SELECT doc_id, CAST(st // {STEP} AS BIGINT) AS chunk_id, CAST(st AS BIGINT) AS start_token,
                  CAST(len(list_slice(tok, st + 1, st + {CHUNK})) AS BIGINT) AS n_tokens,
                  array_to_string(list_slice(tok, st + 1, st + {CHUNK}), ' ') AS text FROM c)"""


def doc_chunks(spark, sf):
    return retrieval.chunk_documents(read_table(spark, sf, "documents"), "doc_id", "text", CHUNK, OVERLAP)


@query("chunks", f"{CHUNKS_CTE} SELECT * FROM chunks")
def q_chunks(spark, sf):
    return doc_chunks(spark, sf)


@query("vector_top_k", r"""WITH
cen AS (SELECT label, list(m ORDER BY i) AS q FROM (
          SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
          FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT cen.label AS query_label, e.vec_id,
             list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: cen.q[i] * CAST(e.embedding[i] AS DOUBLE)))
             / (sqrt(list_sum(list_transform(cen.q, lambda x: x * x)))
                * sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))) AS sim
      FROM cen, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY sim DESC NULLS LAST, vec_id) AS rank FROM s)
SELECT query_label, CAST(rank AS INTEGER) AS rank, vec_id, round(sim, 6) AS similarity FROM r WHERE rank <= 5""")
def q_vector_top_k(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    queries = retrieval.centroids(emb, "label").withColumnRenamed("label", "query_label")
    top = retrieval.vector_top_k(queries, emb, "query_label", ["vec_id"], "embedding", TOP_K)
    return top.select("query_label", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


_BIG_ID = 9007199254740992  # 2^53: larger ids are no longer exact as doubles
_COSINE_SQL = """list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2]))
         / (sqrt(list_sum(list_transform(q.v, lambda x: x * x))) * sqrt(list_sum(list_transform(e.v, lambda x: x * x))))"""


@query("vector_top_k_nulls", f"""WITH
e AS (SELECT CASE WHEN vec_id % 17 <> 0 THEN {_BIG_ID} + vec_id END AS id, vec_id AS k,
             list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
      FROM embeddings WHERE vec_id % 10 <> 3),
q AS (SELECT {_BIG_ID} + vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
      FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query_id, e.id AS vec_id, {_COSINE_SQL} AS sim FROM q, e)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(rank AS INTEGER) AS rank, coalesce(CAST(vec_id AS VARCHAR), 'none') AS vec_id,
       round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, vec_id NULLS FIRST) AS rank FROM r)
WHERE rank <= {TOP_K}""")
def q_vector_top_k_nulls(spark, sf):
    """R4 with ids above 2^53, every seventeenth id and every tenth vector NULL."""
    emb = read_table(spark, sf, "embeddings")
    big = F.col("vec_id") + F.lit(_BIG_ID)
    corpus = emb.select(F.when(F.col("vec_id") % 17 != 0, big).alias("vec_id"),
                        F.when(F.col("vec_id") % 10 != 3, F.col("embedding")).alias("embedding"))
    queries = emb.where("vec_id % 50 = 0").select(big.alias("query_id"), "embedding")
    top = retrieval.vector_top_k(queries, corpus, "query_id", ["vec_id"], "embedding", TOP_K)
    # ids as texts: a comparison as numbers could go through doubles
    return top.select(F.col("query_id").cast("string").alias("query_id"), "rank",
                      F.coalesce(F.col("vec_id").cast("string"), F.lit("none")).alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("cell_index_top_k", f"""WITH
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, v FROM e WHERE vec_id % 50 = 0),
r AS (SELECT query_id, e.vec_id, {_COSINE_SQL} AS sim FROM q, e)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(sim, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, vec_id) AS rank FROM r)
WHERE rank <= {TOP_K}""")
def q_cell_index(spark, sf):
    """An index in cells written and searched; the queries are a table like the corpus."""
    from ..operators import vector_index
    from ..session import scratch_path

    emb = read_table(spark, sf, "embeddings")
    path = scratch_path(spark, "cell-index")
    vector_index.build_cells(emb, ["vec_id"], path, n_cells=16)
    queries = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = vector_index.search_cells(spark, path, queries, "query_id", "embedding", TOP_K)
    return top.select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def _bucket_sql(text: str) -> str:
    return (f"SELECT *, CAST(('0x' || substr(md5(tk), 1, 8)) AS BIGINT) % {DIMS} AS b FROM "
            f"(SELECT *, unnest(tok) AS tk FROM (SELECT *, {TOKENS_SQL} AS tok FROM "
            rf"(SELECT *, regexp_replace(lower({text}), '^\s+|\s+$', '', 'g') AS s FROM __src)))")


RETRIEVAL_CTE = rf"""{CHUNKS_CTE},
cb AS (SELECT doc_id, chunk_id, b, count(*) AS n FROM ({_bucket_sql('text').replace('__src', 'chunks')}) GROUP BY ALL),
qb AS (SELECT item_id, b, count(*) AS n FROM ({_bucket_sql('text').replace('__src', 'benchmark')}) GROUP BY ALL),
cn AS (SELECT c.doc_id, c.chunk_id, coalesce(sum(CAST(n AS DOUBLE) * n), 0.0) AS n2
       FROM chunks c LEFT JOIN cb USING (doc_id, chunk_id) GROUP BY ALL),
qn AS (SELECT item_id, coalesce(sum(CAST(n AS DOUBLE) * n), 0.0) AS n2 FROM benchmark LEFT JOIN qb USING (item_id) GROUP BY ALL),
d AS (SELECT qb.item_id, cb.doc_id, cb.chunk_id, sum(CAST(qb.n AS DOUBLE) * cb.n) AS dot
      FROM qb JOIN cb ON qb.b = cb.b GROUP BY ALL),
s AS (SELECT qn.item_id, cn.doc_id, cn.chunk_id,
             CASE WHEN qn.n2 * cn.n2 = 0 THEN NULL ELSE coalesce(d.dot, 0.0) / (sqrt(qn.n2) * sqrt(cn.n2)) END AS sim
      FROM qn CROSS JOIN cn LEFT JOIN d ON d.item_id = qn.item_id AND d.doc_id = cn.doc_id AND d.chunk_id = cn.chunk_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC NULLS LAST, doc_id, chunk_id) AS rank FROM s)
        WHERE rank <= {TOP_K})"""


@query("weighted_embeddings", rf"""{CHUNKS_CTE},
cb AS (SELECT doc_id, chunk_id, b, count(*) AS n FROM ({_bucket_sql('text').replace('__src', 'chunks')}) GROUP BY ALL),
m AS (SELECT b, ln((1 + (SELECT count(*) FROM chunks)) / (1 + count(*))) + 1 AS idf FROM cb GROUP BY b),
w AS (SELECT doc_id, chunk_id, b, n * idf AS x FROM cb JOIN m USING (b))
SELECT doc_id, chunk_id, CAST(b AS INTEGER) AS bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, chunk_id)), 6) AS weight
FROM w""")
def q_weighted_embeddings(spark, sf):
    """R2: the weighted vectors of a written index, entry by entry."""
    from ..session import scratch_path

    idx = retrieval.build_weighted_index(read_table(spark, sf, "documents"), scratch_path(spark, "weighted-index"), CHUNK, OVERLAP,
                                         DIMS, "md5")
    return idx.select("doc_id", "chunk_id", F.posexplode("embedding").alias("bucket", "weight")).where("weight > 0") \
              .withColumn("weight", F.round("weight", 6))


def retrieve_benchmark(spark, sf):
    idx = retrieval.embed_chunks(doc_chunks(spark, sf), None, "text", DIMS, "md5")
    qs = retrieval.embed_chunks(read_table(spark, sf, "benchmark"), ["item_id"], "text", DIMS, "md5")
    top = retrieval.vector_top_k(qs, idx, "item_id", ["doc_id", "chunk_id"], "embedding", TOP_K)
    return idx, top


@query("doc_retrieval", f"{RETRIEVAL_CTE} SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, round(sim, 6) AS similarity FROM top")
def q_doc_retrieval(spark, sf):
    _, top = retrieve_benchmark(spark, sf)
    return top.select("item_id", "rank", "doc_id", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("retrieved_context", f"""{RETRIEVAL_CTE}
SELECT top.item_id, CAST(count(*) AS INTEGER) AS n_chunks, string_agg(chunks.text, '\n\n' ORDER BY rank) AS context
FROM top JOIN chunks USING (doc_id, chunk_id) GROUP BY top.item_id""")
def q_context(spark, sf):
    idx, top = retrieve_benchmark(spark, sf)
    return retrieval.assemble_context(top, idx, "item_id", ["doc_id", "chunk_id"])


@query("conversation_history", """
SELECT conv_id, turn, role, text,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
       CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_user_turns
FROM conversations""")
def q_history(spark, sf):
    return retrieval.conversation_history(read_table(spark, sf, "conversations"))


# --- step 8-10: models, scoring, attributions, streams (row-count checks) ------
from ..operators import models as model_ops  # noqa: E402
from ..operators import scoring  # noqa: E402


def model_data(spark, sf):
    """Encoded contacts with features/label/split (encoder fitted on train only)."""
    split = split_contacts(spark, sf)
    enc = encoder_for(split.where(F.col("split") == "train"))
    data = model_ops.assemble(enc.transform(split, keep=["contact_id", "split", "y"]),
                              enc.feature_names(), "y")
    return enc, data


_FITTED: dict[tuple, tuple] = {}


def _version(spark, sf) -> tuple:
    """Files, sizes and times of the tables that the contacts come from."""
    found = []
    for name in ("orders", "customer", "nation", "region"):
        m = F.col("_metadata")
        rows = read_table(spark, sf, name).select(m.file_path.alias("f"), m.file_size.alias("s"), m.file_modification_time.alias("t"))
        found += [tuple(r) for r in rows.groupBy().agg(F.count_distinct("f"), F.sum_distinct("s"), F.max("t")).collect()]
    return tuple(found)


def _encoded(spark, sf):
    """(encoder, written encoded split): the lazy split is evaluated once for all fits."""
    from ..session import path_exists, scratch_path

    key = (spark.sparkContext.applicationId, sf, _version(spark, sf))
    if key not in _FITTED or not path_exists(spark, _FITTED[key][1]):  # the scratch folder may have been cleaned
        enc, data = model_data(spark, sf)
        path = scratch_path(spark, "encoded-split")
        data.select("contact_id", "features", "label", "split").write.parquet(path)
        _FITTED[key] = enc, path
    enc, path = _FITTED[key]
    return enc, spark.read.parquet(path), key


def _fit(spark, sf, name):
    """(encoder, result) of a registry model on the contacts; one fit per application, state of the
    tables and model serves all queries that score or explain with it."""
    enc, data, key = _encoded(spark, sf)
    if (*key, name) not in _FITTED:
        _FITTED[(*key, name)] = enc, model_ops.train_one(name, data, contacts_settings(), SEED)
    return _FITTED[(*key, name)]


@query("train_logistic")
def q_train_lr(spark, sf):
    return model_ops.model_comparison(spark, [_fit(spark, sf, "LogisticRegression")[1]])


#: The registry models that are compared; see ``train_forest`` for the other.
_COMPARED = ("LogisticRegression", "XGBoost", "LightGBM")


@query("train_boosted")
def q_train_gbt(spark, sf):
    """Both boosted configurations (level-wise; leaf-wise with at most num_leaves leaves), stopped
    after the configured rounds without validation gain, compared with the logistic model."""
    results = [_fit(spark, sf, name)[1] for name in _COMPARED]
    out = model_ops.model_comparison(spark, results)
    best = model_ops.select_best(results)
    return out.withColumn("selected", F.col("name") == best["name"])


def _forest(spark, sf):
    """(encoder, node table, encoded split) of the 300 trees of depth 15."""
    from ..operators import forest
    from ..session import path_exists, scratch_path

    enc, data, key = _encoded(spark, sf)
    if (*key, "forest") not in _FITTED or not path_exists(spark, _FITTED[(*key, "forest")]):
        path = scratch_path(spark, "forest-nodes")
        weighted = model_ops.add_weights(data, "balanced").where(F.col("split") == "train")
        forest.fit(weighted, contacts_settings().models.random_forest, path, SEED)
        _FITTED[(*key, "forest")] = path
    return enc, spark.read.parquet(_FITTED[(*key, "forest")]), data


@query("train_forest")
def q_train_forest(spark, sf):
    """M3: the forest at its configured size, its threshold tuned on the validation rows, its metrics on
    validation and test rows scored from the node table."""
    from ..operators import forest
    from ..session import materialize

    _, nodes, data = _forest(spark, sf)
    held = data.where(F.col("split") != "train")
    scored = materialize(forest.score(held, nodes, "contact_id").join(held.select("contact_id", "label", "split"), "contact_id"), "forest-scores")
    grid = contacts_settings().threshold_grid
    size = nodes.agg(F.count_distinct("tree").cast("int").alias("trees"), F.count(F.lit(1)).alias("nodes"))
    val, test = (scored.where(F.col("split") == part) for part in ("val", "test"))
    threshold = float(metrics.tune_threshold(val, "label", "p", grid).first()["threshold"])
    found = size
    for part, rows in (("val", val), ("test", test)):
        row = metrics.binary_metrics(rows, "label", "p", threshold).first()
        found = found.select("*", *[F.lit(float(row[c])).alias(f"{part}_{c}") for c in ("roc_auc", "pr_auc", "f1")])
    return found.withColumn("threshold", F.lit(threshold))


@query("forest_attributions")
def q_forest_attributions(spark, sf):
    """M10 for the forest: every test contact's score, base, the sum of its attributions and the feature
    of the largest one; ``adds_up`` holds base + sum against the score."""
    from ..operators import forest

    enc, nodes, data = _forest(spark, sf)
    long = forest.attributions(data.where(F.col("split") == "test"), nodes, enc.feature_names(), "contact_id")
    base = F.lit(forest.base_value(nodes))
    per = long.groupBy("contact_id").agg(
        F.first("p").alias("score"), F.sum("attribution").alias("total"),
        F.max_by("feature", F.struct(F.abs("attribution"), "feature")).alias("top_feature"))
    return per.select("contact_id", "score", base.alias("base"), "total", "top_feature",
                      (F.abs(base + F.col("total") - F.col("score")) < 1e-6).alias("adds_up"))


@query("train_leaf_wise")
def q_train_leaf_wise(spark, sf):
    """The leaf-wise trees up to the best round: leaves, depth in use, gain, training rows."""
    model = _fit(spark, sf, "LightGBM")[1]["model"]
    rows = [(i, t.n_leaves, float(t.gain.sum()), int(t.rows[0])) for i, t in enumerate(model.trees)]
    return spark.createDataFrame(rows, "tree int, leaves int, gain double, n_rows long")


def _saved(spark, sf):
    """Folder with the run log and the best of the compared models."""
    from ..operators import lifecycle
    from ..session import path_exists, scratch_path

    enc, _, key = _encoded(spark, sf)
    if (*key, "saved") not in _FITTED or not path_exists(spark, f"{_FITTED[(*key, 'saved')]}/best"):
        base = scratch_path(spark, "lifecycle")
        lifecycle.save_results(spark, [_fit(spark, sf, name)[1] for name in _COMPARED], enc, base)
        _FITTED[(*key, "saved")] = base
    return _FITTED[(*key, "saved")]


@query("train_all_saved")
def q_train_all_saved(spark, sf):
    """The run log of all compared models and the card of the saved best one; ``agrees``
    holds the card's values against the log's."""
    from ..operators import lifecycle
    from ..sources.files import load_scorer

    base = _saved(spark, sf)
    log = lifecycle.logged(spark, base)
    card = load_scorer(spark, f"{base}/best")[2]
    given = {"val_pr_auc": card["val_pr_auc"], "test_pr_auc": card["test_pr_auc"], "tuned_threshold": card["tuned_threshold"]}
    on_card = F.coalesce(*[F.when(F.col("key") == k, F.lit(str(v))) for k, v in given.items()])
    saved = F.col("model") == card["model_name"]
    return log.select("model", "kind", "key", "value", saved.alias("saved"),
                      F.when(saved & on_card.isNotNull(), F.col("value") == on_card).alias("agrees"))


@query("evaluate_saved")
def q_evaluate_saved(spark, sf):
    """M9: metrics, confusion counts and importances of the reloaded best model on the test rows, and
    the same metrics as logged when it was trained."""
    from ..operators import lifecycle

    base = _saved(spark, sf)
    _, data, _ = _encoded(spark, sf)
    tables = lifecycle.evaluate_saved(spark, base, data.where(F.col("split") == "test"))
    m = tables["metrics"]
    found = m.select(F.inline(F.array(*[F.struct(F.lit("metrics").alias("part"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
                                        for c in m.columns])))
    best = q_train_all_saved(spark, sf).where("saved AND kind = 'metric' AND key LIKE 'test_%'")
    logged = best.select(F.lit("logged").alias("part"), F.substring("key", 6, 100).alias("key"), F.col("value").cast("double").alias("value"))
    c = tables["confusion"]
    counts = c.select(F.inline(F.array(*[F.struct(F.lit("confusion").alias("part"), F.lit(k).alias("key"), F.col(k).cast("double").alias("value"))
                                         for k in c.columns])))
    weight = tables["importance"].select(F.lit("importance").alias("part"), F.col("feature").alias("key"), F.col("importance").alias("value"))
    return found.unionByName(logged).unionByName(counts).unionByName(weight)


@query("feature_importance")
def q_importance(spark, sf):
    enc, r = _fit(spark, sf, "LogisticRegression")
    return model_ops.feature_importance(r["model"], enc.feature_names(), 20)


@query("score_contacts")
def q_score(spark, sf):
    enc, r = _fit(spark, sf, "LogisticRegression")
    return scoring.score_batch(clean_contacts(spark, sf), enc, r["model"], r["threshold"],
                               id_cols=["contact_id"])


def _requests(spark, sf):
    """Contacts as scoring requests with fields taken away by fixed rules."""
    c = clean_contacts(spark, sf)
    gone = lambda name, k: F.when(F.col("contact_id") % k != 0, F.col(name)).alias(name)
    return c.select("contact_id", gone("total_price", 7), gone("segment", 11),
                    F.when(F.col("contact_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("acct_balance")).alias("acct_balance"),
                    "previous", "pdays", "poutcome", "region", "priority", "month", "day_of_week")


@query("score_requests", f"""{CLEAN_CTE}
SELECT contact_id, errors = '' AS accepted, errors FROM (
  SELECT contact_id, concat_ws(';',
    CASE WHEN contact_id % 7 = 0 THEN 'total_price: field required' END,
    CASE WHEN contact_id % 13 = 0 THEN 'acct_balance: not a valid double' END,
    CASE WHEN contact_id % 11 = 0 THEN 'segment: field required' END) AS errors FROM clean)""")
def q_score_requests(spark, sf):
    """Scoring takes the valid requests only and lists the others with their errors."""
    enc, r = _fit(spark, sf, "LogisticRegression")
    asked = _requests(spark, sf)
    good = scoring.score_batch(asked, enc, r["model"], r["threshold"], id_cols=["contact_id"])
    good = good.where(F.col("prediction_class").isNotNull()).select("contact_id", F.lit(True).alias("accepted"), F.lit("").alias("errors"))
    bad = scoring.rejected_rows(asked, enc, ["contact_id"])
    return good.unionByName(bad.select("contact_id", F.lit(False).alias("accepted"), F.array_join("errors", ";").alias("errors")))


def _attributions(spark, sf):
    """(attributions of the test rows, base, scored test rows); the split is built once."""
    enc, r = _fit(spark, sf, "LogisticRegression")
    split = split_contacts(spark, sf)
    encoded = enc.transform(split, keep=["contact_id", "split", "y"])
    names = enc.feature_names()
    row = encoded.where(F.col("split") == "train").agg(*[F.avg(F.col(f"`{n}`")).alias(f"m{i}") for i, n in enumerate(names)]).first()
    means = {n: row[f"m{i}"] for i, n in enumerate(names)}
    m = r["model"]
    coefficients = m.coefficients.toArray().tolist()
    test = split.where(F.col("split") == "test")
    attr = scoring.linear_attributions(test, enc, coefficients, m.intercept, means, "contact_id")
    scored = scoring.score_rows(test, enc, m, r["threshold"], id_cols=["contact_id"])
    return attr, scoring.attribution_base(coefficients, m.intercept, names, means), scored


@query("attribution_rank")
def q_attr_rank(spark, sf):
    return scoring.attribution_rank(_attributions(spark, sf)[0])


@query("explain_row")
def q_explain(spark, sf):
    """All contributions of the first test contact; ``adds_up`` holds base + their sum against the
    scored probability."""
    attr, base, scored = _attributions(spark, sf)
    first_id = attr.select(F.min("contact_id")).first()[0]
    one = scoring.explain_row(attr, "contact_id", first_id)
    margin = one.select(F.sum("attribution") + F.lit(base)).scalar()
    given = scored.where(F.col("contact_id") == first_id).select("probability_of_subscription").scalar()
    return one.withColumn("adds_up", F.abs(1 / (1 + F.exp(-margin)) - given) < 1e-3)


@query("stream_tier_counts", f"""{LOG_CTE}
SELECT tier, count(*) AS n FROM (
  SELECT CASE WHEN round(probability, 4) * 100 >= 60 THEN 'high'
              WHEN round(probability, 4) * 100 >= 30 THEN 'medium' ELSE 'low' END AS tier
  FROM plog WHERE probability IS NOT NULL) GROUP BY tier""")
def q_stream_tiers(spark, sf):
    from ..streaming.scoring import tier_counts_from_table
    import os

    prob = F.get_json_object("props", "$.k").cast("int").cast("double") / F.lit(100.0)
    return tier_counts_from_table(spark, os.path.join(sf, "events.parquet"), prob)


@query("stream_scored_contacts")
def q_stream_score(spark, sf):
    """Contacts written as a table, replayed as a file stream and scored."""
    import os

    from ..session import scratch_path
    from ..streaming.scoring import file_stream, run_to_completion, score_stream

    enc, r = _fit(spark, sf, "LogisticRegression")
    base = scratch_path(spark, "score-stream")
    clean_contacts(spark, sf).write.parquet(os.path.join(base, "src"))
    src = file_stream(spark, os.path.join(base, "src"))
    q = score_stream(src, enc, r["model"], r["threshold"], os.path.join(base, "sink"),
                     os.path.join(base, "ckpt"), id_cols=["contact_id"])
    run_to_completion(q)
    return spark.read.parquet(os.path.join(base, "sink")).drop("timestamp", "logged_at")


def _fixed_names() -> list[str]:
    return [f"num__{c}" for c in NUM] + ["ord__priority"] + [f"ohe__{c}_{v}" for c in _NOMINAL for v in _DOMAINS[c]]


#: Coefficients of a model that is given, not fitted, so that SQL can score as well.
_FIXED = [((7 * i) % 13 - 6) / 10 for i in range(len(_fixed_names()))]
_FIXED_BASE, _FIXED_CUT = -0.25, 0.4
_FIXED_MARGIN = " + ".join(f'({c}) * "{n}"' for c, n in zip(_FIXED, _fixed_names())) + f" + ({_FIXED_BASE})"


def _fixed_sql(where: str) -> str:
    return f"""WITH enc AS ({_encoder_sql(None)}),
p AS (SELECT contact_id, 1 / (1 + exp(-({_FIXED_MARGIN}))) AS p FROM enc{where})
SELECT contact_id, round(p, 4) AS probability_of_subscription, CAST(p >= {_FIXED_CUT} AS INTEGER) AS prediction_class,
       CASE WHEN p >= {_FIXED_CUT} THEN '{RECOMMEND_YES}' ELSE '{RECOMMEND_NO}' END AS recommendation, {_FIXED_CUT} AS threshold_used
FROM p"""


def _fixed_parts(spark, sf):
    """(encoder with all categories of the oracle, scorer, contacts)."""
    split = split_contacts(spark, sf)
    enc = encoder_for(split.where(F.col("split") == "train"))
    for c in _NOMINAL:  # a small table may lack a category; it still has its coefficient
        enc.categories[c] = _DOMAINS[c]
    return enc, scoring.LinearScorer(_FIXED, _FIXED_BASE), split


@query("score_given_model", _fixed_sql(""))
def q_score_given(spark, sf):
    """Q1, Q2: every contact scored by a model of given coefficients, value by value."""
    enc, model, _ = _fixed_parts(spark, sf)
    return scoring.score_batch(clean_contacts(spark, sf), enc, model, _FIXED_CUT, id_cols=["contact_id"])


@query("stream_given_model", _fixed_sql(""))
def q_stream_given(spark, sf):
    """The same contacts as a file stream of several batches."""
    import os

    from ..session import scratch_path
    from ..streaming.scoring import file_stream, run_to_completion, score_stream

    enc, model, _ = _fixed_parts(spark, sf)
    base = scratch_path(spark, "given-stream")
    clean_contacts(spark, sf).repartition(4).write.parquet(os.path.join(base, "src"))
    q = score_stream(file_stream(spark, os.path.join(base, "src"), max_files=1), enc, model, _FIXED_CUT, os.path.join(base, "sink"),
                     os.path.join(base, "ckpt"), id_cols=["contact_id"])
    run_to_completion(q)
    return spark.read.parquet(os.path.join(base, "sink")).drop("timestamp", "logged_at")


def _given_attribution_sql() -> str:
    names = _fixed_names()
    means = ", ".join(f'avg(CASE WHEN split = \'train\' THEN "{n}" END) AS m{i}' for i, n in enumerate(names))
    items = ", ".join(f"{{'feature': '{n}', 'value': \"{n}\", 'attribution': ({c}) * (\"{n}\" - m{i})}}"
                      for i, (n, c) in enumerate(zip(names, _FIXED)))
    return f"""WITH enc AS ({_encoder_sql(None)}), st2 AS (SELECT {means} FROM enc),
e AS (SELECT contact_id, unnest([{items}]) AS f FROM enc, st2 WHERE split = 'test')
SELECT contact_id, f.feature AS feature, round(f.value, 6) + 0.0 AS value, round(f.attribution, 6) + 0.0 AS attribution FROM e"""


@query("attributions_given_model", _given_attribution_sql())
def q_attributions_given(spark, sf):
    """Every contribution of the given model to every test contact's margin."""
    enc, model, split = _fixed_parts(spark, sf)
    names = enc.feature_names()
    train = enc.transform(split.where(F.col("split") == "train"))
    row = train.agg(*[F.avg(F.col(f"`{n}`")).alias(f"m{i}") for i, n in enumerate(names)]).first()
    means = {n: row[f"m{i}"] for i, n in enumerate(names)}
    attr = scoring.linear_attributions(split.where(F.col("split") == "test"), enc, model.coefficients, model.intercept, means, "contact_id")
    # + 0.0: no negative zeros
    return attr.select("contact_id", "feature", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("value", "attribution")])


@query("explain_given_model", f"""WITH a AS ({_given_attribution_sql()})
SELECT feature, value, attribution, CAST(row_number() OVER (ORDER BY abs(attribution) DESC, feature) AS INTEGER) AS place
FROM a WHERE contact_id = (SELECT min(contact_id) FROM a)""")
def q_explain_given(spark, sf):
    """The first test contact's contributions, largest first."""
    from pyspark.sql import Window

    attr = q_attributions_given(spark, sf)
    first = attr.select(F.min("contact_id")).first()[0]
    one = scoring.explain_row(attr, "contact_id", first)  # one row per feature
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("attribution")), "feature"))
    return one.select("feature", "value", "attribution", place.alias("place"))


@query("attribution_rank_given_model", f"""WITH a AS ({_given_attribution_sql()})
SELECT feature, round(avg(abs(attribution)), 4) AS mean_abs_attribution FROM a GROUP BY feature""")
def q_rank_given(spark, sf):
    """Mean absolute contribution per feature."""
    rank = scoring.attribution_rank(q_attributions_given(spark, sf))
    return rank.select("feature", F.round("mean_abs_attribution", 4).alias("mean_abs_attribution"))


@query("dependence_given_model", f"""WITH a AS ({_given_attribution_sql()})
SELECT contact_id, max(value) FILTER (WHERE feature = 'num__total_price') AS num__total_price,
       max(attribution) FILTER (WHERE feature = 'num__total_price') AS attribution,
       max(value) FILTER (WHERE feature = 'num__acct_balance') AS num__acct_balance
FROM a GROUP BY contact_id""")
def q_dependence_given(spark, sf):
    """A feature's value and contribution beside another feature's value, per test contact."""
    return scoring.attribution_dependence(q_attributions_given(spark, sf), "contact_id", "num__total_price", "num__acct_balance")


# --- sources round trips and sampling -------------------------------------------

@query("sample_contacts", f"""{WITH_CONTACTS}
SELECT * FROM contacts ORDER BY md5('{SEED}:' || CAST(contact_id AS VARCHAR)), contact_id LIMIT 1500""")
def q_sample(spark, sf):
    return profiling.sample_n(contacts(spark, sf), 1500, "contact_id", SEED)


@query("contacts_csv_roundtrip", CONTACTS_SQL)
def q_csv(spark, sf):
    """The contacts table written as ';'-delimited CSV with a header and read
    back with a declared schema."""
    import os

    from pyspark.sql import types as T

    from ..session import scratch_path
    from ..sources.files import read_contacts, write_contacts_csv

    df = contacts(spark, sf)
    path = os.path.join(scratch_path(spark, "contacts-csv"), "csv")
    write_contacts_csv(df, path)
    return read_contacts(spark, path, schema=T.StructType(df.schema.fields))


def _active_sql() -> str:
    names = ([f"num__{c}" for c in NUM] + ["ord__priority"]
             + [f"ohe__{c}_{v}" for c in _NOMINAL for v in _DOMAINS[c]])
    items = ", ".join(f"{{'pos': {i}, 'feature': '{n}', 'value': \"{n}\"}}" for i, n in enumerate(names))
    return f"""WITH enc AS ({_encoder_sql(None)}),
e AS (SELECT contact_id, unnest([{items}]) AS f FROM enc WHERE split = 'test'),
p AS (SELECT contact_id, f.pos AS pos, f.feature AS feature, f.value AS value FROM e WHERE f.value > 0)
SELECT contact_id, rank, feature, round(value, 6) AS value FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY contact_id ORDER BY pos) AS INTEGER) AS rank FROM p)
WHERE rank <= 10"""


@query("active_features", _active_sql())
def q_active(spark, sf):
    """Per test contact, the first ten encoded features with a value > 0."""
    split = split_contacts(spark, sf)
    enc = encoder_for(split.where(F.col("split") == "train"))
    encoded = enc.transform(split.where(F.col("split") == "test"), keep=["contact_id"])
    act = cleaning.active_features(encoded, "contact_id", enc.feature_names(), 10)
    return act.withColumn("value", F.round("value", 6))


def _kendall_sql() -> str:
    cols = _CORR
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sums = ", ".join(f"sum(CAST(sign(CAST(p.{a} AS DOUBLE) - q.{a}) * sign(CAST(p.{b} AS DOUBLE) - q.{b}) AS DOUBLE)) AS s_{a}_{b}"
                     for a, b in pairs)
    ties = ", ".join(f"(SELECT sum(CAST(t AS DOUBLE) * (t - 1) / 2) FROM (SELECT count(*) AS t FROM clean GROUP BY {c})) AS t_{c}"
                     for c in cols)
    rows = []
    for a in cols:
        for b in cols:
            if a == b:
                rows.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, 1.0 AS corr")
            else:
                x, y = (a, b) if cols.index(a) < cols.index(b) else (b, a)
                rows.append(f"SELECT '{a}', '{b}', round(s_{x}_{y} / sqrt((n0 - t_{a}) * (n0 - t_{b})), 4) FROM k")
    return f"""{CLEAN_CTE},
s AS (SELECT {sums} FROM clean p JOIN clean q ON p.contact_id < q.contact_id),
k AS (SELECT *, {ties}, (SELECT CAST(count(*) AS DOUBLE) * (count(*) - 1) / 2 FROM clean) AS n0 FROM s)
""" + _union(rows)


@query("corr_kendall", _kendall_sql())
def q_corr_kendall(spark, sf):
    return multivariate.correlation_matrix(clean_contacts(spark, sf), _CORR, "kendall")


@query("smote_train_counts", f"""{SPLIT_CTE},
c AS (SELECT y, count(*) AS n FROM split WHERE split = 'train' GROUP BY y)
SELECT y, false AS synthetic, n FROM c
UNION ALL
SELECT (SELECT y FROM c ORDER BY n, CAST(y AS VARCHAR) LIMIT 1), true, max(n) - min(n) FROM c""")
def q_smote(spark, sf):
    """F7 on the encoded training split: original and synthetic rows per class."""
    from ..operators.smote import smote

    split = split_contacts(spark, sf)
    enc = encoder_for(split.where(F.col("split") == "train"))
    train = materialize(enc.transform(split.where(F.col("split") == "train"), keep=["contact_id", "y"]), "encoded-train")
    out = smote(train, enc.feature_names(), "y", "contact_id", k=5, seed=SEED, nominal=enc.nominal_features())
    return out.groupBy("y", "synthetic").agg(F.count("*").alias("n"))


_SCALED = ", ".join(f"(CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM t)) / (SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM t) AS {c}"
                    for c in NUM)
_APART = (" + ".join(f"2 * CAST(a.{c} <> b.{c} AS INTEGER)" for c in _NOMINAL) + " + (a.o - b.o) * (a.o - b.o) + "
          + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in NUM))


@query("smote_neighbours", f"""{SPLIT_CTE},
t AS (SELECT * FROM split WHERE split = 'train'),
m AS (SELECT contact_id, {_SCALED}, CAST(list_position({PRIORITY_ORDER}, priority) AS DOUBLE) AS o, {", ".join(_NOMINAL)}
      FROM t WHERE y = (SELECT y FROM t GROUP BY y ORDER BY count(*), CAST(y AS VARCHAR) LIMIT 1)),
d AS (SELECT a.contact_id, b.contact_id AS nb_id, sqrt({_APART}) AS distance FROM m a JOIN m b ON a.contact_id <> b.contact_id)
SELECT contact_id, CAST(nb_rank AS INTEGER) AS nb_rank, nb_id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY distance, nb_id) AS nb_rank FROM d)
WHERE nb_rank <= 5""")
def q_smote_neighbours(spark, sf):
    """The five nearest minority rows of every minority row of the encoded training split."""
    from ..operators.neighbours import knn

    split = split_contacts(spark, sf)
    enc = encoder_for(split.where(F.col("split") == "train"))
    train = materialize(enc.transform(split.where(F.col("split") == "train"), keep=["contact_id", "y"]), "encoded-train")
    sizes = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    minority = min(sizes, key=lambda c: (sizes[c], str(c)))
    names = enc.feature_names()
    position = {c: i for i, c in enumerate(names)}
    rows = train.where(F.col("y") == minority).select("contact_id", F.array(*[F.col(f"`{c}`") for c in names]).alias("v"))
    found = knn(rows, "contact_id", "v", 5, nominal=[[position[c] for c in g] for g in enc.nominal_features()])
    return found.select(F.col("id").alias("contact_id"), "nb_rank", "nb_id", F.round("distance", 6).alias("distance"))


def _tree_attributions(spark, sf):
    from ..operators.attribution import tree_attributions

    enc, r = _fit(spark, sf, "XGBoost")
    test = _encoded(spark, sf)[1].where(F.col("split") == "test")
    return tree_attributions(test, r["model"], enc.feature_names(), "contact_id")


@query("tree_attribution_rank")
def q_tree_rank(spark, sf):
    """M10 for the boosted model: mean |TreeSHAP| per feature on the test split."""
    return scoring.attribution_rank(_tree_attributions(spark, sf))


@query("attribution_dependence")
def q_dependence(spark, sf):
    """Total price, its attribution and the account balance per test contact."""
    attr = _tree_attributions(spark, sf)
    return scoring.attribution_dependence(attr, "contact_id", "num__total_price", "num__acct_balance")
