"""Scans of the supplied Parquet tables and the ``contacts`` view (FX7).

``contacts`` stands in for the bank-marketing contact table: one row per order,
customer attributes joined in, and the contact-history columns (``previous``,
``pdays``, ``poutcome``) derived per customer in (o_orderdate, o_orderkey) order.
The per-customer history runs through :func:`ordered_scan`, so one customer with a
third of all orders is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan
from ..session import path_exists

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        if path_exists(spark, f"{sf_dir}/{name}.parquet"):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def contacts(spark: SparkSession, sf_dir: str, history: bool = True) -> DataFrame:
    """contact_id, customer_id, segment, region, priority, month, day_of_week,
    total_price, acct_balance, previous, pdays, poutcome, y.

    Without ``history`` the columns previous, pdays and poutcome are left out and the view is
    a plain join that filters and pruning pass through."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation (25 rows) and region (5 rows) are fixed-size dimension tables
    geo = read_table(spark, sf_dir, "nation").join(
        F.broadcast(read_table(spark, sf_dir, "region")),
        F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    cust = customer.join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))

    past = []
    if history:
        orders = ordered_scan(
            orders, by=["o_custkey"], order=["o_orderdate", "o_orderkey"],
            row_number="__seq",
            lags={"__prev_date": "o_orderdate", "__prev_status": "o_orderstatus"})
        past = [
            (F.col("__seq") - 1).cast("int").alias("previous"),
            F.coalesce(F.datediff(F.to_date("o_orderdate"), F.to_date("__prev_date")),
                       F.lit(999)).cast("int").alias("pdays"),
            F.when(F.col("__prev_status").isNull(), "nonexistent")
             .when(F.col("__prev_status") == "F", "success")
             .otherwise("failure").alias("poutcome"),
        ]
    joined = orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("contact_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.col("o_orderpriority").alias("priority"),
        F.lower(F.date_format("o_orderdate", "MMM")).alias("month"),
        F.lower(F.date_format("o_orderdate", "EEE")).alias("day_of_week"),
        F.col("o_totalprice").alias("total_price"),
        F.col("c_acctbal").alias("acct_balance"),
        *past,
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("y"),
    )


CONTACTS_SQL = """
WITH h AS (
  SELECT o.*,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
         lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_date,
         lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_status
  FROM orders o
)
SELECT h.o_orderkey AS contact_id, h.o_custkey AS customer_id,
       c.c_mktsegment AS segment, r.r_name AS region, h.o_orderpriority AS priority,
       lower(strftime(h.o_orderdate, '%b')) AS month,
       lower(strftime(h.o_orderdate, '%a')) AS day_of_week,
       h.o_totalprice AS total_price, c.c_acctbal AS acct_balance,
       CAST(h.seq - 1 AS INTEGER) AS previous,
       CAST(coalesce(date_diff('day', CAST(h.prev_date AS DATE), CAST(h.o_orderdate AS DATE)), 999) AS INTEGER) AS pdays,
       CASE WHEN h.prev_status IS NULL THEN 'nonexistent'
            WHEN h.prev_status = 'F' THEN 'success' ELSE 'failure' END AS poutcome,
       CASE WHEN h.o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS y
FROM h
JOIN customer c ON h.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""
