"""ordered_scan equals window functions, including hot and global groups."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadlens.operators.ordered import ordered_scan, top_k_per_group

from .conftest import SF_ORACLE


@pytest.fixture(scope="module")
def lines(spark):
    li = spark.read.parquet(f"{SF_ORACLE}/lineitem.parquet")
    # a cached unique row id gives every test a total order
    out = li.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate",
                    F.monotonically_increasing_id().alias("rid")).cache()
    out.count()
    return out


@pytest.mark.parametrize("by", [[], ["l_returnflag"], ["l_orderkey"]])
def test_matches_window(spark, lines, by):
    out = ordered_scan(lines, by, ["l_shipdate", "rid"], row_number="rn",
                       running={"q": "l_quantity", "ln": "l_linenumber"},
                       lags={"prev_q": "l_quantity", "prev_d": "l_shipdate"}, num_partitions=7)
    w = Window.partitionBy(*[F.col(b) for b in by] or [F.lit(1)]).orderBy("l_shipdate", "rid")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = lines.select("rid", F.row_number().over(w).alias("rn_r"),
                       F.sum("l_quantity").over(run).alias("q_r"),
                       F.sum("l_linenumber").over(run).alias("ln_r"),
                       F.lag("l_quantity").over(w).alias("pq_r"),
                       F.lag("l_shipdate").over(w).alias("pd_r"))
    j = out.join(ref, "rid")
    bad = j.where((F.col("rn") != F.col("rn_r")) | (F.abs(F.col("q") - F.col("q_r")) > 1e-6)
                  | (F.col("ln") != F.col("ln_r")) | ~F.col("prev_q").eqNullSafe(F.col("pq_r"))
                  | ~F.col("prev_d").eqNullSafe(F.col("pd_r")))
    assert j.count() == lines.count()
    assert bad.count() == 0


def test_one_hot_key_spanning_all_partitions(spark):
    # a single key holding every row: still spread over all partitions
    df = spark.range(0, 5000).select(F.lit("hot").alias("k"), F.col("id"),
                                     (F.col("id") % 3).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered_scan(df, ["k"], ["id"], row_number="rn", running={"s": "v"}, num_partitions=6)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    pdf = out.orderBy("id").toPandas()
    assert list(pdf["rn"]) == list(range(1, 5001))
    assert list(pdf["s"]) == list((pdf["id"] % 3).cumsum())
    per_task = out.groupBy(F.spark_partition_id()).count().count()
    assert per_task > 1


def test_top_k_plans_partial_group_limit(spark):
    li = spark.read.parquet(f"{SF_ORACLE}/lineitem.parquet")
    top = top_k_per_group(li, ["l_returnflag"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber"], 3)
    assert len(top.collect()) == 9
    plan = top._jdf.queryExecution().executedPlan().toString()
    # each map task keeps at most k rows per group before the shuffle
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scratch_tables_are_removed(spark):
    import os

    from leadlens import session

    df = spark.range(100).select(F.lit(1).alias("g"), "id")
    out = ordered_scan(df, ["g"], ["id"], row_number="rn")
    assert out.count() == 100
    paths = list(session._written)
    assert paths and all(os.path.exists(p.replace("file:", "")) for p in paths if p.startswith("/"))
    assert session.cleanup_scratch(spark) >= 1
    assert not any(os.path.exists(p) for p in paths if p.startswith("/"))


def test_types_pass_through_unchanged(spark):
    import datetime as dt
    from decimal import Decimal

    rows = [(1, 9007199254740993, True, Decimal("12345678901234567890.12"), dt.datetime(9999, 12, 30, 23, 59), 1),
            (1, None, None, None, None, 2),
            (1, 9007199254740995, False, Decimal("0.01"), dt.datetime(1900, 1, 1), 3),
            (None, -9007199254740993, None, None, None, 4)]
    df = spark.createDataFrame(rows, "g int, big long, flag boolean, dec decimal(38,2), ts timestamp, `o.1` int")
    out = ordered_scan(df, ["g"], ["o.1"], row_number="rn", running={"s": "big", "f": "flag"}, lags={"prev": "big", "pf": "flag"},
                       num_partitions=3).orderBy("`o.1`")
    assert out.select(*[f"`{c}`" for c in df.columns]).collect() == df.orderBy("`o.1`").collect()
    got = [tuple(r)[6:] for r in out.collect()]
    assert got == [(1, 9007199254740993, 1, None, None), (2, 9007199254740993, 1, 9007199254740993, True),
                   (3, 18014398509481988, 1, None, None), (1, -9007199254740993, 0, None, None)]
