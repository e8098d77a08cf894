"""The contacts view with one customer holding a third of all orders."""

import numpy as np
import pandas as pd

from leadlens.sources.tables import contacts


def test_hot_customer_history(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 3000
    cust = np.where(np.arange(n) % 3 == 0, 7, rng.integers(1, 200, size=n))     # customer 7: 1/3
    orders = pd.DataFrame({
        "o_orderkey": np.arange(n, dtype=np.int64),
        "o_custkey": cust.astype(np.int64),
        "o_orderstatus": rng.choice(["F", "O", "P"], size=n),
        "o_totalprice": rng.uniform(1, 1000, size=n).round(2),
        "o_orderdate": pd.Timestamp("1995-01-01") + pd.to_timedelta(rng.integers(0, 2000, size=n), unit="D"),
        "o_orderpriority": rng.choice(["1-URGENT", "5-LOW"], size=n)})
    customer = pd.DataFrame({"c_custkey": np.arange(1, 200, dtype=np.int64), "c_name": "x",
                             "c_nationkey": np.int32(1), "c_acctbal": 1.0, "c_mktsegment": "BUILDING"})
    nation = pd.DataFrame({"n_nationkey": [np.int32(1)], "n_name": ["N"], "n_regionkey": [np.int32(2)]})
    region = pd.DataFrame({"r_regionkey": [np.int32(2)], "r_name": ["R"]})
    for name, pdf in [("orders", orders), ("customer", customer), ("nation", nation), ("region", region)]:
        spark.createDataFrame(pdf).write.parquet(str(tmp_path / f"{name}.parquet"))

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = contacts(spark, str(tmp_path)).toPandas().set_index("contact_id").sort_index()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)

    o = orders.sort_values(["o_custkey", "o_orderdate", "o_orderkey"])
    g = o.groupby("o_custkey")
    o["previous"] = g.cumcount()
    prev_date = g["o_orderdate"].shift(1)
    o["pdays"] = (o["o_orderdate"] - prev_date).dt.days.fillna(999).astype(int)
    prev_status = g["o_orderstatus"].shift(1)
    o["poutcome"] = np.where(prev_status.isna(), "nonexistent", np.where(prev_status == "F", "success", "failure"))
    want = o.set_index("o_orderkey").sort_index()
    assert len(got) == n
    assert (got["previous"].to_numpy() == want["previous"].to_numpy()).all()
    assert (got["pdays"].to_numpy() == want["pdays"].to_numpy()).all()
    assert (got["poutcome"].to_numpy() == want["poutcome"].to_numpy()).all()
    assert got.loc[got["customer_id"] == 7, "previous"].max() == (cust == 7).sum() - 1
