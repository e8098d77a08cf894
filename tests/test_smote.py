"""SMOTE: exact neighbours and balanced classes (FX5)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.operators.smote import exact_knn, smote


def _fx5(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 10))
    y = [1] * 20 + [0] * 180
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(200)]
    cols = [f"f{j}" for j in range(10)]
    return spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{c} double" for c in cols)), x, cols


@pytest.mark.parametrize("block", [4, 16, 512])
def test_exact_knn_matches_brute_force(spark, block):
    df, x, cols = _fx5(spark)
    pts = df.select("id", F.array(*cols).alias("v"))
    got = {}
    for r in exact_knn(pts, "id", "v", 5, block_size=block).collect():
        got.setdefault(r["id"], {})[r["nb_rank"]] = r["nb_id"]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for i in range(200):
        order = [j for j in np.lexsort((np.arange(200), d[i])) if j != i][:5]
        assert [got[i][r] for r in range(1, 6)] == order


def test_smote_balances_classes(spark):
    df, x, cols = _fx5(spark)
    out = smote(df, cols, "y", "id", k=5, seed=42, block_size=8)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 180
    syn = out.where("synthetic")
    assert syn.count() == 160 and syn.select("id", "copy").distinct().count() == 160 and syn.where("copy < 1").count() == 0
    # synthetic rows lie on segments between minority rows: inside the minority bounding box
    lo = x[:20].min(0)
    hi = x[:20].max(0)
    for r in syn.select(*cols).collect():
        v = np.array(list(r))
        assert np.all(v >= lo - 1e-9) and np.all(v <= hi + 1e-9)
    again = smote(df, cols, "y", "id", k=5, seed=42, block_size=8).where("synthetic")
    assert syn.exceptAll(again).count() == 0


def test_exact_knn_with_heavy_ties(spark):
    # 40 identical rows plus a lattice: every row has many equally distant neighbours
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(40)]
    rows += [(100 + i, [float(i % 5), float(i // 5), 1.0]) for i in range(30)]
    pts = spark.createDataFrame(rows, "id long, v array<double>")
    x = {i: np.array(v) for i, v in rows}
    ids = sorted(x)
    got = {}
    for r in exact_knn(pts, "id", "v", 5, block_size=8).collect():
        got.setdefault(r["id"], {})[r["nb_rank"]] = r["nb_id"]
    for i in ids:
        cand = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in ids if j != i)
        assert [got[i][r] for r in range(1, 6)] == [j for _, j in cand[:5]]


def test_int_ids_and_copies(spark):
    df, x, cols = _fx5(spark)
    out = smote(df.withColumn("id", df["id"].cast("int")), cols, "y", "id", k=5, seed=42)
    rows = out.collect()
    assert len({(r["id"], r["copy"]) for r in rows}) == len(rows) == 360
    assert out.schema["id"].dataType.simpleString() == "int"


def test_cells_hold_few_blocks_however_little_is_pruned(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    apply = PandasCogroupedOps.applyInArrow

    def bounded(self, func, schema):
        def run(left, right):
            if left.num_rows > 1 or right.num_rows > 8:
                raise ValueError(f"{left.num_rows} and {right.num_rows} blocks in one group")
            return func(left, right)
        return apply(self, run, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", bounded)
    x = np.random.default_rng(6).integers(0, 2, (240, 12)).astype(float)  # indicators: every block is in reach
    pts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in exact_knn(pts, "id", "v", 5, block_size=4).collect():
        got.setdefault(r["id"], {})[r["nb_rank"]] = r["nb_id"]
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for i in range(240):
        order = [j for j in np.lexsort((np.arange(240), d[i])) if j != i][:5]
        assert [got[i][r] for r in range(1, 6)] == order


def test_extra_copies_go_to_the_first_hashes_without_a_sort(spark, monkeypatch):
    from leadlens.operators import smote as module

    def no_scan(*args, **kwargs):
        raise AssertionError("rows were sorted")

    df, x, cols = _fx5(spark)
    twice = df.unionByName(df.where("y = 1 AND id = 3")).unionByName(df.where("y = 1 AND id = 3"))
    lists = spark.createDataFrame([(i, r, (i + r) % 20, 1.0) for i in range(20) for r in range(1, 6)], "id long, nb_rank int, nb_id long, distance double")
    monkeypatch.setattr(module, "ordered_scan", no_scan)
    monkeypatch.setattr("leadlens.operators.neighbours.knn", lambda *a: lists)
    out = module.smote(df.where("id < 95"), cols, "y", "id")  # 75 to 20: two copies each, three for 15
    import hashlib
    order = sorted(range(20), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    got = {r["id"]: r["n"] for r in out.where("synthetic").groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: 3 if order.index(i) < 15 else 2 for i in range(20)}
    for wanted in (0, 1, 7, 8, 9, 10, 22):
        some = module._with_extra(twice.where("y = 1").withColumn("__h", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))), wanted)
        assert some.count() == 22 and some.agg(F.sum("__extra")).first()[0] == wanted
