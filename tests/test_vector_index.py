"""Exact ids and null vectors, weighted embeddings, and the cell-partitioned index against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadlens.operators import retrieval, vector_index

BIG = 9007199254740993


def brute(queries, corpus, k):
    """(query number, rank, id, similarity): ids ascending, None first, zero vectors last."""
    out = []
    for n, (qid, q) in enumerate(queries):
        if q is None or any(x is None for x in q):
            continue
        rows = []
        for i, v in corpus:
            if v is None or any(x is None for x in v):
                continue
            a, b = np.linalg.norm(q), np.linalg.norm(v)
            s = float(np.dot(q, v) / (a * b)) if a * b else None
            rows.append((1 if s is None else 0, -round(s or 0, 12), (i is not None, i or 0), i, s))
        out += [(qid, r + 1, i, s) for r, (_, _, _, i, s) in enumerate(sorted(rows, key=lambda t: t[:3])[:k])]
    return out


def make(seed=1, n=300, dims=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims)) * 4
    corpus = [(BIG + i, (centre[i % 6] + rng.normal(size=dims) * 0.3).tolist()) for i in range(n)]
    corpus += [(None, corpus[0][1]), (None, None), (7, None), (8, [None] * dims), (9, [0.0] * dims), (10, corpus[3][1])]
    queries = [(BIG + i, corpus[i * 7][1]) for i in range(5)] + [(None, rng.normal(size=dims).tolist()), (3, [0.0] * dims), (4, None)]
    return queries, corpus


def frames(spark, queries, corpus):
    return (spark.createDataFrame(queries, "qid long, embedding array<double>"),
            spark.createDataFrame(corpus, "vec_id long, embedding array<double>").repartition(4))


def shown(rows):
    return sorted(((r["qid"], r["rank"], r["vec_id"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in rows), key=repr)


def want_of(queries, corpus, k):
    return sorted(((q, r, i, None if s is None else round(s, 9)) for q, r, i, s in brute(queries, corpus, k)), key=repr)


def test_top_k_keeps_ids_and_leaves_null_vectors_out(spark):
    queries, corpus = make()
    q, c = frames(spark, queries, corpus)
    for batch in (100, 2):
        got = retrieval.vector_top_k(q, c, "qid", ["vec_id"], k=4, max_broadcast=batch).collect()
        assert shown(got) == want_of(queries, corpus, 4)


def test_cells_give_the_same_rows_and_skip_most_cells(spark, tmp_path):
    queries, corpus = make(seed=4, n=600)
    q, c = frames(spark, queries, corpus)
    path = str(tmp_path / "cells")
    vector_index.build_cells(c, ["vec_id"], path, n_cells=12)
    assert sum(r.n for r in spark.read.parquet(f"{path}/centroids").collect()) == 603
    got = vector_index.search_cells(spark, path, q, "qid", k=4).collect()
    assert shown(got) == want_of(queries, corpus, 4)
    near = [r for r in got if r["qid"] not in (None, 3)]
    assert near and min(r["cells_skipped"] for r in near) >= 6
    everything = vector_index.search_cells(spark, path, q, "qid", k=700).collect()
    assert shown(everything) == want_of(queries, corpus, 700)
    with pytest.raises(FileNotFoundError):
        vector_index.search_cells(spark, str(tmp_path / "none"), q, "qid")


def test_one_hot_cell_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 2)
    corpus = [(i, [1.0, 0.0]) for i in range(200)] + [(500 + i, [math.cos(i), math.sin(i)]) for i in range(50)]
    queries = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.2]), (4, [1.0, 0.0])]
    q, c = frames(spark, queries, corpus)
    vector_index.build_cells(c, ["vec_id"], str(tmp_path / "c"), centroids=np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]))
    got = vector_index.search_cells(spark, str(tmp_path / "c"), q, "qid", k=6).collect()
    assert shown(got) == want_of(queries, corpus, 6)


def test_weights_are_saved_with_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha gamma"), (3, "delta"), (4, None)], "doc_id long, text string")
    path = str(tmp_path / "w")
    rows = retrieval.build_weighted_index(docs, path, size=16, overlap=2, dims=64, hash_fn="md5").collect()
    model = {r.bucket: r for r in spark.read.parquet(f"{path}/idf").collect()}
    assert all(r.n == 3 and r.idf == pytest.approx(math.log(4 / (1 + r.df)) + 1) for r in model.values())
    for r in rows:
        assert math.sqrt(sum(x * x for x in r.embedding)) == pytest.approx(1)
    one = next(r.embedding for r in rows if r.doc_id == 1)
    a, b = (retrieval.embed_chunks(spark.createDataFrame([(0, t)], "i long, text string"), ["i"], dims=64, hash_fn="md5")
            .first().embedding.index(1) for t in ("alpha", "beta"))
    assert one[a] / one[b] == pytest.approx(2 * (math.log(4 / 3) + 1) / (math.log(4 / 2) + 1))
    q = retrieval.weighted_queries(spark.createDataFrame([(0, "alpha beta"), (1, "unknownword"), (2, "")], "qid long, text string"), path,
                                   ["qid"], dims=64, hash_fn="md5")
    best = retrieval.vector_top_k(q, spark.read.parquet(f"{path}/chunks"), "qid", ["doc_id"], k=1)
    assert {r["qid"]: r["doc_id"] for r in best.where(F.col("similarity") > 0).collect()}[0] == 1


def test_first_rows_by_hash_with_copies_counted(spark):
    vectors = [[float(i % 90), 1.0] for i in range(300)] + [[5.0, 5.0]] * 400
    rows = spark.createDataFrame([(v,) for v in vectors], "v array<double>").select("v", F.xxhash64("v", F.lit(42)).alias("k")).repartition(5)
    ordered = [tuple(r) for r in rows.orderBy("k", "v").collect()]
    for n in (1, 37, 250, 600, 5000):
        got = vector_index.first_rows(rows, n).orderBy("k", "v").collect()
        assert [(r.v, r.k) for r in got for _ in range(r.w)] == ordered[:n]
    assert vector_index.first_rows(rows.where("false"), 5).collect() == []


def test_groups_of_blocks_and_parts_of_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 8)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 3)
    queries, corpus = make(seed=6, n=200)
    queries += [(50 + i, corpus[i * 3][1]) for i in range(20)]
    q, c = frames(spark, queries, corpus)
    vector_index.build_cells(c, ["vec_id"], str(tmp_path / "c"), n_cells=4)
    for part, group in ((1 << 20, 1 << 20), (64 * 5, 64 * 20)):
        monkeypatch.setattr(vector_index, "PART_BYTES", part)
        monkeypatch.setattr(vector_index, "GROUP_BYTES", group)
        assert shown(vector_index.search_cells(spark, str(tmp_path / "c"), q, "qid", k=4).collect()) == want_of(queries, corpus, 4)
