"""Chunking and vector search against brute force."""

import numpy as np
import pytest

from leadlens.operators import retrieval


def test_chunk_windows(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([(1, "  " + text + "\n"), (2, "   "), (3, "a b c"), (4, None)],
                               "doc_id long, text string")
    out = retrieval.chunk_documents(df, size=512, overlap=64).orderBy("doc_id", "chunk_id").collect()
    d1 = [r for r in out if r["doc_id"] == 1]
    assert [r["start_token"] for r in d1] == [0, 448, 896]
    assert [r["n_tokens"] for r in d1] == [512, 512, 104]
    assert d1[1]["text"].split()[0] == "w448"
    assert not [r for r in out if r["doc_id"] in (2, 4)]
    assert [r["text"] for r in out if r["doc_id"] == 3] == ["a b c"]


def test_vector_top_k_brute_force(spark):
    rng = np.random.default_rng(1)
    corpus = rng.normal(size=(60, 8))
    queries = rng.normal(size=(4, 8))
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(corpus)],
                                "vec_id long, embedding array<double>")
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)],
                                "qid long, embedding array<double>")
    for max_b in (10, 2):      # one broadcast batch, and several
        top = retrieval.vector_top_k(qdf, cdf, "qid", ["vec_id"], k=3, max_broadcast=max_b)
        got = {(r["qid"], r["rank"]): r["vec_id"] for r in top.collect()}
        for qi, q in enumerate(queries):
            sims = corpus @ q / (np.linalg.norm(corpus, axis=1) * np.linalg.norm(q))
            want = np.argsort(-sims, kind="stable")[:3]
            assert [got[(qi, r)] for r in (1, 2, 3)] == list(want)


def test_embedding_counts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "")], "id long, text string")
    rows = {r["id"]: r["embedding"] for r in retrieval.embed_chunks(df, ["id"], dims=16).collect()}
    assert sum(rows[1]) == 3 and max(rows[1]) == 2 and sum(rows[2]) == 0


def test_read_index_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        retrieval.read_index(spark, str(tmp_path / "nope"))


def test_conversation_history(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "q"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = retrieval.conversation_history(df).orderBy("conv_id", "turn").collect()
    assert [r["position"] for r in out] == [1, 2, 3, 1]
    assert [r["prior_user_turns"] for r in out] == [0, 1, 1, 0]


def test_build_and_read_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 300), (2, "delta epsilon")], "doc_id long, text string")
    path = str(tmp_path / "index")
    built = retrieval.build_index(docs, path, size=128, overlap=16, dims=32)
    back = retrieval.read_index(spark, path)
    assert back.count() == built.count() == 8 + 1
    assert set(back.columns) >= {"doc_id", "chunk_id", "text", "embedding"}
    q = retrieval.embed_chunks(spark.createDataFrame([(0, "delta epsilon")], "qid long, text string"),
                               ["qid"], dims=32)
    top = retrieval.vector_top_k(q, back, "qid", ["doc_id", "chunk_id"], k=1).first()
    assert top["doc_id"] == 2 and top["similarity"] == pytest.approx(1.0)


def test_vector_top_k_ties_break_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40, 0, -1)] + [(100 + i, [0.0, 1.0]) for i in range(5)]
    cdf = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    qdf = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0])], "qid long, embedding array<double>")
    top = retrieval.vector_top_k(qdf, cdf, "qid", ["vec_id"], k=3)
    got = {(r["qid"], r["rank"]): (r["vec_id"], r["similarity"]) for r in top.collect()}
    assert [got[(0, i)][0] for i in (1, 2, 3)] == [1, 2, 3]
    # a zero query vector has no similarity: NULLs, still k rows ordered by id
    assert [got[(1, i)] for i in (1, 2, 3)] == [(1, None), (2, None), (3, None)]


def test_md5_bucket_counts_match_spark_expression(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "Ça va? Très bien, merci. ça VA"), (2, "x y z x"), (3, None)],
                               "id long, text string")
    fast = {r["id"]: r["embedding"] for r in retrieval.embed_chunks(df, ["id"], dims=64, hash_fn="md5").collect()}
    slow = {r["id"]: r["e"] for r in df.select(
        "id", retrieval._bincounter(64)(retrieval.token_buckets(F.col("text"), 64, "md5")).alias("e")).collect()}
    assert fast == slow


def test_read_documents_whole_files(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.md").write_text("# Title\n\nfirst line\nsecond line\n")
    (d / "b.txt").write_text("another document")
    docs = retrieval.read_documents(spark, str(d)).orderBy("path").collect()
    assert len(docs) == 2
    assert docs[0]["text"].startswith("# Title") and "second line" in docs[0]["text"]
    assert docs[0]["doc_id"] != docs[1]["doc_id"]
    idx = retrieval.build_index(spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs],
                                                      "doc_id long, text string"), size=4, overlap=1, dims=16)
    assert idx.count() == 3            # a: 6 tokens -> windows at 0 and 3; b: 2 tokens -> one window


def test_tokens_are_counted_in_arrow_slices(monkeypatch):
    import hashlib
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    monkeypatch.setattr(retrieval, "COUNT_ROWS", 3)
    lists = [["a", "b", "a"], [], None, ["é", "a"], ["b"] * 5, None, []]
    bucket = {t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 16 for t in ("a", "b", "é")}
    want = [None if x is None else [Counter(bucket[t] for t in x)[i] for i in range(16)] for x in lists]
    counts = retrieval._md5_bucket_counter(16).func
    assert counts(pa.array(lists, pa.list_(pa.string()))).to_pylist() == want
    assert counts(pa.array(lists, pa.list_(pa.string())).slice(2, 4)).to_pylist() == want[2:6]
    assert counts(pa.array([], pa.list_(pa.string()))).to_pylist() == []
    ids = [None if x is None else [bucket[t] for t in x] for x in lists]
    assert retrieval._bincounter(16).func(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == want

    monkeypatch.setattr(retrieval, "COUNT_ROWS", 256)
    many = pa.array([[f"w{i % 97}" for i in range(500)]] * 4000)  # 2 M tokens, as Python strings over 100 MB
    tracemalloc.start()
    found = counts(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 4000 and sum(found[7].as_py()) == 500 and peak < 20e6
