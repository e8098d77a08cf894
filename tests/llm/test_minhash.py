import random
import re

import numpy as np
import pyarrow as pa
import pytest

from leadlens.llm import minhash
from leadlens.llm.components import components
from leadlens.llm.shingles import distinct, shingles


def brute_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if len(words) >= size else {tuple(words)}


def brute(rows, similarity):
    sets = [(d, brute_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def test_shingle_sets_equal_brute_force():
    items = ["", " ", "one", "One two", "a b c d e", "A b c d e f a b c d e f", "x y z\x0bw\tq\nr", "É é", "a  b   c d e f "]
    hashes, offsets = distinct(*shingles(pa.array(items)))
    seen = {}
    for i, text in enumerate(items):
        want = brute_set(text)
        assert offsets[i + 1] - offsets[i] == len(want), text
        if len(want) == 1:
            assert seen.setdefault(int(hashes[offsets[i]]), want) == want
    one = [distinct(*shingles(pa.array([t])))[0] for t in items]
    assert np.array_equal(np.concatenate(one), hashes)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.randint(1, 8)):
            now = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                now[rng.randrange(len(now))] = word()
            rows.append(" ".join(now) if rng.random() < 0.7 else "  ".join(now).upper())
    rows += ["", None, " \n", "same", "SAME"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("similarity,block", [(80, 1024), (85, 1024), (85, 3)])
def test_components_equal_brute_force(spark, similarity, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_NODES", block)  # 3: many cells
    rows = corpus(similarity)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, node string, n int").repartition(4)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, similarity).collect())
    want = brute(rows, similarity)
    assert got == want
    assert any(not w[3] for w in want)


def test_empty_and_null_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (4, "a b c d e f g h")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (2, 2, True), (2, 2, True), (4, 4, True)]


def test_cells_are_rows_of_blocks(spark):
    """Sets travel in their block's row: rows grow with blocks, not with nodes."""
    made = []
    for n in (4_000, 16_000):
        groups = spark.range(n).selectExpr("0L AS leader", "id AS node", "2L AS n", "id = 0 AS near")
        sets = spark.range(n).selectExpr("id AS node", "cast('0123456701234568' AS binary) AS shingles")
        made.append(minhash._cells(minhash._blocks(groups, sets)).count())
    assert made[0] <= 4_000 / 50 and made[1] <= 16_000 / 50


def test_chained_components(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100, 200: 200}


def test_query_on_documents(spark):
    from tests.conftest import SF_SMALL

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in minhash.query(spark, SF_SMALL).collect()) == brute(rows, 85)


def test_family_that_its_leader_does_not_join(spark):
    """Copies with a few edits of a base that is no document itself: links go round the leader."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        now = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            now[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(now)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs, 85).collect()) == brute(rows, 85)
