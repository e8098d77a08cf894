import hashlib
import random

import numpy as np
import pytest

from leadlens.llm import substrings, suffixes
from leadlens.llm.suffixes import WINDOW
from tests.conftest import SF_SMALL


def brute(rows):
    bodies = [(d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, b in bodies:
        for i in range(len(b) - WINDOW + 1):
            w = b[i:i + WINDOW]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - WINDOW + 1):
            if seen[b[i:i + WINDOW]] > 1:
                gone[i:i + WINDOW] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(rng.choice([100, 180, 201, 230, 400, 900])) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = [text(rng.choice([0, 5, 60, 300]))]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            piece = rng.choice(shared)
            if rng.random() < 0.4:
                a = rng.randrange(len(piece))
                piece = piece[a:a + rng.randint(1, 500)]
            parts += [piece, text(rng.choice([0, 1, 40]))]
        rows.append((i, "".join(parts)))
    rows += [(70, None), (71, ""), (72, "x" * 700), (73, "x" * 199), (74, "ab" * 300), (75, "x" * 200), (None, shared[5] + "tail"),
             (78, "y" * 3000), (79, "abc" * 900 + shared[2] + "abc" * 300), (80, "z" * 450 + "q" + "z" * 450), (81, ("k" * 70 + "-") * 30),
             (76, "unique " + text(900)), (76, "unique " + text(500)), (77, "same row " * 60), (77, "same row " * 60)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 50_000), (2, 1), (3, 4)])
def test_equals_brute_force(spark, seed, hot, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(substrings, "HEAVY", {1: 1000, 2: 7, 3: 1}[seed])  # salted grams
    if seed == 3:
        monkeypatch.setattr(substrings, "CHUNK", 300)  # long texts in chunks, short slices
        monkeypatch.setattr(substrings, "RUN_BYTES", 3000)  # many runs a range
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id int, text string, body string").repartition(5)
    got = sorted((tuple(r)[:5] for r in substrings.remove_repeats(docs, hot=hot).collect()), key=repr)
    assert got == brute(rows)


def test_spans_and_empty(spark):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefg ") for _ in range(400))
    docs = spark.createDataFrame([(1, "zz" + body[:250]), (2, body), (3, "other")], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substrings.remove_repeats(docs).collect()}
    assert got == {1: [(2, 252)], 2: [(0, 250)], 3: []}
    assert substrings.remove_repeats(docs.limit(0)).collect() == []


def test_front_coding_and_loser_tree():
    rng = random.Random(3)
    for _ in range(60):
        runs, everything = [], []
        for _ in range(rng.randint(1, 9)):
            entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))), rng.randint(1, 2)) for _ in range(rng.randint(1, 30))]
            everything += entries
            run = suffixes.sort_run({e: entries.count(e) > 1 for e in entries})
            blob = suffixes.encode_run(run)
            assert [(k, r, m) for _, k, r, m in suffixes.decode_run(blob)] == run
            runs.append(blob)
        merged = list(suffixes.merge_runs(runs))
        assert [(k, r) for _, k, r, _ in merged] == sorted(set(everything))
        for (_, x, _, _), (h, y, _, _) in zip(merged, merged[1:]):
            assert h == suffixes.common_prefix(x, y) == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        assert all(m == (everything.count((k, r)) > 1) for _, k, r, m in merged)
    assert list(suffixes.merge_runs([])) == []


def test_anchors_serve_every_window_once():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 150, 350, 350, 1700, 5000])
    row, _, p, lo, hi = suffixes.anchors(raw, offsets)
    served = sorted((r, w) for r, a, b in zip(row, lo, hi) for w in range(a, b + 1))
    assert served == [(r, w) for r in range(6) for w in range(offsets[r + 1] - offsets[r] - WINDOW + 1)]
    assert (p >= hi).all() and (p + suffixes.GRAM <= lo + WINDOW).all()


def test_a_period_is_one_entry_and_hot_hulls_leave_a_task_once(spark):
    raw = np.frombuffer(b"x" * 400_000, np.uint8)
    (_, _, found), = substrings.anchors_of(raw, np.array([0, len(raw)]))
    assert len(found[0]) <= 3 and found[5].max() > 390_000
    docs = spark.createDataFrame([(i, "w" * 5000 + "the same text, but for its number " * 20) for i in range(300)], "doc_id long, text string")
    rows = docs.repartition(4).selectExpr("doc_id", "text", "array_repeat(0, 0) AS none")
    at = "transform(sequence(0, 60), x -> x)"
    placed = substrings._place(rows.selectExpr("doc_id", "text", f"{at} AS at", f"{at} AS hot"), 4)
    hot = placed.filter("key IS NOT NULL").groupBy("name").count().collect()
    assert hot and max(r["count"] for r in hot) <= 4
    got = substrings.remove_repeats(spark.createDataFrame([(1, "x" * 10_000_000), (2, "x" * 300)], "doc_id long, text string"))
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got.orderBy("doc_id").collect()] == [(1, 10_000_000, 10_000_000, 1), (2, 300, 300, 1)]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substrings.query(spark, SF_SMALL).collect()), key=repr) == brute(rows)
