import random
import re

import numpy as np
import pyarrow as pa
import pytest

from leadlens.llm import decontaminate as d
from leadlens.llm.shingles import SIGNS, words
from tests.conftest import SF_SMALL


def brute_words(text):
    return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_words_are_letter_and_digit_runs():
    items = ["One-two, three.\nÉa b4!", "", "...", "x"]
    hashes, at = words(pa.array(items), SIGNS)
    assert np.diff(at).tolist() == [len(brute_words(t)) for t in items] == [5, 0, 0, 1]


def brute_common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 90))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert d._common(d._masks(np.array(a)), len(a), b) == brute_common(a, b)


def test_randomised_svd_spans_the_passages(spark):
    rng = np.random.default_rng(0)
    passages = [rng.integers(0, 60, 12) for _ in range(30)]
    idf = rng.uniform(0.5, 3, 60)
    a = np.zeros((30, 60))
    for i, p in enumerate(passages):
        np.add.at(a[i], p, 1)
    a *= idf
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = d.latent_space(spark, passages, idf, rank=30)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8) and np.allclose(a @ v @ v.T, a, atol=1e-6)
    top = d.latent_space(spark, passages, idf, rank=5)
    assert np.linalg.norm(a @ top) > 0.98 * np.linalg.norm(a @ np.linalg.svd(a)[2][:5].T)


def make(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6)))
    common = [word() for _ in range(30)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [text(rng.choice([15, 30, 60, 200])) for _ in range(30)]
    docs, want = [], set()
    for i in range(150):
        body = text(rng.choice([0, 3, 50, 400]))
        if i % 5 == 0:
            k = rng.randrange(len(items))
            at = rng.randint(0, len(body))
            leak = list(items[k])
            if i % 10 == 0:  # a paraphrase: some words replaced, one in eight
                for j in range(0, len(leak) - len(leak) // 5 - 3, 8):
                    leak[j] = word()
            body = body[:at] + leak + body[at:]
            want.add((i, k))
        docs.append((i, " ".join(body).upper() if i % 15 == 0 else ",\n".join(body)))
    return docs, [(k, " ".join(t)) for k, t in enumerate(items)], want


@pytest.mark.parametrize("blocks, shared", [(1000, 20), (7, 20), (9, 2)])
def test_leaks_and_clean_documents(spark, blocks, shared, monkeypatch):
    monkeypatch.setattr(d, "ITEM_BLOCK", blocks)
    monkeypatch.setattr(d, "PASS_BLOCKS", shared)
    docs, items, want = make()
    docs += [(900, None), (901, ""), (None, items[3][1]), (902, items[4][1] + " tail"), (902, items[4][1] + " tail")]
    items += [(90, None), (91, ""), (92, "too short"), (4, items[4][1])]
    want |= {(None, 3), (902, 4)}
    df = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id int, text string, share double").repartition(4)
    got = d.leaks(df, spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, cosine int"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_answers_and_empty_tables(spark):
    item = "which of these old towers stands by the northern river of the quiet city today"
    text = "which of many old towers sits near a northern river in the quiet city today "
    docs = spark.createDataFrame([(1, text + "the answer is blue harbour gate"), (2, text + "nobody knows")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, "blue harbour gate")], "item_id long, text string, answer string")
    assert [(r.doc_id, r.item_id) for r in d.leaks(docs, bench).collect()] == [(1, 7)]
    assert d.leaks(docs.limit(0), bench).collect() == [] and d.leaks(docs, bench.limit(0)).collect() == []


def test_query_finds_every_verbatim_item(spark):
    docs = [(r.doc_id, brute_words(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, brute_words(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    joined = [(i, " " + " ".join(w) + " ") for i, w in docs]
    want = {(i, k) for i, t in joined for k, w in items if " " + " ".join(w) + " " in t}
    got = {(r.doc_id, r.item_id): r for r in d.query(spark, SF_SMALL).collect()}
    assert want <= set(got)
    for (i, k), r in got.items():  # nothing else but near copies of an item
        run, item = dict(docs)[i], dict(items)[k]
        assert (i, k) in want or brute_common(item, run) / len(item) >= d.PARAPHRASE


def test_item_on_a_third_of_the_short_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(15)]
    page = [word() for _ in range(10)] + item + [word() for _ in range(10)]
    reworded = [word() if i in (2, 7) else w for i, w in enumerate(item)]
    docs = [(i, " ".join(page if i % 10 < 3 else [word() for _ in range(40)])) for i in range(300)]
    docs.append((300, " ".join(reworded)))
    items = [(1, " ".join(item))] + [(k, " ".join(word() for _ in range(20))) for k in range(2, 12)]
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, 1) for i in range(301) if i % 10 < 3 or i == 300}


def test_a_thousand_short_and_long_items_against_brute_force(spark):
    rng = random.Random(4)
    texts = [brute_words(r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").limit(300).collect()]
    vocabulary = [w for t in texts for w in t]
    items, docs = [], [list(t) for t in texts]
    for k in range(1000):
        item = [rng.choice(vocabulary) for _ in range(rng.choice([5, 6, 7, 8, 9, 12, 20, 40, 60]))]
        items.append((k, " ".join(item)))
        doc, near = docs[k % len(docs)], list(item)
        if k % 5 == 0:  # a near copy: a fifth of the words replaced
            for j in rng.sample(range(len(item)), len(item) // 5):
                near[j] = "other"
        at = rng.choice([0, len(doc)])  # not inside an earlier one
        doc[at:at] = near + ([item[0]] * 60 if k % 7 == 0 else [])
    joined = [" " + " ".join(t) + " " for t in docs]
    want = {(i, k) for i, t in enumerate(joined) for k, item in items if " " + item + " " in t}
    assert len(want) > 750
    got = {(r.doc_id, r.item_id): r for r in d.leaks(
        spark.createDataFrame([(i, t) for i, t in enumerate(joined)], "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert want <= set(got)
    for i, k in got:
        item = items[k][1].split()
        assert (i, k) in want or brute_common(item, docs[i]) / len(item) >= d.PARAPHRASE


@pytest.mark.parametrize("hits", [1_000_000, 50])
def test_near_copies_meet_their_passages(hits, monkeypatch):
    monkeypatch.setattr(d, "SEED_HITS", hits)
    rng = random.Random(5)
    word = lambda: f"w{min(int(rng.expovariate(0.02)), 400)}"
    items = [[word() for _ in range(rng.randint(5, 64))] for _ in range(60)]
    passages = d.Passages([(k, " ".join(t), None) for k, t in enumerate(items)])
    n = len(passages.vocabulary)
    idf, frequency = np.ones(n), np.bincount(np.concatenate(passages.words), minlength=n)
    index = d.Index(passages, idf, np.random.default_rng(0).normal(size=(n, 3)), frequency)
    rows, want = [], set()
    for r in range(60):
        near = list(items[r])
        for j in rng.sample(range(len(near)), len(near) // 5):
            near[j] = word()
        before, after = ([word() for _ in range(rng.randint(0, 150))] for _ in range(2))
        rows.append(before + near + after)
        want.add((r, r))
    place = {int(v): i for i, v in enumerate(passages.vocabulary)}
    terms = [[place.get(int(h), -1) for h in hashes] for hashes in d.hashes([" ".join(t) for t in rows])]
    flat, at = np.array(sum(terms, []), np.int32), np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    got = {(r, p): s for r, p, _, s, _ in index.search(flat, at) if s >= d.VERBATIM}
    assert want <= set(got)
