import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leadlens.llm import exact_dedup
from tests.conftest import SF_SMALL
from tests.oracle_util import compare, duck

LOWER = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())


def brute(rows):
    """Without ``kept``, which is checked by group."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id int, text string, rec string, h int, n int")
    got = exact_dedup.exact_duplicates(df.repartition(5), **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    kept = defaultdict(list)
    for r in got:
        kept[r.text_sha256] += [r.doc_id] if r.kept else []
    assert all(len(v) == 1 for v in kept.values())
    assert all(v[0] == r.keep_id for r in got for v in [kept[r.text_sha256]])
    return got


ODD = [(None, "null id"), (None, "NULL ID"), (3, "null id"), (4, None), (5, ""), (6, None), (7, "same"), (7, "same"), (7, "Same"),
       (8, "ÄÖ"), (9, "äö"), (10, "Äö"), (11, " same"), (12, "Long " * 60000), (13, "lOng " * 60000), (None, "alone"), (None, "alone")]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(100 + i, rng.choice(["a", "B", "b", "text %d" % rng.randrange(60), "TEXT %d" % rng.randrange(60)])) for i in range(600)]
    check(spark, rows + ODD)


def test_hot_contents_and_overfull_buckets_are_partitioned_again(spark):
    rng = random.Random(2)
    hot = "copied page " * 300
    rows = [(i, rng.choice([hot, hot.upper(), hot + "!", "t%d " % rng.randrange(40) * 200])) for i in range(300)]
    # tables of one row or so, and buckets of two contents
    check(spark, rows + ODD, leaf_bytes=9000, table_bytes=1)


def test_a_hash_that_says_little_is_followed_by_the_content():
    t = exact_dedup.ContentTable()
    names = [b"%d" % (i % 700) for i in range(3000)]
    got = [t.place(5, n) for n in names]
    assert len(t.contents) == 700 and all(t.contents[g] == n for g, n in zip(got, names))


def test_empty_table_and_kept_rows_with_their_columns(spark):
    assert check(spark, []) == []
    rows = [(1, "a", 10), (2, "A", 20), (2, "a", 30), (3, None, 40), (None, "", 50), (None, "x", 60), (None, "X", 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __n int")
    got = exact_dedup.deduplicate(df)
    assert got.columns == ["doc_id", "text", "__n"]
    found = {(r.doc_id, (r.text or "").lower()) for r in got.collect()}
    assert found == {(2, "a"), (3, ""), (None, "x")} and got.count() == 3


def test_rows_leave_a_task_once_per_table(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text")).repartition(4)
    assert exact_dedup.records(docs).filter("best").count() <= 4


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_oracle(spark, sf):
    ok, message = compare(exact_dedup.query(spark, sf), duck(sf), exact_dedup.SQL)
    assert ok, message
