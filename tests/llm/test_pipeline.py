import re
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from leadlens.llm import decontaminate, pii, quality
from tests.conftest import SF_SMALL
from tests.llm.test_decontaminate import brute_common, brute_words
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_packing import check_gapless


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cp.materialize(stage(spark, out[-1], SF_SMALL), name))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_duplicates", "benchmark_decontamination", "personal_data", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_quality_stage_agrees_with_the_scores(spark, stages):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").selectExpr("doc_id", "quality AS label")
    scores = quality.classify(stages[0], labels).filter("predicted = 1").collect()
    assert set(rows_of(stages[1])) == {r.doc_id for r in scores}
    truth = {r.doc_id: r.label for r in labels.collect()}
    lost = [d for d in rows_of(stages[0]) if d not in rows_of(stages[1])]
    assert lost and all(truth.get(d, 0) == 0 for d in lost)


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    want = brute_groups([(d, r.text) for d, r in before.items()], 80)
    assert set(after) == {d for d, _, _, kept in want if kept} and len(after) < len(before)
    assert all(after[d] == before[d] for d in after)


def test_decontamination_stage(spark, stages):
    items = [brute_words(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    before, after = rows_of(stages[2]), rows_of(stages[3])
    for d, r in before.items():
        words = brute_words(r.text)
        share = max(brute_common(i, words) / len(i) for i in items)
        joined = " " + " ".join(words) + " "
        if any(" " + " ".join(i) + " " in joined for i in items):
            assert d not in after
        elif d not in after:
            assert share >= decontaminate.PARAPHRASE


def test_personal_data_stage(stages):
    before, after = rows_of(stages[3]), rows_of(stages[4])
    assert set(before) == set(after)
    for d, r in after.items():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
        if not pii.base_spans(before[d].text) and not re.search("[0-9@]", before[d].text):
            assert r == before[d]


def test_packing_stage_and_run(spark, stages):
    got = stages[5].collect()
    check_gapless([r.sequence_id for r in got], [r.offset for r in got], [r.length for r in got], 4096)
    tokens = defaultdict(int)
    for r in got:
        tokens[r.doc_id] += r.length
    assert tokens == {r.doc_id: r.doc_tokens for r in got} and set(tokens) == set(rows_of(stages[4]))
    again = cp.run(spark, SF_SMALL).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_edges(spark, tmp_path):
    """Null ids and texts, repeated rows, an empty table and columns of other names."""
    rows = [(1, "alpha beta gamma delta epsilon zeta", 35), (1, "alpha beta gamma delta epsilon zeta", 35),
            (2, "alpha beta gamma delta epsilon zeta", 35), (None, "alpha beta gamma delta epsilon zeta", 35), (3, None, 0), (4, "", 0)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars long, row_key int")
    for sf, given in (("a", docs), ("b", docs.limit(0))):
        base = f"{tmp_path}/{sf}"
        given.write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        out = cp.run(spark, base).collect()
        assert sorted(str(r.doc_id) for r in out) == ([] if sf == "b" else ["1", "3", "4", "None"])


def test_near_duplicates_of_repeated_doc_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one + " tail"), (5, two), (5, two), (7, three), (7, three + " tail"), (9, two + " tail"), (None, one), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = cp.drop_near_duplicates(spark, docs, "")
    assert got.dtypes == docs.dtypes
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, one), (0, one), (1, one), (5, two), (7, three)])
