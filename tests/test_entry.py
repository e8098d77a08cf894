"""Driver contract and SQL oracles (DuckDB) for every registered query that has one."""

import os
import sys

import pytest

from .conftest import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_mod  # noqa: E402
from .oracle_util import compare, duck  # noqa: E402

#: The training-data queries have tests of their own, where their folder is present.
LLM = set(entry_mod._llm()[0])


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) >= {"feature", "type", "statistic", "p_value", "significant"}


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(set(entry_mod.oracle_sql()) - LLM))
def test_oracle_matches(spark, name):
    con = duck(SF_SMALL)
    ok, msg = compare(entry_mod.queries()[name](spark, SF_SMALL), con, entry_mod.oracle_sql()[name])
    assert ok, msg


#: What a query without an oracle must show: rows, and columns whose values lie in a range.
CHECKED = {
    "train_logistic": (1, {"val_pr_auc": (0.2, 1), "test_roc_auc": (0.3, 1), "threshold": (0, 1)}),
    "train_boosted": (3, {"val_pr_auc": (0.2, 1), "test_roc_auc": (0.3, 1), "threshold": (0, 1)}),
    "train_forest": (1, {"trees": (300, 300), "val_pr_auc": (0.2, 1), "test_roc_auc": (0.3, 1), "threshold": (0, 1)}),
    "forest_attributions": (300, {"score": (0, 1), "base": (0, 1), "adds_up": (True, True)}),
    "train_leaf_wise": (None, {"leaves": (2, 63), "gain": (0, 1e9), "n_rows": (1, 1500)}),
    "train_all_saved": (3 * 13 + 4 + 7 + 8, {}),
    "evaluate_saved": (None, {"value": (0, 1e6)}),
    "feature_importance": (20, {"importance": (0, 1e3)}),
    "score_contacts": (1500, {"probability_of_subscription": (0, 1), "prediction_class": (0, 1)}),
    "attribution_rank": (37, {"mean_abs_attribution": (0, 1e3)}),
    "explain_row": (37, {"attribution": (-1e3, 1e3), "adds_up": (True, True)}),
    "tree_attribution_rank": (37, {"mean_abs_attribution": (0, 1e3)}),
    "attribution_dependence": (300, {"attribution": (-1e3, 1e3)}),
    "stream_scored_contacts": (1500, {"probability_of_subscription": (0, 1)}),
}


@pytest.mark.parametrize("name", sorted(set(entry_mod.queries()) - set(entry_mod.oracle_sql()) - LLM))
def test_queries_without_an_oracle(spark, name):
    rows = entry_mod.queries()[name](spark, SF_SMALL).collect()
    n, ranges = CHECKED[name]
    assert rows and n in (None, len(rows))
    for column, (low, high) in ranges.items():
        assert all(low <= r[column] <= high for r in rows), column
