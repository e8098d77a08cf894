"""Settings read from a YAML file with the original configuration's layout."""

import textwrap

from leadlens.settings import EDUCATION_ORDER, Settings


def test_from_yaml(tmp_path):
    p = tmp_path / "config.yaml"
    p.write_text(textwrap.dedent("""
        project: {random_seed: 7}
        data:
          sep: ";"
          target_col: y
          drop_cols: [duration]
          test_size: 0.25
          val_size: 0.1
          education_order: [a, b, unknown]
          pdays_not_contacted: 999
          pdays_fill_value: -1
        features:
          numerical: [age, pdays]
          categorical: [job, education]
          binary_target_map: {"yes": 1, "no": 0}
        preprocessing: {smote: {enabled: false, k_neighbors: 3}}
        models:
          logistic_regression: {C: 2.0, max_iter: 10}
          threshold_search: {grid_start: 0.2, grid_stop: 0.8, grid_step: 0.05}
        rag: {chunk_size: 256, chunk_overlap: 32, similarity_top_k: 3}
    """))
    s = Settings.from_yaml(str(p))
    assert s.seed == 7 and s.test_size == 0.25 and s.ordinal == {"education": ["a", "b", "unknown"]}
    assert s.numerical == ("age", "pdays") and not s.smote_enabled and s.smote_k == 3
    assert s.models.logistic_regression["C"] == 2.0 and s.threshold_grid == (0.2, 0.8, 0.05)
    assert (s.chunk_size, s.chunk_overlap, s.top_k) == (256, 32, 3)


def test_defaults_match_original_configuration():
    s = Settings()
    assert s.ordinal["education"] == EDUCATION_ORDER and EDUCATION_ORDER[-1] == "unknown"
    assert s.threshold_grid == (0.1, 0.9, 0.01) and s.test_size == 0.2 and s.val_size == 0.1
    assert s.models.random_forest["n_estimators"] == 300 and s.models.xgboost["scale_pos_weight"] == 8
