"""Driver-side settings passed to operators.

A plain dataclass; ``Settings.from_yaml`` reads the same nested layout the
original configuration file uses.  ``contacts_settings()`` binds the roles to the
``contacts`` view built from the supplied tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

# --- fixed values that must equal the original configuration ------------------
# education levels in ordinal order ("unknown" is the last level, not missing)
EDUCATION_ORDER = [
    "illiterate", "basic.4y", "basic.6y", "basic.9y",
    "high.school", "professional.course", "university.degree", "unknown",
]
# numeric and categorical roles of the bank table
BANK_NUMERICAL = ["age", "campaign", "pdays", "previous", "emp.var.rate",
                  "cons.price.idx", "cons.conf.idx", "euribor3m", "nr.employed"]
BANK_CATEGORICAL = ["job", "marital", "education", "default", "housing", "loan",
                    "contact", "month", "day_of_week", "poutcome"]
TARGET_MAP = {"yes": 1, "no": 0}
PDAYS_NOT_CONTACTED = 999
PDAYS_FILL_VALUE = -1
THRESHOLD_GRID = (0.1, 0.9, 0.01)          # start, stop (exclusive), step
ANALYSIS_GRID = (0.05, 0.95, 0.01)         # threshold analysis curve
RECOMMEND_YES = "Call — high-probability lead"
RECOMMEND_NO = "Do not call — low probability"
TIER_HIGH = 60                             # percent cut for "high"
TIER_MEDIUM = 30                           # percent cut for "medium"
TEST_SIZE, VAL_SIZE = 0.20, 0.10
# display labels by code
EDUCATION_LABELS = {
    "illiterate": "No formal education", "basic.4y": "Primary school (4 years)", "basic.6y": "Middle school (6 years)",
    "basic.9y": "Lower secondary (9 years)", "high.school": "High school", "professional.course": "Professional course",
    "university.degree": "University degree", "unknown": "Unknown / Not disclosed"}
JOB_LABELS = {
    "admin.": "Admin", "blue-collar": "Blue-collar", "entrepreneur": "Entrepreneur", "housemaid": "Housemaid",
    "management": "Management", "retired": "Retired", "self-employed": "Self-employed", "services": "Services",
    "student": "Student", "technician": "Technician", "unemployed": "Unemployed", "unknown": "Unknown"}
MARITAL_LABELS = {"married": "Married", "single": "Single", "divorced": "Divorced / Widowed", "unknown": "Not disclosed"}
YES_NO_LABELS = {"no": "No", "yes": "Yes", "unknown": "Not disclosed"}
CONTACT_LABELS = {"cellular": "Mobile phone", "telephone": "Landline"}
POUTCOME_LABELS = {"nonexistent": "No previous campaign", "failure": "Previous campaign failed",
                   "success": "Previous campaign succeeded"}
# model parameters by configuration key
LOGISTIC_PARAMS = {"C": 1.0, "max_iter": 1000, "class_weight": "balanced", "solver": "lbfgs"}
FOREST_PARAMS = {"n_estimators": 300, "max_depth": 15, "min_samples_split": 5, "min_samples_leaf": 2,
                 "class_weight": "balanced"}
XGB_PARAMS = {"n_estimators": 500, "learning_rate": 0.05, "max_depth": 6, "subsample": 0.8,
              "colsample_bytree": 0.8, "scale_pos_weight": 8, "early_stopping_rounds": 50}
LGBM_PARAMS = {"n_estimators": 500, "learning_rate": 0.05, "max_depth": 6, "num_leaves": 63,
               "subsample": 0.8, "colsample_bytree": 0.8, "class_weight": "balanced",
               "early_stopping_rounds": 50}
# columns of the model comparison and fields of the model card
COMPARISON_COLS = ["name", "val_roc_auc", "val_pr_auc", "val_f1", "test_roc_auc", "test_pr_auc", "test_f1",
                   "threshold"]
CARD_FIELDS = ["model_name", "val_pr_auc", "test_pr_auc", "tuned_threshold", "timestamp"]
# ------------------------------------------------------------------------------

# ordinal order of the order priority, used where the contacts view stands in
PRIORITY_ORDER = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@dataclass(frozen=True)
class ModelParams:
    logistic_regression: dict = field(default_factory=lambda: dict(LOGISTIC_PARAMS))
    random_forest: dict = field(default_factory=lambda: dict(FOREST_PARAMS))
    xgboost: dict = field(default_factory=lambda: dict(XGB_PARAMS))
    lightgbm: dict = field(default_factory=lambda: dict(LGBM_PARAMS))


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    sep: str = ";"
    target: str = "y"
    id_col: str = "contact_id"
    drop_cols: tuple = ("duration",)
    test_size: float = TEST_SIZE
    val_size: float = VAL_SIZE
    stratify: bool = True
    numerical: tuple = tuple(BANK_NUMERICAL)
    categorical: tuple = tuple(BANK_CATEGORICAL)
    ordinal: dict = field(default_factory=lambda: {"education": list(EDUCATION_ORDER)})
    target_map: dict = field(default_factory=lambda: dict(TARGET_MAP))
    pdays_col: str = "pdays"
    pdays_not_contacted: int = PDAYS_NOT_CONTACTED
    pdays_fill_value: int = PDAYS_FILL_VALUE
    smote_enabled: bool = True
    smote_k: int = 5
    threshold_grid: tuple = THRESHOLD_GRID
    models: ModelParams = field(default_factory=ModelParams)
    chunk_size: int = 512
    chunk_overlap: int = 64
    top_k: int = 5

    def with_(self, **kw: Any) -> "Settings":
        return replace(self, **kw)

    @classmethod
    def from_yaml(cls, path: str) -> "Settings":
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover
            raise RuntimeError("PyYAML is needed to read a YAML settings file") from exc
        with open(path) as fh:
            cfg = yaml.safe_load(fh)
        data, feats = cfg.get("data", {}), cfg.get("features", {})
        smote = cfg.get("preprocessing", {}).get("smote", {})
        ts = cfg.get("models", {}).get("threshold_search", {})
        rag = cfg.get("rag", {})
        models = {k: v for k, v in cfg.get("models", {}).items() if k != "threshold_search"}
        return cls(
            seed=cfg.get("project", {}).get("random_seed", 42),
            sep=data.get("sep", ";"), target=data.get("target_col", "y"),
            drop_cols=tuple(data.get("drop_cols", ["duration"])),
            test_size=data.get("test_size", 0.2), val_size=data.get("val_size", 0.1),
            stratify=data.get("stratify", True),
            numerical=tuple(feats.get("numerical", BANK_NUMERICAL)),
            categorical=tuple(feats.get("categorical", BANK_CATEGORICAL)),
            ordinal={"education": data.get("education_order", EDUCATION_ORDER)},
            target_map=feats.get("binary_target_map", TARGET_MAP),
            pdays_not_contacted=data.get("pdays_not_contacted", 999),
            pdays_fill_value=data.get("pdays_fill_value", -1),
            smote_enabled=smote.get("enabled", True), smote_k=smote.get("k_neighbors", 5),
            threshold_grid=(ts.get("grid_start", 0.1), ts.get("grid_stop", 0.9),
                            ts.get("grid_step", 0.01)),
            models=ModelParams(**{k: models[k] for k in models
                                  if k in ModelParams.__dataclass_fields__}),
            chunk_size=rag.get("chunk_size", 512), chunk_overlap=rag.get("chunk_overlap", 64),
            top_k=rag.get("similarity_top_k", 5),
        )


CONTACTS_NUMERICAL = ("total_price", "acct_balance", "previous", "pdays")
CONTACTS_CATEGORICAL = ("segment", "region", "priority", "month", "day_of_week", "poutcome")


def contacts_settings() -> Settings:
    """Roles of the ``contacts`` view (one row per order, see FIXTURES FX7)."""
    return Settings(
        numerical=CONTACTS_NUMERICAL,
        categorical=CONTACTS_CATEGORICAL,
        ordinal={"priority": list(PRIORITY_ORDER)},
    )
