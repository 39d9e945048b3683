"""Thresholds, weights, caps and name patterns.

Every number a check or a score depends on is here, so one ``Settings`` object
describes a run completely.
"""

from __future__ import annotations

from dataclasses import dataclass

# Name patterns (matched case-insensitively, anywhere in the name).
MEASUREMENT_NAME = (
    "(count|rate|population|income|gdp|crime|age|density|percent|percentage|"
    "score|value|amount|price|cost|revenue|bytes|packets?|duration|total|"
    "kms?|kilometers?|miles?|driven|violent|property|assault|burglary|theft|murder|robbery)"
)
IDENTIFIER_NAME = (
    "(^id$|_id$|id_|uuid|guid|account|customer|transaction|"
    "order|user_?id|client_?id|session_?id|device_?id)"
)
HEAVY_TAIL_NAME = (
    "(src_?bytes|dst_?bytes|bytes|packet|packets|packet_?count|"
    "failed_?logins?|login_?attempts?|attempts?|duration|flow_?duration|"
    "payload|traffic|bandwidth)"
)
LEAKAGE_NAME = (
    "(target|label|outcome|result|score|prediction|predicted|"
    "is_|_flag|flag_|future_|post_|_after|ground_truth|gt_|y_true)"
)
LEAKAGE_EVIDENCE = (
    "(final|after|outcome|result|status|post|label|target|actual|realized|"
    "cancellation|churn_date|revenue_after|default_status|diagnosis_confirmed)"
)
OUTCOME_TARGET_NAME = "(result|outcome|winner|rank|placement|churn|default|admitted|diagnosis)"
POST_OUTCOME_NAME = (
    "(goals?|assists?|matches?_played|final_score|points?|total|"
    "revenue_after|after_|post_|outcome_derived)"
)
GENERIC_TOTAL_NAME = "(^|_)total($|_)|^total"
TOTAL_EXEMPT_TARGET = "(churn|default|admitted|diagnosis)"
TARGET_NAME = (
    "^(target|label|y|class|outcome|result|churn|churned|converted|default|defaulted|"
    "fraud|is_fraud|response|click|clicked|winner|champion)$"
)

# Severity order and weights.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SEVERITY_WEIGHT = {"critical": 25.0, "high": 12.0, "medium": 5.0, "low": 2.0, "info": 0.0}

# Dataset-purpose labels, worst first.
PURPOSES = (
    "Not suitable for supervised ML",
    "EDA-only / visualization dataset",
    "Toy ML / demo only",
    "Trainable with caution",
    "Strong ML candidate",
)

# Engines in the order their findings are numbered.
ENGINES = (
    "missingness",
    "duplicates",
    "imbalance",
    "outliers",
    "leakage",
    "feature_quality",
    "correlation",
    "model_readiness",
)


@dataclass(frozen=True)
class Settings:
    # Every threshold below, up to the execution bounds, decides what is found.
    # input limits; None switches a limit off
    max_columns: int | None = None
    max_rows: int | None = None
    max_file_bytes: int | None = None
    row_cap: int = 100_000
    seed: int = 42

    # column typing
    parse_share: float = 0.9
    id_ratio: float = 0.95
    text_length: float = 40.0
    high_cardinality: int = 50
    high_cardinality_ratio: float = 0.5
    sample_values: int = 3
    exact_distinct: bool = True

    # missing values
    missing_critical: float = 0.60
    missing_high: float = 0.20
    missing_medium: float = 0.05
    co_missing: float = 0.85
    regime_share: float = 0.80
    regime_min_missing: int = 10

    # duplicates and class balance
    duplicate_high: float = 0.05
    duplicate_medium: float = 0.01
    imbalance_high: float = 10.0
    imbalance_critical: float = 100.0
    max_balance_classes: int = 50
    class_values: int = 20

    # outliers
    iqr_factor: float = 1.5
    robust_z: float = 3.5
    outlier_low: float = 0.05
    outlier_medium: float = 0.15

    # leakage
    leak_perfect: float = 0.98
    leak_suspicious: float = 0.70
    leak_monotonic: float = 0.999
    mi_bins: int = 20
    mi_norm: str = "entropy"

    # feature quality and correlation
    quasi_constant: float = 0.99
    near_duplicate: float = 0.99
    strong_correlation: float = 0.90
    heatmap_columns: int = 30

    # execution bounds: sizes below which the short plan is used
    exact_in_one_pass: int = 2_000_000
    pairs_per_aggregate: int = 200
    pairs_by_aggregate: int = 45
    columns_per_aggregate: int = 40
    columns_per_grouping: int = 1
    values_per_grouping: int = 50_000
    broadcast_rows: int = 100_000


DEFAULTS = Settings()
