"""From findings to scores, grades, purpose, verdict and confidence, for any number of runs.

All inputs are DataFrames keyed by ``run_id``:

- ``findings`` as numbered by ``number_findings``
- ``meta``: run_id, dataset_name, n_rows, sampled, target_provided, dataset_type
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import PURPOSES, SEVERITY_WEIGHT

# How much one group of findings can cost.
INTEGRITY_CAP = 40.0
INTEGRITY_CAPS = {"outliers": 3.0}
READINESS_CAP = 40.0
READINESS_CAPS = {
    "outliers": 12.0,
    "correlation": 8.0,
    "feature_quality": 7.0,
    "feature_quality:MESSY_NUMERIC_TEXT": 24.0,
    "imbalance": 18.0,
    "model_readiness": 60.0,
}
STRUCTURAL = ("STRUCTURAL_MISSINGNESS_TIME_REGIME", "CO_MISSING_GROUP")
CORRUPTION = ("MIXED_TYPE_COLUMN", "NUMERIC_STORED_AS_STRING", "MESSY_NUMERIC_TEXT")
NOT_SUITABLE, EDA_ONLY, TOY, CAUTION, STRONG = PURPOSES


def _cases(value: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)).otherwise(out)
    return out


def severity_weight() -> Column:
    return _cases(F.col("severity"), SEVERITY_WEIGHT, 0.0)


def penalties(findings: DataFrame) -> DataFrame:
    """Adds category corrections, raw weights and the penalty each finding really costs.

    The findings of a group share a cap: each costs what its weight adds to the
    group's capped running total.
    """
    code, engine, weight = F.col("code"), F.col("engine"), severity_weight()
    warned = findings.withColumn(
        "category",
        F.when((engine == "outliers") | (code == "HIGH_CARDINALITY_CATEGORICAL"), "modeling_warning").otherwise(F.col("category")),
    )
    integrity = (
        F.when(engine == "outliers", F.lit(1.0))
        .when(F.col("category") == "modeling_warning", F.lit(0.0))
        .when(code.isin(*STRUCTURAL), F.least(weight, F.lit(2.0)))
        .when((code == "MISSING_VALUES") & (F.coalesce("null_rate", F.lit(0.0)) < 0.10), F.least(weight, F.lit(3.0)))
        .otherwise(weight)
    )
    readiness = (
        F.when(F.col("readiness_penalty").isNotNull(), F.col("readiness_penalty"))
        .when(engine == "outliers", F.least(weight, F.lit(5.0)))
        .when(code.isin(*STRUCTURAL), F.greatest(weight, F.lit(3.0)))
        .otherwise(weight)
    )
    own_group = F.when(code == "MESSY_NUMERIC_TEXT", F.concat_ws(":", engine, code)).otherwise(engine)
    weighed = warned.withColumns(
        {
            "iw": integrity,
            "rw": readiness,
            "r_group": own_group,
            "i_cap": _cases(engine, INTEGRITY_CAPS, INTEGRITY_CAP),
            "r_cap": _cases(own_group, READINESS_CAPS, READINESS_CAP),
        }
    )

    def applied(group: str, weight: str, cap: str) -> Column:
        w = Window.partitionBy("run_id", group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum(weight).over(w)
        return F.least(F.col(cap), total) - F.least(F.col(cap), total - F.col(weight))

    return weighed.withColumns(
        {"i_cost": applied("engine", "iw", "i_cap"), "r_cost": applied("r_group", "rw", "r_cap")}
    ).select(
        *warned.columns,
        "iw",
        "rw",
        F.round("i_cost", 2).alias("integrity_penalty"),
        F.round("r_cost", 2).alias("readiness_penalty_applied"),
        F.round("i_cost", 2).alias("score_penalty"),
        "i_cost",
        "r_cost",
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """``run_id`` and one count per severity, zeros included."""
    return findings.groupBy("run_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_WEIGHT]
    )


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def overall_grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 85, "A-").when(score >= 80, "B+").when(score >= 75, "B")
        .when(score >= 70, "B-").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")
    )


def _clamped(total: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - total))


def _capped(level: Column, cap: Column) -> Column:
    order = {"low": 0, "medium": 1, "high": 2}
    return F.when(_cases(level, order, 2) <= _cases(cap, order, 2), level).otherwise(cap)


def _purpose(worst: Column, readiness: Column) -> Column:
    # The purposes of tables without a target, and the steps of readiness.
    out = F.when(readiness >= 85, STRONG).when(readiness >= 70, CAUTION).when(readiness >= 50, TOY).otherwise(EDA_ONLY)
    for i, label in enumerate(PURPOSES):
        out = F.when(worst == i, label).otherwise(out)
    kind = F.col("dataset_type")
    return (
        F.when(F.col("target_provided"), out)
        .when(kind == "fixture_schedule", "Simulation / forecasting / scheduling analysis")
        .when(kind == "historical_archive", "EDA / visualization / historical analysis")
        .otherwise("Data integrity and exploratory analysis")
    )


def _overall() -> Column:
    i, r, kind, given = F.col("integrity_score"), F.col("readiness_score"), F.col("dataset_type"), F.col("target_provided")

    def between(low: float, high: float, value: Column) -> Column:
        return F.least(F.greatest(value, F.lit(low)), F.lit(high))

    score = (
        F.when(given, F.bround(0.6 * i + 0.4 * r))
        .when(kind == "fixture_schedule", between(70.0, 85.0, F.bround(0.8 * i + 0.2 * r)))
        .when(kind == "historical_archive", between(60.0, 75.0, F.bround(0.7 * i + 0.3 * r)))
        .otherwise(F.bround(0.9 * i + 0.1 * r))
    )
    limits = [
        (given & F.col("critical_leak"), 40.0),
        (F.col("corrupt"), 55.0),
        (F.col("n_missing_high") >= 3, 70.0),
        (given & (r < 40), 65.0),
        (given & (F.col("dataset_purpose") == EDA_ONLY), 70.0),
        (given & (F.col("dataset_purpose") == NOT_SUITABLE), 60.0),
    ]
    for condition, limit in limits:
        score = F.when(condition, F.least(score, F.lit(limit))).otherwise(score)
    return F.when(given & F.col("overall_cap").isNotNull(), F.least(score, F.col("overall_cap"))).otherwise(score)


def _verdict() -> Column:
    i, r, o = F.col("integrity_score"), F.col("readiness_score"), F.col("overall_score")
    kind, purpose, given = F.col("dataset_type"), F.col("dataset_purpose"), F.col("target_provided")
    # The verdict texts, first match wins.
    return (
        F.when(~given & (kind == "fixture_schedule"), "Suitable for simulation, scheduling analysis, and forecasting once outcome labels are added.")
        .when(~given & (kind == "historical_archive") & (i >= 90), "Excellent historical dataset, but not suitable for reliable supervised ML because it has too few rows.")
        .when(~given & (kind == "historical_archive"), "Best suited for EDA, visualization, and historical comparison.")
        .when(~given, "Supervised ML readiness requires a target column.")
        .when(F.col("critical_leak"), "Do not train until leakage is resolved")
        .when(i < 60, "Fix data integrity before modeling")
        .when((purpose == NOT_SUITABLE) & (i >= 80), "Clean dataset, but not suitable for reliable supervised ML. Best used for EDA, visualization, and historical analysis.")
        .when(purpose.isin(NOT_SUITABLE, EDA_ONLY, TOY, CAUTION), purpose)
        .when((o >= 85) & (r >= 75) & (r < 90), "Trainable with warnings")
        .when((o >= 85) & (r >= 75), "Ready for baseline modeling")
        .when(r < 70, "Structurally usable, but modeling risk is high")
        .otherwise("Review before modeling")
    )


def _confidence(prefix: str, kind: str) -> tuple[Column, Column]:
    n, sampled = F.col("n_rows"), F.col("sampled")
    crit, high, evidence = F.col(f"{prefix}_critical"), F.col(f"{prefix}_high"), F.col(f"{prefix}_evidence")
    level = (
        F.when((crit > 0) | (high > 0) | (evidence >= 3), "high")
        .when(((n >= 200) & (F.col("n_findings") >= 1)) | (n >= 100), "medium")
        .otherwise("low")
    )
    level = F.when(sampled & (level == "high"), "medium").otherwise(level)
    if kind == "model-readiness":
        level = F.when(n < 50, "low").when(n < 200, _capped(level, F.lit("medium"))).otherwise(level)
        level = F.when(F.col("weak_support"), "low").otherwise(level)
        level = F.when(F.col("late_leak"), _capped(level, F.lit("medium"))).otherwise(level)
    # the numbers that the level was decided by
    reason = F.concat(
        F.format_string(f"%d {kind} findings (critical %d, high %d) over %d rows", evidence, crit, high, n),
        F.when(sampled, ", drawn from a larger table").otherwise(""), F.lit("."),
    )
    return level, reason


def scores(findings: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per run of ``meta``: scores, grades, purpose, verdict, confidence, severity counts."""
    return judge(meta.join(tally(penalties(findings)), "run_id", "left"), meta.columns)


def tally(f: DataFrame) -> DataFrame:
    """One row per run from findings with ``penalties``: totals, caps, flags and counts."""
    s, code = F.col("severity"), F.col("code")
    grave = s.isin("critical", "high")
    integrity = F.col("category") != "modeling_warning"
    readiness = (F.col("category") == "modeling_warning") | (F.col("r_cost") > 0)
    rank = F.lit(None).cast("int")
    cap_rank = F.lit(None).cast("int")
    for i, label in enumerate(PURPOSES):
        rank = F.when(F.col("dataset_purpose") == label, i).otherwise(rank)
        cap_rank = F.when(F.col("dataset_purpose_cap") == label, i).otherwise(cap_rank)
    return f.groupBy("run_id").agg(
        F.sum("i_cost").alias("i_total"),
        F.sum("r_cost").alias("r_total"),
        F.min("readiness_cap").alias("readiness_cap"),
        F.min("overall_cap").alias("overall_cap"),
        F.min(F.least(rank, cap_rank)).alias("worst_purpose"),
        F.bool_or(code.startswith("TARGET_LEAKAGE") & (s == "critical")).alias("critical_leak"),
        F.bool_or(code.isin(*CORRUPTION) & grave).alias("corrupt"),
        F.count_if((code == "MISSING_VALUES") & grave).alias("n_missing_high"),
        F.bool_or(code == "WEAK_CLASSIFICATION_TARGET_SUPPORT").alias("weak_support"),
        F.bool_or(code == "POST_OUTCOME_LEAKAGE_RISK").alias("late_leak"),
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.col("category") == "modeling_warning").alias("n_modeling_warnings"),
        *[F.count_if(integrity & (s == level)).alias(f"i_{level}") for level in ("critical", "high")],
        F.count_if(integrity & (s != "info")).alias("i_evidence"),
        *[F.count_if(readiness & (s == level)).alias(f"r_{level}") for level in ("critical", "high")],
        F.count_if(readiness & (s != "info")).alias("r_evidence"),
        *[F.count_if(s == level).alias(f"n_{level}") for level in SEVERITY_WEIGHT],
    )


def judge(runs: DataFrame, keep: list[str]) -> DataFrame:
    """Scores and words for every run: ``runs`` are run facts joined with their ``tally``."""
    counters = [c for c in runs.columns if c.startswith(("n_", "i_", "r_")) and c not in keep]
    flags = ["critical_leak", "corrupt", "weak_support", "late_leak"]
    joined = runs.withColumns(
        {**{c: F.coalesce(F.col(c), F.lit(0)) for c in counters}, **{c: F.coalesce(F.col(c), F.lit(False)) for c in flags}}
    )
    given, kind = F.col("target_provided"), F.col("dataset_type")
    raw = F.bround(_clamped(F.col("r_total")), 1)
    ready = F.when(F.col("readiness_cap").isNotNull(), F.bround(F.least(raw, F.col("readiness_cap")), 1)).otherwise(raw)
    ready = F.when(given & F.col("critical_leak"), F.least(ready, F.lit(40.0))).otherwise(ready)
    ready = (
        F.when(given, ready)
        .when(kind == "fixture_schedule", F.least(ready, F.lit(60.0)))
        .when(kind == "historical_archive", F.least(ready, F.lit(30.0)))
        .otherwise(F.least(ready, F.lit(55.0)))
    )
    i_level, i_reason = _confidence("i", "integrity")
    r_level, r_reason = _confidence("r", "model-readiness")
    needs_target = "Readiness for supervised learning needs a target; without one this report covers integrity and possible uses."
    scored = (
        joined.withColumns({"integrity_score": F.bround(_clamped(F.col("i_total")), 1), "readiness_score": ready})
        .withColumn("dataset_purpose", _purpose(F.col("worst_purpose"), F.col("readiness_score")))
        .withColumn("overall_score", _overall())
        .withColumns(
            {
                "verdict": _verdict(),
                "integrity_confidence": i_level,
                "integrity_confidence_reason": i_reason,
                "readiness_confidence": F.when(given, r_level).otherwise("low"),
                "readiness_confidence_reason": F.when(given, r_reason).otherwise(needs_target),
            }
        )
    )
    i_conf, r_conf = F.col("integrity_confidence"), F.col("readiness_confidence")
    both = _capped(F.when(i_conf == r_conf, i_conf).otherwise("medium"), r_conf)
    return scored.select(
        *keep,
        "integrity_score",
        grade(F.col("integrity_score")).alias("integrity_grade"),
        "readiness_score",
        grade(F.col("readiness_score")).alias("readiness_grade"),
        "overall_score",
        overall_grade(F.col("overall_score")).alias("overall_grade"),
        F.col("overall_score").alias("health_score"),
        overall_grade(F.col("overall_score")).alias("grade"),
        "verdict",
        "dataset_purpose",
        F.when(given, "scored").otherwise("N/A").alias("supervised_ml_readiness"),
        "integrity_confidence",
        "integrity_confidence_reason",
        "readiness_confidence",
        "readiness_confidence_reason",
        both.alias("overall_confidence"),
        F.format_string("Integrity confidence is %s; readiness confidence is %s.", i_conf, r_conf).alias("overall_confidence_reason"),
        "n_findings",
        "n_modeling_warnings",
        *[f"n_{level}" for level in SEVERITY_WEIGHT],
    )
