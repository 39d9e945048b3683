"""Features that give the target away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import has_evidence, matches
from ..settings import DEFAULTS, LEAKAGE_NAME, Settings
from .findings import emit, finding


def leakage_class(settings: Settings = DEFAULTS):
    """Which rule a row of ``target_association`` (with ``target``) falls under, if any."""
    s = settings
    copy = (F.col("n_pairs") >= 10) & (F.col("exact") | (F.col("spearman") >= s.leak_monotonic))
    near = (F.col("mi") >= s.leak_perfect) | (F.col("corr") >= s.leak_perfect)
    evidence = has_evidence(F.col("column"), F.col("target"))
    named = matches(F.col("column"), LEAKAGE_NAME) & evidence
    raised = (F.col("corr") >= s.leak_suspicious) | (F.col("mi") >= s.leak_suspicious)
    return (
        F.when(copy & evidence, "TARGET_LEAKAGE_TARGET_COPY")
        .when(copy, "TARGET_PROXY_RISK")
        .when(near & evidence, "TARGET_LEAKAGE_PERFECT_PREDICTOR")
        .when(near, "TARGET_PROXY_RISK")
        .when(named & raised, "TARGET_LEAKAGE_SUSPICIOUS_NAME")
    )


def association_findings(metrics: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``metrics``: run_id, ordinal, target + the output of ``target_association``."""
    s = settings
    c, t = F.col("column"), F.col("target")
    rows = metrics.withColumns(
        {
            "code": leakage_class(settings),
            "copy": (F.col("n_pairs") >= 10) & (F.col("exact") | (F.col("spearman") >= s.leak_monotonic)),
        }
    )
    code = F.col("code")
    evident = code.startswith("TARGET_LEAKAGE")
    numbers = F.format_string("Normalised MI %.3f, |corr| %.3f between '%s' and '%s'.", F.col("mi"), F.col("corr"), c, t)
    measured = {"mi": F.round("mi", 4), "corr": F.round("corr", 4)}
    drop = F.format_string('df = df.drop("%s")', c)
    check = F.format_string('# check when "%s" is known, then: df = df.drop("%s")', c, c)
    review = "Whether it is known before the outcome cannot be told from the data: ask who fills it in, and when."
    suspicious = code == "TARGET_LEAKAGE_SUSPICIOUS_NAME"
    return emit(
        rows,
        "leakage",
        [
            (
                F.col("copy"),
                finding(
                    code,
                    F.when(evident, "critical").otherwise("medium"),
                    F.when(evident & F.col("exact"), F.format_string("'%s' equals the target in all %d rows that have both", c, F.col("n_pairs")))
                    .when(evident, F.format_string("'%s' puts the rows in the order of the target", c))
                    .otherwise(F.format_string("'%s' may stand in for the target", c)),
                    F.format_string(
                        "'%s' can be read off '%s': %s over %d rows.", t, c, F.when(F.col("exact"), "value for value").otherwise("rank for rank"), F.col("n_pairs")
                    ),
                    F.when(evident, "A name like this is given once the outcome is known; at prediction time the column would be empty.").otherwise(review),
                    drop,
                    column=c,
                    category=F.when(evident, "data_integrity").otherwise("modeling_warning"),
                    metrics=measured,
                    block=1,
                    place=F.col("ordinal"),
                ),
            ),
            (
                code.isNotNull() & ~F.col("copy") & ~suspicious,
                finding(
                    code,
                    F.when(evident, "critical").otherwise("medium"),
                    F.when(evident, F.format_string("'%s' alone all but gives the target away", c)).otherwise(
                        F.format_string("'%s' follows the target closely", c)
                    ),
                    numbers,
                    F.when(evident, "Its name points past the outcome and it needs no other column to predict it.").otherwise(review),
                    check,
                    column=c,
                    category=F.when(evident, "data_integrity").otherwise("modeling_warning"),
                    metrics=measured,
                    block=2,
                    place=F.col("ordinal"),
                ),
            ),
            (
                ~F.col("copy") & suspicious,
                finding(
                    code,
                    "high",
                    F.format_string("'%s' is named like a result and moves with the target", c),
                    numbers,
                    "Columns with such names tend to be worked out from the label.",
                    check,
                    column=c,
                    metrics=measured,
                    block=3,
                    place=F.col("ordinal"),
                ),
            ),
        ],
    )


def id_feature_findings(profiles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``profiles`` with ``target``: near-unique identifiers that would be memorised."""
    c, share = F.col("column"), F.col("cardinality_ratio")
    return emit(
        profiles,
        "leakage",
        [
            (
                F.col("target").isNotNull() & (c != F.col("target")) & F.col("is_id_like") & (share >= settings.id_ratio),
                finding(
                    "ID_USED_AS_FEATURE",
                    "high",
                    F.format_string("Identifier '%s' would be memorised", c),
                    F.format_string("'%s' is almost unique (%.2f distinct values per row).", c, share),
                    "A model can learn single rows by their identifier and then fails on new ones.",
                    F.format_string('df = df.drop("%s")', c),
                    column=c,
                    category="modeling_warning",
                    metrics={"cardinality_ratio": share},
                    block=4,
                    place=F.col("ordinal"),
                ),
            )
        ],
    )


def split_leak_findings(counts: DataFrame) -> DataFrame:
    """``counts``: run_id, target, dup_count."""
    k = F.col("dup_count")
    return emit(
        counts,
        "leakage",
        [
            (
                F.col("target").isNotNull() & (k > 0),
                finding(
                    "DUPLICATES_SPLIT_LEAK",
                    "medium",
                    F.lit("Duplicate rows can end up on both sides of a split"),
                    F.format_string("There are %d duplicate rows and a target.", k),
                    "Identical rows in training and test data inflate scores. Remove them first or split by group.",
                    "df = df.dropDuplicates()  # or group_split(df, key_columns)",
                    metrics={"dup_count": k},
                    block=5,
                ),
            )
        ],
    )


def suspicious_name_findings(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``target``: names that suggest outcomes, where no target is set."""
    c = F.col("column")
    return emit(
        profiles,
        "leakage",
        [
            (
                F.col("target").isNull() & matches(c, LEAKAGE_NAME),
                finding(
                    "SUSPICIOUS_COLUMN_NAME_NO_TARGET",
                    "info",
                    F.format_string("'%s' is named like an outcome", c),
                    F.format_string("The name of '%s' is often used for labels. Set a target to test it for leakage.", c),
                    "If it is computed after the moment of prediction, it leaks the future.",
                    F.format_string('# check when "%s" is known, then: df = df.drop("%s")', c, c),
                    column=c,
                    place=F.col("ordinal"),
                ),
            )
        ],
    )
