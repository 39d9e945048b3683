"""Class sizes of a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..settings import DEFAULTS, Settings
from .columns import col, missing_as_null
from .findings import emit, finding


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """``class, n`` over the rows with a target."""
    return (
        missing_as_null(df.select(col(target).alias("class")))
        .filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, rows, smallest, median and largest class, and the rarest class.

    The median is taken over class sizes; how many sizes differ grows with the
    square root of the rows at most, so its buffer stays small.
    """
    counts = class_counts(df, target).select(F.col("class").cast("string").alias("class"), "n")
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_labelled"),
        F.min("n").alias("min_class_count"),
        F.percentile("n", 0.5).alias("median_class_count"),
        F.max("n").alias("max_class_count"),
        F.min_by("class", F.struct("n", "class")).alias("minority"),
        ratio(F.max("n"), F.min("n")).alias("ratio"),
    )


def class_proportions(df: DataFrame, target: str, digits: int = 4) -> DataFrame:
    """``class, n, proportion``."""
    counts = class_counts(df, target)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.select(
        F.col("class").cast("string").alias("class"), "n", F.round(ratio(F.col("n"), F.lit(total)), digits).alias("proportion")
    )


def imbalance_findings(classes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``classes``: run_id, target, dtype_inferred, n_unique + ``class_summary`` + proportions MAP."""
    s = settings
    r, t, n = F.col("ratio"), F.col("target"), F.col("n_unique")
    kind = F.col("dtype_inferred")
    applies = (
        (kind.isin("categorical", "boolean", "id") | ((kind == "numeric") & (n <= s.class_values)))
        & n.between(2, s.max_balance_classes)
        & (r >= s.imbalance_high)
    )
    share = ratio(F.col("min_class_count"), F.col("n_labelled"))
    return emit(
        classes,
        "imbalance",
        [
            (
                applies,
                finding(
                    "CLASS_IMBALANCE",
                    F.when(r >= s.imbalance_critical, "critical").otherwise("high"),
                    F.format_string("Classes of '%s' are imbalanced (%.0f:1)", t, r),
                    F.format_string(
                        "The largest class is %.1f times the smallest; '%s' makes up %.2f%% of rows.",
                        r, F.col("minority"), share * 100,
                    ),
                    "Always predicting the largest class would look accurate. Judge by F1 or PR-AUC and rebalance.",
                    F.format_string('train, test = stratified_split(df, "%s", key_columns)  # then class_weights(df, "%s")', t, t),
                    column=t,
                    metrics={"class_proportions": F.col("proportions"), "ratio": F.round(r, 2)},
                ),
            )
        ],
    )
