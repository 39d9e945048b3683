"""What kind of column, what kind of table, and which columns could be the target."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matches, ratio
from ..operators.profile import type_counts
from ..settings import DEFAULTS, TARGET_NAME, Settings

# Name fragments and the order in which table kinds are tried.
TARGET_WORDS = ("target", "label", "class", "outcome", "churn", "default", "attack", "fraud")
TIME_WORDS = ("date", "time", "timestamp", "year", "period")
DERIVED_WORDS = ("score", "ratio", "per_", "pct", "percent", "log_")
FIXTURE_PATTERNS = (
    "team1|team_1|home",
    "team2|team_2|away",
    "date",
    "venue|stadium",
    "group",
    "round|stage",
    "fifa_rank",
    "coach",
)
ARCHIVE_PATTERNS = (
    "year|edition",
    "host",
    "champion|winner",
    "runner",
    "attendance",
    "goals?",
    "matches",
)
NETWORK_PATTERN = "(src_?bytes|dst_?bytes|packet|protocol|failed_?login|attack|payload|traffic)"
YEAR_PATTERN = "(^year$|_year$|year_)"
DATE_PATTERN = "(date|time|timestamp|period)"
LOCATION_PATTERN = "(state|county|city|location|country|region)"
BUSINESS_PATTERN = "(customer|contract|tenure|charges|churn|subscription)"
ECOMMERCE_PATTERN = "(price|kms?_driven|fuel|seller|company|brand|model)"
SURVEY_PATTERN = "(survey|response|question|rating|satisfaction)"


def _has_any(name: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [name.contains(w) for w in words])


def column_roles(profiles: DataFrame, target: Column) -> DataFrame:
    """Adds ``column_role``. ``target`` is the target name of the row's run, or null."""
    name = F.lower("column")
    kind = F.col("dtype_inferred")
    two_valued = (kind == "boolean") | ((kind == "numeric") & (F.col("n_unique") <= 2))
    role = (
        F.when(F.col("column") == target, "target")
        .when(F.col("name_kind") == "identifier", "identifier")
        .when((kind == "datetime") | _has_any(name, TIME_WORDS), "timestamp")
        .when(two_valued & _has_any(name, TARGET_WORDS), "target")
        .when(two_valued, "binary_flag")
        .when((F.col("name_kind") == "measurement") | (kind == "numeric"), "measurement")
        .when(kind == "text", "text")
        .when(_has_any(name, DERIVED_WORDS), "derived_feature")
        .otherwise("categorical")
    )
    return profiles.withColumn("column_role", role)


def dataset_types(profiles: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per run: shape, type counts and ``dataset_type``.

    ``targets`` holds ``run_id, target`` (null when none is set).
    """
    name = F.lower("column")

    def has(pattern: str) -> Column:
        return F.bool_or(matches(name, pattern))

    seen = profiles.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_cols"),
        F.max("n_rows").alias("n_rows"),
        reduce(Column.__add__, [has(p).cast("int") for p in FIXTURE_PATTERNS]).alias("fixture"),
        reduce(Column.__add__, [has(p).cast("int") for p in ARCHIVE_PATTERNS]).alias("archive"),
        has(NETWORK_PATTERN).alias("network"),
        has(YEAR_PATTERN).alias("year"),
        has(DATE_PATTERN).alias("date"),
        has(LOCATION_PATTERN).alias("location"),
        has(BUSINESS_PATTERN).alias("business"),
        has(ECOMMERCE_PATTERN).alias("ecommerce"),
        has(SURVEY_PATTERN).alias("survey"),
    )
    share = ratio(F.col("n_numeric"), F.col("n_cols"))
    kind = (
        F.when(F.col("fixture") >= 4, "fixture_schedule")
        .when((F.col("archive") >= 5) & (F.col("n_rows") <= 200), "historical_archive")
        .when(F.col("network"), "network_logs")
        .when(F.col("year") & F.col("location"), "panel_data")
        .when(F.col("date") & (share >= 0.5), "time_series")
        .when(F.col("target").isNotNull(), "supervised_tabular_ml")
        .when(F.col("business"), "business_tabular")
        .when(F.col("ecommerce"), "ecommerce")
        .when(F.col("survey"), "survey_data")
        .when(share >= 0.75, "scientific_measurements")
        .otherwise("unknown")
    )
    return (
        seen.join(type_counts(profiles), "run_id")
        .join(targets, "run_id", "left")
        .select(
            "run_id", "n_rows", F.col("n_cols").cast("int").alias("n_cols"), "n_numeric", "n_categorical", "n_datetime", "n_id_like",
            "target", F.col("target").isNotNull().alias("target_provided"), kind.alias("dataset_type"),
        )
    )


def label_like(settings: Settings = DEFAULTS) -> Column:
    kind, u = F.col("dtype_inferred"), F.col("n_unique")
    return (
        ~F.col("is_id_like")
        & ~F.col("is_constant")
        & (u >= 2)
        & (kind.isin("boolean", "categorical") | ((kind == "numeric") & (u <= settings.class_values)))
    )


def possible_targets(profiles: DataFrame, meta: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``run_id, possible_targets``: columns that could be the target, best guess first.

    Columns named like a target come first, then the rest, both from the last
    column backwards. Archives list only named ones, fixture schedules none.
    """
    # one row per column of a run: bounded groups
    named = matches(F.col("column"), TARGET_NAME)
    listed = (
        profiles.filter(label_like(settings))
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct((~named).alias("other"), (-F.col("ordinal")).alias("back"), "column"))).alias("all"))
    )
    first = F.transform(
        F.slice(F.filter("all", lambda s: ~s["other"]), 1, 4), lambda s: s["column"]
    )
    every = F.transform(F.slice("all", 1, 6), lambda s: s["column"])
    empty = F.array().cast("array<string>")
    return meta.join(listed, "run_id", "left").select(
        "run_id",
        F.when(F.col("target_provided") | (F.col("dataset_type") == "fixture_schedule") | F.col("all").isNull(), empty)
        .when(F.col("dataset_type") == "historical_archive", first)
        .otherwise(every)
        .alias("possible_targets"),
    )
