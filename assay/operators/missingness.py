"""Missing values: rates, columns that go missing together, gaps tied to a period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import as_datetime, as_number, ratio
from ..settings import DEFAULTS, Settings
from .columns import col, long_form
from .correlation import pair_sums
from .findings import emit, finding, percent


def mask_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of null masks for pairs of columns that are ever missing together.

    ``column, column2, place, place2, corr``; pairs that never coincide have no
    positive correlation and are left out. One scan with matrix products of the
    masks per Arrow batch, whatever the number of patterns.
    """
    names = F.array(*[F.lit(c) for c in columns])
    # one row of counts
    totals = df.agg(F.count(F.lit(1)), *[F.count_if(col(c).isNull()) for c in columns]).first()
    masks = df.select(*[col(c).isNull().cast("float").alias(f"m{i}") for i, c in enumerate(columns)])

    def together(x):
        import numpy as np

        i, j = np.triu_indices(len(columns), 1)
        return (x.T @ x)[i, j][None, :]

    both = pair_sums(masks, together, len(columns), ("nab",)).filter("nab > 0").select(
        F.col("place").alias("a"), F.col("place2").alias("b"), "nab")
    gaps = F.array(*[F.lit(float(m)) for m in totals[1:]])
    na, nb, n = F.get(gaps, F.col("a")), F.get(gaps, F.col("b")), F.lit(float(totals[0]))
    r = F.try_divide(n * F.col("nab") - na * nb, F.sqrt(na * (n - na)) * F.sqrt(nb * (n - nb)))
    return both.select(
        F.get(names, F.col("a")).alias("column"),
        F.get(names, F.col("b")).alias("column2"),
        F.col("a").alias("place"),
        F.col("b").alias("place2"),
        F.least(F.lit(1.0), r).alias("corr"),
    )


def missing_cluster(pairs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The largest group of at least three columns that go missing together.

    A group is a column and all columns whose mask correlates with its own; no
    chains are followed. One row ``columns ARRAY<STRING>`` or none.
    """
    close = pairs.filter(F.col("corr") >= settings.co_missing)
    stars = close.select("place", "column", "column2").unionByName(
        close.select(F.col("place2").alias("place"), F.col("column2").alias("column"), F.col("column").alias("column2"))
    )
    return (
        stars.groupBy("place", "column")
        .agg(F.sort_array(F.array_append(F.collect_set("column2"), F.first("column"))).alias("columns"))
        .filter(F.size("columns") >= 3)
        .orderBy(F.size("columns").desc(), "place")
        .limit(1)
        .select("columns")
    )


@dataclass(frozen=True)
class Period:
    column: str
    value: Column


def period_column(rows: list[Row]) -> Period | None:
    """The first column that can tell periods apart, from collected profile rows.

    Dates and texts that parse as dates give their year; numeric columns count
    when their name says year or period.
    """
    for r in rows:
        name, kind, typed = r["column"].lower(), r["kind"], r["dtype_inferred"]
        dated = any(w in name for w in ("date", "time", "period"))
        if typed != "datetime" and not dated and "year" not in name:
            continue
        present = r["n_rows"] - r["n_null"]
        c = col(r["column"])
        if kind == "datetime" and present >= 10:
            return Period(r["column"], F.year(c).cast("double"))
        if kind == "string" and (typed == "datetime" or dated):
            if round((r["datetime_parse_rate"] or 0.0) * present) >= 10:
                return Period(r["column"], F.year(as_datetime(c)).cast("double"))
        if ("year" in name or "period" in name) and (r["n_unique"] or 0) >= 2:
            if kind == "number" and present >= 10:
                return Period(r["column"], c.cast("double"))
            if kind == "string" and round((r["numeric_parse_rate"] or 0.0) * present) >= 10:
                return Period(r["column"], as_number(c))
    return None


def missing_by_period(df: DataFrame, period: Column, columns: list[str]) -> DataFrame:
    """Per column: the period most of its gaps fall in and the share that does.

    ``column, n_missing, period, missing_share``; gaps without a period do not count.
    """
    masks = {c: F.when(col(c).isNull(), 1) for c in columns}
    long = long_form(df, masks, value="gap", keep={"period": period})
    return (
        long.filter(F.col("period").isNotNull())
        .groupBy("column", "period")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(
            F.sum("n").alias("n_missing"),
            F.max_by("period", F.struct(F.col("n"), -F.col("period"))).alias("period"),
            ratio(F.max("n"), F.sum("n")).alias("missing_share"),
        )
    )


# --- findings ---------------------------------------------------------------


def missing_value_findings(profiles: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """From profiles with ``dataset_type``; columns of a cluster must be filtered out before."""
    s = settings
    raw = ratio(F.col("n_null"), F.col("n_rows"))
    c, pct = F.col("column"), percent(raw)
    severity = F.when(raw >= s.missing_critical, "critical").when(raw >= s.missing_high, "high").otherwise("medium")
    fill = F.when(F.col("dataset_type") == "fixture_schedule", "TBD").otherwise("Unknown")
    fix = (
        F.when(raw >= s.missing_critical, F.format_string('df = df.drop("%s")', c))
        .when(
            F.col("dtype_inferred") == "numeric",
            F.format_string('df = fill_median(df, ["%s"])', c),
        )
        .otherwise(F.format_string('df = df.fillna("%s", subset=["%s"])', fill, c))
    )
    impact = F.when(
        raw >= s.missing_critical,
        "So little is left that filling the gaps would invent most of the column.",
    ).otherwise("Dropping or blindly filling these rows biases a model unless the gaps are random.")
    return emit(
        profiles,
        "missingness",
        [
            (
                raw >= s.missing_medium,
                finding(
                    "MISSING_VALUES",
                    severity,
                    F.format_string("'%s' is missing in %s%% of rows", c, pct),
                    F.format_string("%d of %d values of '%s' are null.", F.col("n_null"), F.col("n_rows"), c),
                    impact,
                    fix,
                    column=c,
                    metrics={"null_rate": F.round(raw, 4), "n_missing": F.col("n_null")},
                    block=1,
                    place=F.col("ordinal"),
                ),
            )
        ],
    )


def cluster_findings(clusters: DataFrame) -> DataFrame:
    """``clusters``: run_id, dataset_type, columns."""
    names = F.array_join("columns", ", ")
    return emit(
        clusters,
        "missingness",
        [
            (
                F.size("columns") >= 3,
                finding(
                    "STRUCTURAL_MISSINGNESS_CLUSTER",
                    F.when(F.col("dataset_type") == "fixture_schedule", "low").otherwise("medium"),
                    F.lit("Columns that go missing as a block"),
                    F.format_string("These columns are missing in the same rows: %s.", names),
                    "Gaps that come together have one cause: look for what these rows have not reached or were never asked.",
                    F.lit("df = add_missing_flags(df, cluster)  # one flag would do: they go together"),
                    metrics={"columns": F.col("columns"), "structural": F.lit(True)},
                    block=0,
                ),
            )
        ],
    )


def regime_findings(regimes: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``regimes``: run_id, ordinal, period_column + the output of ``missing_by_period``."""
    c = F.col("column")
    return emit(
        regimes,
        "missingness",
        [
            (
                F.col("missing_share") >= settings.regime_share,
                finding(
                    "STRUCTURAL_MISSINGNESS_TIME_REGIME",
                    "medium",
                    F.format_string("The gaps of '%s' sit in one period", c),
                    F.format_string(
                        "%s%% of the missing '%s' values have '%s' = %s.",
                        percent(F.col("missing_share")), c, F.col("period_column"), F.col("period").cast("string"),
                    ),
                    "The column was probably not recorded then. Flag the period or fill the gaps within periods.",
                    F.format_string('df = add_missing_flags(df, ["%s"])  # then fill_median_by(df, "%s", period)', c, c),
                    column=c,
                    metrics={
                        "period_column": F.col("period_column"),
                        "period": F.col("period"),
                        "missing_share_in_period": F.round("missing_share", 3),
                    },
                    block=2,
                    place=F.col("ordinal"),
                ),
            )
        ],
    )


def co_missing_findings(pairs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``pairs``: run_id + the output of ``mask_correlation`` without cluster columns."""
    a, b = F.col("column"), F.col("column2")
    return emit(
        pairs,
        "missingness",
        [
            (
                F.col("corr") >= settings.co_missing,
                finding(
                    "CO_MISSING_GROUP",
                    "medium",
                    F.format_string("'%s' and '%s' are missing together", a, b),
                    F.format_string("Their null masks correlate at %.2f.", F.col("corr")),
                    "Gaps that follow a pattern carry information of their own and defeat simple imputation.",
                    F.format_string('df = add_missing_flags(df, ["%s"])', a),
                    column=a,
                    column2=b,
                    metrics={"comissing_corr": F.round("corr", 3), "with": b},
                    block=3,
                    place=F.col("place"),
                    place2=F.col("place2"),
                ),
            )
        ],
    )
