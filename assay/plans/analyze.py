"""One table in, one report out.

Heavy passes run on the executors and return one row per column, pair of
columns or finding. Those small results are collected as they become known,
because later passes choose their columns from them; no data row is.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import association, correlation, duplicates, features, imbalance, leakage, missingness, outliers, readiness
from ..operators.columns import missing_as_null, numeric
from ..operators.findings import number_findings
from ..operators.profile import fingerprint, profile
from ..settings import DEFAULTS, Settings
from ..sources.limits import check_limits
from ..sources.sampling import cap_rows
from . import context, narrative, scoring, views

Check = Callable[[DataFrame, DataFrame, str | None], DataFrame]


@dataclass
class Report:
    """The result of one analysis: small DataFrames keyed by ``run_id``."""

    profile: DataFrame
    findings: DataFrame
    scores: DataFrame
    correlations: DataFrame
    outliers: DataFrame
    skipped: dict[str, str] = field(default_factory=dict)

    def recommendations(self, k: int = 5) -> DataFrame:
        return views.recommendations(self.findings, self.scores, k)

    def summary(self) -> DataFrame:
        return narrative.executive_summary(self.scores, self.findings)

    def markdown(self) -> DataFrame:
        return narrative.report_markdown(self.scores, self.findings)

    def modeling_warnings(self) -> DataFrame:
        return self.findings.filter("category = 'modeling_warning'")


def settle(df: DataFrame) -> DataFrame:
    """Run a plan whose result is bounded by the number of columns, and keep the rows."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def analyze(
    df: DataFrame,
    name: str = "table",
    target: str | None = None,
    *,
    run_id: str | None = None,
    settings: Settings = DEFAULTS,
    checks: dict[str, Check] | None = None,
    on_error: str = "raise",
) -> Report:
    """Profile, check and score a table.

    An unknown target is ignored. ``settings.max_rows`` caps the rows by a
    repeatable sample; by default every row counts. ``checks`` adds own checks:
    functions of (table, profile, target) returning findings. With
    ``on_error="skip"`` a failing check is left out and named in ``skipped``.
    """
    spark = df.sparkSession
    run = run_id or name
    check_limits(df, settings)
    if target not in df.columns:
        target = None
    df = missing_as_null(df)
    total = None
    sampled = False
    if settings.max_rows is not None:
        df, sampled, total = cap_rows(df, settings.max_rows, settings.seed)

    described = settle(profile(df, run, settings))
    targets = spark.createDataFrame([(run, target)], "run_id string, target string")
    meta = context.dataset_types(described, targets)
    meta = meta.join(context.possible_targets(described, meta, settings), "run_id")
    meta = settle(readiness.with_features(meta))
    run_facts = meta.first()
    described = settle(context.column_roles(described, F.lit(target).cast("string")))
    rows = described.orderBy("ordinal").collect()
    place = F.create_map(*[v for r in rows for v in (F.lit(r["column"]), F.lit(r["ordinal"]))])
    n_rows = rows[0]["n_rows"] if rows else 0

    skipped: dict[str, str] = {}
    parts: list[DataFrame] = []

    def check(label: str, make: Callable[[], list[DataFrame]]) -> None:
        try:
            parts.extend(make())
        except Exception as problem:  # noqa: BLE001
            if on_error != "skip":
                raise
            skipped[label] = f"{type(problem).__name__}: {problem}"

    def of_run(small: DataFrame) -> DataFrame:
        """Adds the facts about the run."""
        return small.withColumns(
            {
                "run_id": F.lit(run),
                "target": F.lit(target).cast("string"),
                "target_provided": F.lit(target is not None),
                "dataset_type": F.lit(run_facts["dataset_type"]),
            }
        )

    def by_column(metrics: DataFrame) -> DataFrame:
        return of_run(metrics).withColumn("ordinal", place[F.col("column")])

    about = of_run(described)

    def missing_checks() -> list[DataFrame]:
        out = []
        gappy = [r["column"] for r in rows if 0 < r["n_null"] < r["n_rows"]]
        clustered: list[str] = []
        if len(gappy) >= 2:
            pairs = settle(missingness.mask_correlation(df, gappy))
            if len(gappy) >= 3:
                cluster = settle(missingness.missing_cluster(pairs, settings))
                clustered = [c for r in cluster.collect() for c in r["columns"]]
                out.append(missingness.cluster_findings(of_run(cluster)))
            free = pairs.filter(~F.col("column").isin(clustered) & ~F.col("column2").isin(clustered))
            out.append(missingness.co_missing_findings(of_run(free), settings))
        out.append(missingness.missing_value_findings(about.filter(~F.col("column").isin(clustered)), settings))
        period = missingness.period_column(rows)
        if period:
            asked = [
                r["column"] for r in rows
                if r["n_null"] >= settings.regime_min_missing
                and r["column"] not in clustered and r["column"] != period.column
            ]
            if asked:
                gaps = settle(missingness.missing_by_period(df, period.value, asked))
                out.append(
                    missingness.regime_findings(by_column(gaps).withColumn("period_column", F.lit(period.column)), settings)
                )
        return out

    copies: list[DataFrame] = []

    def duplicate_checks() -> list[DataFrame]:
        counts = settle(duplicates.duplicate_counts(df))
        copies.append(of_run(counts))
        out = [duplicates.duplicate_findings(copies[0], settings)]
        ids = [r["column"] for r in rows if r["is_id_like"] and r["column"] != target]
        if target and ids:
            clashes = settle(duplicates.id_conflicts(df, ids, target))
            out.append(duplicates.id_conflict_findings(by_column(clashes)))
        return out

    support: list[DataFrame] = []

    def class_checks() -> list[DataFrame]:
        goal = next((r for r in rows if r["column"] == target), None)
        if goal is None or goal["kind"] == "nested" or not (goal["n_unique"] or 0):
            return []
        if not association.is_class_target(goal, settings):
            return []
        summary = settle(imbalance.class_summary(df, target))
        pairs = []
        if goal["n_unique"] <= settings.max_balance_classes:
            pairs = imbalance.class_proportions(df, target).select("class", "proportion").collect()
        shares = F.map_from_entries(
            F.array(*[F.struct(F.lit(p["class"]), F.lit(p["proportion"])) for p in pairs])
        ) if pairs else F.lit(None).cast("map<string,double>")
        classes = of_run(summary).withColumns(
            {
                "proportions": shares,
                "dtype_inferred": F.lit(goal["dtype_inferred"]),
                "n_unique": F.lit(goal["n_unique"]),
                "n_rows": F.lit(goal["n_rows"]),
            }
        )
        support.append(classes)
        return [imbalance.imbalance_findings(classes, settings)]

    spreads: list[DataFrame] = []

    def outlier_checks() -> list[DataFrame]:
        asked = {
            r["column"]: numeric(r["column"], r["kind"])
            for r in rows
            if r["dtype_inferred"] == "numeric" and r["n_rows"] - r["n_null"] >= 10
        }
        if not asked:
            return []
        known = {r["column"]: r["n_unique"] for r in rows if r["column"] in asked} if settings.exact_distinct else None
        metrics = by_column(settle(outliers.outlier_metrics(df, asked, settings, known)))
        spreads.append(metrics)
        return [outliers.outlier_findings(metrics, settings)]

    def leak_checks() -> list[DataFrame]:
        if target is None:
            return [leakage.suspicious_name_findings(about)]
        goal = next(r for r in rows if r["column"] == target)
        if goal["kind"] == "nested":
            return []
        out = [leakage.id_feature_findings(about, settings)]
        if copies:
            out.append(leakage.split_leak_findings(copies[0]))
        tested, aim = association.describe_columns(rows, target, settings)
        if tested and (goal["n_unique"] or 0) > 0:
            metrics = settle(association.target_association(df, tested, aim, settings))
            out.append(leakage.association_findings(by_column(metrics), settings))
        return out

    numbers = [r for r in rows if r["dtype_inferred"] == "numeric" and not r["is_id_like"]]
    pairs_of: list[DataFrame] = []

    def pair_checks() -> list[DataFrame]:
        out = [features.feature_findings(about, settings)]
        if len(numbers) < 2:
            return out
        complete = {r["column"] for r in numbers if r["n_null"] == 0 and r["kind"] == "number"}
        pairs = settle(
            correlation.pair_correlations(
                df, {r["column"]: numeric(r["column"], r["kind"]) for r in numbers}, complete, settings
            )
        )
        pairs_of.append(pairs)
        known = of_run(pairs)
        out.append(features.near_duplicate_findings(known, settings))
        shown = [r["column"] for r in numbers[: settings.heatmap_columns]]
        out.append(correlation.matrix_findings(settle(_matrix(known, shown, {r["column"] for r in numbers if r["is_constant"]}))))
        out.append(correlation.strong_pair_findings(known, settings))
        return out

    def readiness_checks() -> list[DataFrame]:
        out = [readiness.sample_size_rules(meta), readiness.generalization_findings(about)]
        if target is None and run_facts["dataset_type"] == "historical_archive":
            out.append(readiness.near_unique_cluster_findings(settle(readiness.near_unique_clusters(about))))
        late = settle(readiness.post_outcome_columns(about))
        out.append(readiness.post_outcome_findings(late))
        weak = False
        if support:
            out.append(readiness.target_support_findings(support[0], settings))
            weak = bool(support[0].filter(readiness.weak_target(settings)).take(1))
        crowd = len(readiness.near_unique(about).select("column").collect())
        suspects = late.collect()
        known = meta.withColumns(
            {
                "n_near_unique": F.lit(crowd),
                "weak_target": F.lit(weak),
                "late_columns": F.lit(len(suspects[0]["columns"]) if suspects else 0),
            }
        )
        out.append(readiness.purpose_findings(known))
        return out

    if n_rows:
        check("missingness", missing_checks)
        check("duplicates", duplicate_checks)
        check("imbalance", class_checks)
        check("outliers", outlier_checks)
        check("leakage", leak_checks)
        check("feature_quality", pair_checks)
        check("model_readiness", readiness_checks)
        for label, own in (checks or {}).items():
            check(label, lambda own=own: [own(df, about, target)])

    made = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    numbered = settle(number_findings(spark, parts))
    described_run = meta.select(
        "run_id",
        F.lit(name).alias("dataset_name"),
        F.lit(total if total is not None else n_rows).cast("bigint").alias("n_rows_total"),
        F.col("n_rows"),
        F.col("n_rows").alias("n_rows_analyzed"),
        "n_cols",
        F.lit(sampled).alias("sampled"),
        "target",
        "target_provided",
        "possible_targets",
        "dataset_type",
        "n_numeric",
        "n_categorical",
        "n_datetime",
        "n_id_like",
    )
    costs = settle(scoring.penalties(numbered))
    weighed = settle(described_run.join(scoring.tally(costs), "run_id", "left"))
    scored = scoring.judge(weighed, described_run.columns)
    hashed = fingerprint(described, numbered).first()
    scored = scored.withColumns(
        {"n_rows": F.col("n_rows_total"), "generated_at": F.lit(made), "fingerprint": F.lit(hashed["fingerprint"] if hashed else None).cast("string")}
    )
    empty = spark.createDataFrame([], correlation.PAIR_SCHEMA)
    return Report(
        profile=described,
        findings=costs.drop("iw", "rw", "i_cost", "r_cost"),
        scores=settle(scored.drop("n_rows_total")),
        correlations=pairs_of[0] if pairs_of else empty,
        outliers=spreads[0] if spreads else spark.createDataFrame([], "run_id string, ordinal int, column string, n bigint, q1 double, median double, q3 double, mad double, n_outliers bigint, outlier_rate double"),
        skipped=skipped,
    )


def analyze_tables(tables: dict[str, DataFrame], targets: dict[str, str] | None = None,
                   settings: Settings = DEFAULTS, parallel: int = 4) -> dict[str, Report]:
    """One report per table; the union of their frames is a fleet view keyed by ``run_id``.

    ``parallel`` tables are analysed at a time, each in a scheduler pool of its own: an analysis is a chain of short jobs, which
    leave executors idle between them. With ``spark.scheduler.mode=FAIR`` a large table does not hold up the small ones. A failing
    table raises after the others have ended.
    """
    targets = targets or {}

    def run(name: str) -> Report:
        df = tables[name]
        context = df.sparkSession.sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"assay-{name}")
        try:
            return analyze(df, name, targets.get(name), settings=settings)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        runs = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in tables}
    return {name: done.result() for name, done in runs.items()}


def fleet(reports: dict[str, Report]) -> tuple[DataFrame, DataFrame]:
    """Scores and findings of many reports as two DataFrames."""
    found = list(reports.values())
    return (
        reduce(DataFrame.unionByName, [r.scores for r in found]),
        reduce(DataFrame.unionByName, [r.findings for r in found]),
    )


def _matrix(pairs: DataFrame, labels: list[str], constant: set[str]) -> DataFrame:
    """``run_id, labels, matrix``: at most ``heatmap_columns`` squared numbers per run; constant columns go with nothing, not even themselves."""
    place = {c: i for i, c in enumerate(labels)}
    r = F.round(F.coalesce("r", F.lit(0.0)), 3).alias("r")
    both = pairs.filter(F.col("column").isin(labels) & F.col("column2").isin(labels))
    cells = both.select("run_id", "column", "column2", r).unionByName(
        both.select("run_id", F.col("column2").alias("column"), F.col("column").alias("column2"), r)
    )
    index = F.create_map(*[F.lit(v) for pair in place.items() for v in pair])
    numbered = cells.select("run_id", index[F.col("column")].alias("i"), index[F.col("column2")].alias("j"), "r")
    alone = F.col("i").isin([place[c] for c in labels if c in constant])
    own = numbered.select("run_id", "i", F.col("i").alias("j"), F.when(alone, 0.0).otherwise(1.0).alias("r")).distinct()
    lines = (
        numbered.unionByName(own)
        .groupBy("run_id", "i")
        .agg(F.sort_array(F.collect_list(F.struct("j", "r"))).alias("line"))
    )
    return (
        lines.groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("i"), F.col("line.r").alias("cells")))).alias("m"))
        .select("run_id", F.array(*[F.lit(c) for c in labels]).alias("labels"), F.col("m.cells").alias("matrix"))
    )
