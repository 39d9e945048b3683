"""The findings contract and the helper that turns rules into finding rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import ENGINES, SEVERITY_RANK

# Metrics that scoring reads are typed columns; all metrics are also in metrics_json.
TYPED_METRICS = {
    "null_rate": "double",
    "readiness_penalty": "double",
    "readiness_cap": "double",
    "overall_cap": "double",
    "dataset_purpose": "string",
    "dataset_purpose_cap": "string",
}
FINDING_SCHEMA = (
    "run_id string, engine string, code string, severity string, severity_rank int, category string, "
    "column string, column2 string, title string, detail string, impact string, fix_snippet string, "
    "metrics_json string, null_rate double, readiness_penalty double, readiness_cap double, "
    "overall_cap double, dataset_purpose string, dataset_purpose_cap string, block int, place int, place2 int"
)


def severity_rank(severity: Column) -> Column:
    return F.get(
        F.array(*[F.lit(r) for r in SEVERITY_RANK.values()]),
        (F.array_position(F.array(*[F.lit(s) for s in SEVERITY_RANK]), severity) - 1).cast("int"),
    )


def finding(
    code: str | Column,
    severity: str | Column,
    title: Column,
    detail: Column,
    impact: str | Column,
    fix: Column | str | None = None,
    column: Column | None = None,
    column2: Column | None = None,
    category: str | Column = "data_integrity",
    metrics: dict[str, Column] | None = None,
    block: int = 0,
    place: Column | None = None,
    place2: Column | None = None,
) -> list[Column]:
    """The columns of one finding. ``block``, ``place``, ``place2`` order findings in their engine."""

    def literal(v):
        return v if isinstance(v, Column) else F.lit(v)

    values = {
        "code": literal(code),
        "severity": literal(severity),
        "category": literal(category),
        "title": title,
        "detail": detail,
        "impact": literal(impact),
        "block": F.lit(block),
    }
    optional = {"column": column, "column2": column2, "place": place, "place2": place2}
    values.update({k: v for k, v in optional.items() if v is not None})
    if fix is not None:
        values["fix_snippet"] = literal(fix)
    if metrics:
        values["metrics_json"] = F.to_json(F.struct(*[v.alias(k) for k, v in metrics.items()]))
        for name, kind in TYPED_METRICS.items():
            if name in metrics:
                values[name] = metrics[name].cast(kind)
    return [v.alias(k) for k, v in values.items()]


def emit(rows: DataFrame, engine: str, rules: list[tuple[Column, list[Column]]]) -> DataFrame:
    """One finding per row and rule that holds. ``rows`` must carry ``run_id``.

    ``rows`` are small (columns, pairs of columns, runs) and settled, so every
    rule is a filter and a projection the optimizer folds at planning time.
    """
    parts = [
        rows.filter(condition).select("run_id", F.lit(engine).alias("engine"), *columns)
        for condition, columns in rules
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)


def number_findings(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """All findings of all runs with ``severity_rank`` and ``seq``, their order inside a run."""
    everything = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, no_findings(spark)
    )
    rank = F.array_position(F.array(*[F.lit(e) for e in ENGINES]), F.col("engine"))
    # a run has a bounded number of findings: columns and pairs of columns
    w = Window.partitionBy("run_id").orderBy(
        F.when(rank > 0, rank).otherwise(len(ENGINES) + 1),
        F.coalesce("block", F.lit(0)), F.coalesce("place", F.lit(0)), F.coalesce("place2", F.lit(0)),
        "code", "column", "column2",
    )
    return everything.withColumns(
        {
            "severity_rank": severity_rank(F.col("severity")),
            "metrics_json": F.coalesce("metrics_json", F.lit("{}")),
            "seq": F.row_number().over(w),
        }
    ).drop("block", "place", "place2")


def percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", share * 100)
