"""Where reports go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_json(report) -> DataFrame:
    """``run_id, report``: scores, profile and findings of each run as one JSON text.

    Bounded by the number of columns and findings of a run.
    """
    columns = report.profile.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in report.profile.columns if c not in ("ordinal", "run_id")]))).alias("columns")
    )
    found = report.findings.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", *[c for c in report.findings.columns if c not in ("seq", "run_id")]))).alias("findings")
    )
    advice = report.recommendations().groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "title", "why", "fix"))).alias("recommendations")
    )
    scores = report.scores.join(report.summary(), "run_id")
    joined = scores.join(columns, "run_id", "left").join(found, "run_id", "left").join(advice, "run_id", "left")
    return joined.select("run_id", F.to_json(F.struct(*[c for c in joined.columns])).alias("report"))


def write_report(report, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """``json`` (one document per run), ``markdown`` (text), or ``parquet`` (three tables)."""
    if fmt == "json":
        report_json(report).select("report").write.mode(mode).text(path)
    elif fmt == "markdown":
        report.markdown().select("markdown").write.mode(mode).text(path)
    elif fmt == "parquet":
        report.scores.write.mode(mode).parquet(f"{path}/scores")
        report.profile.write.mode(mode).parquet(f"{path}/profile")
        report.findings.write.mode(mode).parquet(f"{path}/findings")
    else:
        raise ValueError(f"unknown format {fmt!r}: use json, markdown or parquet")
