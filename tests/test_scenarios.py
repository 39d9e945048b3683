"""Whole analyses of tables with planted faults: score bands, table kind, finding codes."""

from __future__ import annotations

import pandas as pd
import pytest
from scenarios import SCENARIOS

import assay

REPORTS: dict = {}


def report_of(spark, name):
    if name not in REPORTS:
        s = SCENARIOS[name]
        df = spark.createDataFrame(s.make())
        r = assay.analyze(df, name, s.target)
        REPORTS[name] = (r, r.scores.first(), r.findings.orderBy("seq").collect())
    return REPORTS[name]


@pytest.mark.parametrize("name", list(SCENARIOS))
def test_bands_and_codes(spark, name):
    s = SCENARIOS[name]
    _, scores, found = report_of(spark, name)
    codes = {f["code"] for f in found}
    for kind in ("integrity", "readiness", "overall"):
        low, high = getattr(s, kind)
        assert low <= scores[f"{kind}_score"] <= high, (kind, scores[f"{kind}_score"], [(f["code"], f["column"], f["severity"]) for f in found])
    assert s.codes <= codes, s.codes - codes
    assert not s.absent & codes
    if s.kind:
        assert scores["dataset_type"] == s.kind
    assert scores["grade"] in {"A", "A-", "B+", "B", "B-", "C", "D", "F"}
    assert scores["health_score"] == scores["overall_score"]
    assert [f["seq"] for f in found] == list(range(1, len(found) + 1))


def test_order_of_plain_dirty_and_leaking(spark):
    plain, dirty, leaking = (report_of(spark, n)[1]["overall_score"] for n in ("library_loans", "harvest", "clinic"))
    assert plain > dirty > leaking
    assert report_of(spark, "clinic")[1]["grade"] == "F"


def test_outliers_are_warnings(spark):
    _, _, found = report_of(spark, "gateway")
    tails = [f for f in found if f["engine"] == "outliers"]
    assert tails and all(f["category"] == "modeling_warning" for f in tails)
    assert {f["severity"] for f in tails} <= {"medium", "low"}
    assert sum(f["integrity_penalty"] for f in tails) <= 3.0
    assert any("heavy-tailed" in f["title"] for f in tails)
    assert any("Do not blindly remove" in f["fix_snippet"] for f in tails)


def test_roles_of_traffic_columns(spark):
    r, _, _ = report_of(spark, "gateway")
    roles = {p["column"]: p["column_role"] for p in r.profile.collect()}
    for c in ("payload_kb", "traffic_in", "packets", "login_attempts", "flow_duration"):
        assert roles[c] == "measurement"


def test_measurements_are_not_identifiers(spark):
    r, _, _ = report_of(spark, "county_clinics")
    rows = {p["column"]: p for p in r.profile.collect()}
    for c in ("Visit Count_emergency", "Visit Count_planned", "Population", "Visit Rate", "Bed Density"):
        assert (rows[c]["dtype_inferred"], rows[c]["name_kind"], rows[c]["is_id_like"]) == ("numeric", "measurement", False)


def test_regatta_is_for_exploration(spark):
    r, scores, _ = report_of(spark, "regatta")
    assert scores["dataset_purpose"] in {"EDA-only / visualization dataset", "Not suitable for supervised ML"}
    assert scores["readiness_confidence"] == "low"
    text = r.summary().first()["exec_summary"]
    assert scores["dataset_purpose"] in text and "Start with what a model needs" in text


def test_tenancy_targets_and_roles(spark):
    r, scores, found = report_of(spark, "tenancies")
    assert "outcome" in scores["possible_targets"] and scores["target"] is None
    roles = {p["column"]: p["column_role"] for p in r.profile.collect()}
    assert roles["tenant_id"] == "identifier" and roles["outcome"] in {"categorical", "target"}
    assert any(f["column"] == "deposit" for f in found)


def test_market_confidence(spark):
    _, scores, found = report_of(spark, "market_stalls")
    assert {f["column"] for f in found if f["code"] == "MESSY_NUMERIC_TEXT"} == {"asking_price", "kms_driven"}
    assert scores["integrity_confidence"] == "high" and "finding" in scores["integrity_confidence_reason"]


def test_schedule_has_no_median_advice(spark):
    _, scores, found = report_of(spark, "timetable")
    assert scores["supervised_ml_readiness"] == "N/A"
    assert not any("median" in (f["fix_snippet"] or "") for f in found if f["column"] == "group")
    assert "scheduling" in scores["dataset_purpose"]


def test_archive_words(spark):
    _, scores, found = report_of(spark, "olympiads")
    assert "historical" in scores["dataset_purpose"].lower()
    assert "not suitable for reliable supervised ml" in scores["verdict"].lower()
    assert not any(f["engine"] == "imbalance" for f in found)


def test_markdown_and_recommendations(spark):
    r, scores, found = report_of(spark, "clinic")
    text = r.markdown().first()["markdown"]
    assert text.startswith("# Data quality report: clinic") and f"## Findings ({len(found)})" in text
    assert "[CRITICAL]" in text and "**Target:** `missed`" in text
    advice = r.recommendations().collect()
    assert 1 <= len(advice) <= 5
    for a in advice:
        assert a["fix"] is None or (a["fix"]["type"] == "python" and "`" not in a["fix"]["code"])
        assert a["text"].startswith(a["title"])


def test_all_null_column_and_unknown_target(spark):
    df = spark.createDataFrame(
        pd.DataFrame({"a": [None] * 3, "b": ["x"] * 3, "c": [1, 2, 3]}).astype({"a": "object"}),
        "a string, b string, c bigint",
    )
    r = assay.analyze(df, "all_null", "no_such_column")
    scores = r.scores.first()
    assert scores["target"] is None
    rows = {p["column"]: p for p in r.profile.collect()}
    assert rows["a"]["dtype_inferred"] == "categorical" and rows["a"]["null_rate"] == 1.0


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(SCENARIOS["parcels"].make())
    kept = ("seq", "code", "severity", "column", "column2", "metrics_json", "integrity_penalty")
    one, many = (
        [tuple(r) for r in assay.analyze(df.repartition(n), "x", "returned").findings.select(*kept).orderBy("seq").collect()]
        for n in (1, 8)
    )
    assert one == many


def test_own_check_and_skipped_check(spark):
    from pyspark.sql import functions as F

    from assay.operators.findings import emit, finding

    def own(df, profile, target):
        return emit(profile, "own", [(F.col("ordinal") == 0, finding("OWN", "low", F.lit("t"), F.lit("d"), "i", column=F.col("column")))])

    def broken(df, profile, target):
        raise RuntimeError("no")

    df = spark.createDataFrame(SCENARIOS["members"].make())
    r = assay.analyze(df, "x", checks={"own": own, "broken": broken}, on_error="skip")
    assert r.findings.filter("code = 'OWN'").count() == 1
    assert list(r.skipped) == ["broken"]
