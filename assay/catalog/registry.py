"""Registered queries: every operator over whole given tables, with comparison SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import (
    association, column_state, correlation, duplicates, features, findings, imbalance, leakage, missingness, order_stats, outliers, profile as P,
    readiness, repair, value_counts,
)
from ..operators.columns import col, long_form
from ..plans import classifier, context, narrative, scoring, usage, views
from ..plans.analyze import analyze, analyze_tables, settle
from ..session import checkpoint_folder, held
from ..sources import csv, limits, sampling, sinks, usage_log
from ..streaming import usage as stream_usage
from . import oracle as O
from .tables import TABLES, frame, sql_of, table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    item: str  # inventory line it belongs to
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(key: str, item: str, sql: str | None = None):
    def add(run: Run) -> Run:
        REGISTRY[key] = Query(key, item, run, sql)
        return run

    return add


def prof(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    return P.profile(frame(spark, folder, name), run or name, _NO_SAMPLES)


_NO_SAMPLES = S.Settings(sample_values=0)


def profiles_of(spark: SparkSession, folder: str, names) -> DataFrame:
    """Profiles of several tables in one job, settled: one row per column."""
    return settle(reduce(DataFrame.unionByName, [prof(spark, folder, n) for n in names]))


def _r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- sources, guards, samples ---------------------------------------------------


@register(
    "csv_scan", "S1",
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def _(spark, folder):
    path = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, folder, "part").write.option("header", True).csv(path)
    return csv.read_csv(spark, path)


@register("csv_line_breaks", "S1", "SELECT * FROM documents")
def _(spark, folder):
    """Quoted texts with line breaks and quotes come back as they were."""
    path = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    writer = table(spark, folder, "documents").write.option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv.read_csv(spark, path, tasks=16)


@register(
    "input_limits", "S3",
    """SELECT (SELECT count(*) FROM information_schema.columns WHERE table_name = 'lineitem') AS n_cols, count(*) AS n_rows, false AS no_columns,
 true AS too_many_columns, count(*) = 0 AS no_rows FROM lineitem""",
)
def _(spark, folder):
    return limits.input_limits(table(spark, folder, "lineitem"), S.Settings(max_columns=5))


@register(
    "file_size_guard", "S3",
    "SELECT * FROM (VALUES ('one byte', true), ('its size', false), ('no limit', false)) AS t(allowed, refused), (SELECT count(*) AS n_rows FROM documents) AS d",
)
def _(spark, folder):
    """Files that are larger than allowed are refused before they are read."""
    df = table(spark, folder, "documents")

    def refused(size: int | None) -> bool:
        try:
            limits.check_limits(df, S.Settings(max_file_bytes=size))
        except limits.LimitError:
            return True
        return False

    sizes = {"one byte": 1, "its size": limits.file_bytes(df), "no limit": None}
    rows = spark.createDataFrame([(k, refused(v)) for k, v in sizes.items()], "allowed string, refused boolean")
    return rows.crossJoin(df.agg(F.count(F.lit(1)).alias("n_rows")))  # a single row


_REPORTED = ("nation", "labels")


@register(
    "report_as_json", "S4",
    O.profile_ctes(list(_REPORTED)) + """ SELECT run_id, ordinal, column_name AS "column", dtype AS dtype_inferred, n_unique, n_rows, true AS scored FROM p""",
)
def _(spark, folder):
    """The JSON text read back: one row per column it describes, and whether its scores are there."""
    reports = analyze_tables({name: frame(spark, folder, name) for name in _REPORTED})
    text = reduce(DataFrame.unionByName, [sinks.report_json(r) for r in reports.values()])
    shape = "integrity_score double, overall_score double, verdict string, generated_at string, findings array<struct<code string>>, " \
            "columns array<struct<ordinal int, column string, dtype_inferred string, n_unique bigint, n_rows bigint>>"
    read = text.select("run_id", F.from_json("report", shape).alias("r"))
    scored = (F.col("r.overall_score").between(0, 100) & F.col("r.verdict").isNotNull() & F.col("r.generated_at").rlike("^[0-9]{4}-.*Z$")).alias("scored")
    return read.select("run_id", scored, F.inline("r.columns"))


@register(
    "report_as_markdown", "S7",
    f"""SELECT 'part_text' AS run_id, '# Data quality report: part_text' AS first, '**Rows:** ' || format('{{:,}}', count(*)) || ' | **Columns:** 10' AS shape, true AS complete
FROM ({sql_of('part_text')})""",
)
def _(spark, folder):
    """First line, line of the shape, and whether every finding is listed under the announced number and the text is closed."""
    report = analyze(frame(spark, folder, "part_text"), "part_text")
    lines = F.split("markdown", "\n")
    starts = lambda mark: F.filter(lines, lambda line: line.startswith(mark))
    listed = F.size(starts("### ["))
    told = F.regexp_extract(F.get(starts("## Findings ("), F.lit(0)), r"\((\d+)\)", 1).cast("int")
    complete = (listed == told) & (told == report.findings.count()) & F.element_at(lines, -1).rlike("^_Made .*Z[.]_$")
    return report.markdown().select("run_id", lines[0].alias("first"), F.get(starts("**Rows:**"), F.lit(0)).alias("shape"), complete.alias("complete"))


@register("analysis_report", "S2")
def _(spark, folder):
    report = analyze(frame(spark, folder, "leaky"), "leaky", "quality")
    return report.findings.select("run_id", "seq", "engine", "code", "severity", "category", "column", "integrity_penalty", "readiness_penalty_applied")


@register(
    "capped_rows", "T1",
    f"SELECT least(5000, count(*)) AS n_rows, true AS sampled, count(*) AS total, 0::BIGINT AS strangers, 0::BIGINT AS moved FROM ({sql_of('copies')})",
)
def _(spark, folder):
    """Size, rows that are not of the table, and rows that change with the partitioning. Rows dealt anew go to tasks of bounded size, not to a fixed number."""
    df = frame(spark, folder, "copies")
    rows, sampled, total = sampling.cap_rows(df, 5_000)
    again, _, _ = sampling.cap_rows(df.hint("rebalance"), 5_000)
    checkpoint_folder(spark)
    rows = rows.checkpoint()  # at most 5 000 rows, used three times: drawn from the table once
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(sampled).alias("sampled"), F.lit(total).cast("bigint").alias("total"))
    strangers = rows.exceptAll(duplicates.rows_like(df, rows))
    return out.crossJoin(strangers.agg(F.count(F.lit(1)).alias("strangers"))).crossJoin(  # three single rows
        rows.exceptAll(again).agg(F.count(F.lit(1)).alias("moved")))


@register(
    "hash_sample", "T2",
    "SELECT count(*) AS n_rows, 0::BIGINT AS strangers, true AS near, count(DISTINCT l_orderkey) AS n_keys, 0::BIGINT AS split_keys FROM lineitem",
)
def _(spark, folder):
    """Size within a tenth, rows that are not of the table, and keys that a sample by key has torn apart."""
    df = table(spark, folder, "lineitem")
    rows, by_key = sampling.sample_share(df, 0.25), sampling.sample_share(df, 0.25, key=["l_orderkey"])
    total = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_orderkey").alias("n_keys"))
    size = rows.agg(F.count(F.lit(1)).alias("drawn"))
    torn = df.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(by_key.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")), "l_orderkey")
    single = total.crossJoin(size).crossJoin(rows.exceptAll(df).agg(F.count(F.lit(1)).alias("strangers")))  # single rows
    single = single.crossJoin(torn.filter("n <> k").agg(F.count(F.lit(1)).alias("split_keys")))
    return single.select("n_rows", "strangers", (F.abs(F.col("drawn") / F.col("n_rows") - 0.25) < 0.025).alias("near"), "n_keys", "split_keys")


_PROBE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS probed, round(avg(CASE WHEN {O.number_test('v')} THEN 1.0 ELSE 0 END), 6) AS numeric_parse_rate,
 round(avg(CASE WHEN {O.number_test(O.cleaned('v'))} THEN 1.0 ELSE 0 END), 6) AS clean_numeric_parse_rate,
 round(avg(CASE WHEN {O.date_test('v')} THEN 1.0 ELSE 0 END), 6) AS datetime_parse_rate
 FROM (SELECT {c} AS v, row_number() OVER (ORDER BY p_partkey) AS k FROM ({sql_of('part_text')}) WHERE {c} IS NOT NULL) WHERE k <= 200"""
    for c in ("size_text", "price_text", "mixed")
)


@register("head_probe", "T3", _PROBE_SQL)
def _(spark, folder):
    out = P.head_probe(frame(spark, folder, "part_text"), ["size_text", "price_text", "mixed"], F.col("p_partkey"), 200)
    return out.select("column", "probed", *_r6("numeric_parse_rate", "clean_numeric_parse_rate", "datetime_parse_rate"))


def _shown(v: str) -> str:
    return f"CASE WHEN length({v}) > 40 THEN substr({v}, 1, 37) || '...' ELSE {v} END"


@register(
    "sample_values", "T4",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", k::INT AS position, {_shown('v')} AS value FROM (SELECT v, row_number() OVER (ORDER BY v) AS k
 FROM (SELECT DISTINCT {c} AS v FROM part)) WHERE k <= 3"""
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(spark, folder):
    df = table(spark, folder, "part").select("p_name", "p_brand", "p_type")
    return value_counts.sample_values(df)


@register(
    "first_seen_values", "T4",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", k::INT AS position, {_shown('v')} AS value FROM (SELECT v, row_number() OVER (ORDER BY r, v) AS k
 FROM (SELECT CAST({c} AS VARCHAR) AS v, min(doc_id) AS r FROM documents GROUP BY 1)) WHERE k <= 3"""
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
)
def _(spark, folder):
    return value_counts.sample_values(table(spark, folder, "documents"), 3, F.col("doc_id"))


# --- profiles -------------------------------------------------------------------

_FULL = (
    "run_id", "ordinal", "column", "kind", "dtype_inferred", "name_kind", "n_rows", "n_null", "null_rate", "n_unique",
    "cardinality_ratio", "top_count",
)
_FLAGS = ("is_id_like", "is_high_cardinality", "is_constant")
_RATES = ("top_share", "numeric_parse_rate", "clean_numeric_parse_rate", "datetime_parse_rate", "avg_len")


def _full_profile(name: str) -> None:
    @register(f"profile_{name}", "P1-P14", O.profile_ctes([name]) + f"\nSELECT {O.PROFILE_COLUMNS} FROM p")
    def _(spark, folder):
        return prof(spark, folder, name).select(*_FULL, *_r6(*_RATES), *_FLAGS)


for _name in ("lineitem", "labelled", "part_text", "order_text", "events", "embeddings", "customer"):
    _full_profile(_name)


def _profile_view(key: str, item: str, name: str, spark_columns: Callable[[], list], sql_columns: str) -> None:
    @register(key, item, O.profile_ctes([name]) + f'\nSELECT column_name AS "column", {sql_columns} FROM p')
    def _(spark, folder):
        return prof(spark, folder, name).select("column", *spark_columns())


_profile_view("row_counts", "P1", "orders", lambda: ["n_rows"], "n_rows")
_profile_view("null_rates", "P2", "clustered", lambda: ["n_null", "null_rate"], "n_null, null_rate")
_profile_view("distinct_counts", "P3", "supplier", lambda: ["n_unique"], "n_unique")
_profile_view("cardinality_ratios", "P4", "pages", lambda: ["cardinality_ratio"], "cardinality_ratio")
_profile_view("numeric_text", "P5", "part_text", lambda: _r6("numeric_parse_rate"), "round(num, 6) AS numeric_parse_rate")
_profile_view("datetime_text", "P6", "order_text", lambda: _r6("datetime_parse_rate"), "round(dat, 6) AS datetime_parse_rate")
_profile_view("boolean_columns", "P7", "leaky", lambda: [(F.col("dtype_inferred") == "boolean").alias("is_boolean")], "dtype = 'boolean' AS is_boolean")
_profile_view("free_text", "P8", "conversations", lambda: [*_r6("avg_len"), (F.col("dtype_inferred") == "text").alias("is_text")], "round(avg_len, 6) AS avg_len, dtype = 'text' AS is_text")
_profile_view("logical_types", "P9", "order_text", lambda: ["dtype_inferred"], "dtype AS dtype_inferred")
_profile_view("name_kinds", "P10", "events", lambda: ["name_kind"], "name_kind")
_profile_view("id_like_columns", "P11", "orders", lambda: ["is_id_like", "dtype_inferred"], "id_like AS is_id_like, dtype AS dtype_inferred")
_profile_view("high_cardinality_columns", "P12", "customer", lambda: ["is_high_cardinality"], "high_card AS is_high_cardinality")
_profile_view("constant_columns", "P13", "part_text", lambda: ["is_constant"], "constant AS is_constant")


@register(
    "type_counts", "P14",
    O.profile_ctes(["lineitem"]) + """
SELECT run_id, count(*) FILTER (WHERE dtype = 'numeric') AS n_numeric, count(*) FILTER (WHERE dtype IN ('categorical', 'text', 'boolean')) AS n_categorical,
 count(*) FILTER (WHERE dtype = 'datetime') AS n_datetime, count(*) FILTER (WHERE id_like) AS n_id_like FROM p GROUP BY run_id""",
)
def _(spark, folder):
    return P.type_counts(prof(spark, folder, "lineitem"))


@register(
    "value_frequencies", "P3",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {"CAST(epoch(CAST(%s AS TIMESTAMP)) AS DECIMAL(20, 4))::VARCHAR" % c if k == "datetime" else "CAST(%s AS DECIMAL(20, 4))::VARCHAR" % c if k == "number" else c} AS value,
 count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL"""
        for t in ("lineitem", "documents") for c, k in TABLES[t].items()
    ),
)
def _(spark, folder):
    """Numbers and times are shown as decimals, as engines print them differently."""
    parts = []
    for name in ("lineitem", "documents"):
        of = {k: [c for c, kind in TABLES[name].items() if kind == k] for k in ("number", "datetime", "string")}
        found = value_counts.value_counts(table(spark, folder, name))
        number = F.col("value").try_cast("double").cast("decimal(20, 4)").cast("string")
        time = F.col("value").try_cast("timestamp").cast("double").cast("decimal(20, 4)").cast("string")
        shown = F.when(F.col("column").isin(of["number"]), number).when(F.col("column").isin(of["datetime"]), time).otherwise(F.col("value"))
        parts.append(found.select("column", shown.alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


@register(
    "approximate_profile", "P3",
    O.profile_ctes(["orders", "customer", "events", "part_text"])
    + """ SELECT run_id, column_name AS "column", n_rows, n_null, dtype AS dtype_inferred, id_like AS is_id_like, high_card AS is_high_cardinality,
 constant AS is_constant, top_count::DOUBLE / n_rows >= 0.99 AS is_quasi_constant, true AS near FROM p""",
)
def _(spark, folder):
    """Sketches decide every flag as exact counts do; ``near``: the distinct ratio is within five percent of the exact one."""
    rough = S.Settings(exact_distinct=False, sample_values=0, broadcast_rows=100)
    names = ("orders", "customer", "events", "part_text")
    found = reduce(DataFrame.unionByName, [settle(P.profile(frame(spark, folder, n), n, rough)) for n in names])
    exact = profiles_of(spark, folder, names).select("run_id", "column", F.col("n_unique").alias("u"))
    near = F.abs(F.col("n_unique") - F.col("u")) <= 0.05 * F.col("u")
    return found.join(exact, ["run_id", "column"]).select(
        "run_id", "column", "n_rows", "n_null", "dtype_inferred", "is_id_like", "is_high_cardinality", "is_constant",
        (F.coalesce("top_share", F.lit(0.0)) >= 0.99).alias("is_quasi_constant"), near.alias("near"))


@register(
    "grown_profile", "P3",
    O.profile_ctes(["orders", "events", "lineitem"])
    + """ SELECT run_id, column_name AS "column", n_rows, n_null, dtype AS dtype_inferred, id_like AS is_id_like, high_card AS is_high_cardinality,
 constant AS is_constant, top_count::DOUBLE / n_rows >= 0.99 AS is_quasi_constant FROM p""",
)
def _(spark, folder):
    """Tables that grew in three steps: a stored state per step, profiled from the states alone."""
    grown = []
    for name, key in (("orders", "o_orderkey"), ("events", "event_id"), ("lineitem", "l_orderkey")):
        df, path = table(spark, folder, name), f"{checkpoint_folder(spark)}/state-{uuid.uuid4().hex}"
        for step in range(3):
            column_state.save_state(column_state.column_state(df.where(F.pmod(F.hash(key), F.lit(3)) == step)), path, str(step))
        grown.append(settle(P.profile_of_state(column_state.read_state(spark, path), name)))
    return reduce(DataFrame.unionByName, grown).select(
        "run_id", "column", "n_rows", "n_null", "dtype_inferred", "is_id_like", "is_high_cardinality", "is_constant",
        (F.coalesce("top_share", F.lit(0.0)) >= 0.99).alias("is_quasi_constant"))


_STATE_COLUMNS = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
_STATE_SHARES = (0.01, 0.25, 0.5, 0.75, 0.99)


@register(
    "state_quantiles", "E8",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {q}::DOUBLE AS share, count({c}) AS n, min({c})::DOUBLE AS least, max({c})::DOUBLE AS greatest,
 round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation, true AS near FROM lineitem"""
        for c in _STATE_COLUMNS for q in _STATE_SHARES),
)
def _(spark, folder):
    """Moments and quantiles from the merged states of two halves; ``near``: within one percent of the exact order statistic."""
    lines = table(spark, folder, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _STATE_COLUMNS])
    half = F.pmod(F.hash("l_orderkey"), F.lit(2))
    state = column_state.merged_state(column_state.column_state(lines.where(half == 0)).unionByName(column_state.column_state(lines.where(half == 1))))
    counts = order_stats.count_present(lines, {c: F.col(c) for c in _STATE_COLUMNS})
    ranks = {(c, q): int(q * (counts[c] - 1)) for c in _STATE_COLUMNS for q in _STATE_SHARES}
    long = long_form(lines, {c: F.col(c) for c in _STATE_COLUMNS})
    exact = order_stats.order_statistics(long, {c: [(ranks[c, q],) * 2 for q in _STATE_SHARES] for c in _STATE_COLUMNS}, counts)
    truth = spark.createDataFrame([(c, q, float(exact[c, r])) for (c, q), r in ranks.items()], "column string, share double, exact double")
    found = column_state.quantiles(state, list(_STATE_SHARES)).join(column_state.moments(state), "column").join(F.broadcast(truth), ["column", "share"])
    return found.select(
        "column", "share", "n", "least", "greatest", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"),
        (F.abs(F.col("value") - F.col("exact")) <= column_state.ACCURACY * 1.0001 * F.abs("exact")).alias("near"))


_LEDGER_RUNS = {"labelled": "quality", "part_text": None, "copies": "l_returnflag", "nation": None, "region": "r_name", "archive": None}
_FINGERPRINT = """
SELECT p.run_id, substr(sha256(concat_ws('|', string_agg(column_name || ':' || dtype, ',' ORDER BY column_name || ':' || dtype),
 coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM f WHERE f.run_id = p.run_id), ''), CAST(max(n_rows) AS VARCHAR), CAST(count(*) AS VARCHAR))), 1, 16) AS fingerprint
FROM p GROUP BY p.run_id"""


# --- context --------------------------------------------------------------------


@register(
    "column_roles", "M1",
    O.profile_ctes(["leaky"]) + f'\nSELECT column_name AS "column", {O.roles("quality")} AS column_role FROM p',
)
def _(spark, folder):
    return context.column_roles(prof(spark, folder, "leaky"), F.lit("quality")).select("column", "column_role")


_TYPED = {t: None for t in TABLES} | {"archive": None, "tailed": None, "part_text": None, "regime": None, "leaky": "quality"}


@register(
    "dataset_types", "M2",
    O.profile_ctes(list(_TYPED)) + ",\n" + O.meta_ctes(_TYPED)
    + "\nSELECT run_id, n_rows, n_cols, n_numeric, n_categorical, n_datetime, n_id_like, dataset_type FROM meta",
)
def _(spark, folder):
    profiles = profiles_of(spark, folder, _TYPED)
    targets = spark.createDataFrame(list(_TYPED.items()), "run_id string, target string")
    return context.dataset_types(profiles, targets).select(
        "run_id", "n_rows", F.col("n_cols").cast("bigint").alias("n_cols"), "n_numeric", "n_categorical", "n_datetime", "n_id_like", "dataset_type"
    )


_GUESS = {"labels": None, "lineitem": None, "archive": None, "leaky": None, "many_classes": None}


@register(
    "possible_targets", "M3",
    O.profile_ctes(list(_GUESS)) + ",\n" + O.meta_ctes(_GUESS) + f""",
ll AS (SELECT p.run_id, column_name, ordinal, {O.like('column_name', S.TARGET_NAME)} AS named, dataset_type
 FROM p JOIN meta USING (run_id) WHERE NOT id_like AND NOT constant AND n_unique >= 2
 AND (dtype IN ('boolean', 'categorical') OR (dtype = 'numeric' AND n_unique <= 20)) AND dataset_type <> 'fixture_schedule'),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY named DESC, ordinal DESC) AS k FROM ll)
SELECT run_id, k::INT AS position, column_name AS "column" FROM rk
WHERE CASE WHEN dataset_type = 'historical_archive' THEN named AND k <= 4 ELSE k <= 6 END""",
)
def _(spark, folder):
    profiles = profiles_of(spark, folder, _GUESS)
    targets = spark.createDataFrame(list(_GUESS.items()), "run_id string, target string")
    meta = context.dataset_types(profiles, targets)
    found = context.possible_targets(profiles, meta)
    return found.select("run_id", F.posexplode("possible_targets").alias("i", "column")).select(
        "run_id", (F.col("i") + 1).alias("position"), "column"
    )


@register(
    "table_classifier", "M4",
    "SELECT count(*) AS n_rows, count(DISTINCT lang) AS n_classes, true AS learned FROM documents WHERE doc_id % 5 = 0 AND lang IS NOT NULL",
)
def _(spark, folder):
    """Languages of texts by the shares of some letters. Every fifth is held out; ``learned``: the forest beats the commonest class on them by ten points."""
    size = F.greatest(F.length("text"), F.lit(1))
    share = lambda c: (size - F.length(F.replace(F.lower("text"), F.lit(c)))) / size
    rows = table(spark, folder, "documents").where("lang is not null").select(
        "doc_id", "lang", *[F.coalesce(share(c), F.lit(0.0)).alias(f"share_{k}") for k, c in enumerate("aeinoukwyüñéß")])
    held = rows.filter("doc_id % 5 = 0")
    model = classifier.train_classifier(rows.filter("doc_id % 5 <> 0").drop("doc_id"), "lang", trees=40)
    out = classifier.predict(model, held.drop("doc_id"), "lang")
    right = F.avg((F.col("predicted") == F.col("lang")).cast("double"))
    most = held.groupBy("lang").count().agg(F.max("count")).first()[0]
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lang").alias("n_classes"), right.alias("right")).select(
        "n_rows", "n_classes", (F.col("right") > F.lit(most) / F.col("n_rows") + 0.1).alias("learned"))


_ROLE_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark", "nation")
_ROLE_SLICES = 2


@register(
    "role_classifier", "M4",
    f"""SELECT table_name AS run_id, count(*) * {_ROLE_SLICES + 1} AS n_columns, true AS judged, true AS learned FROM information_schema.columns
 WHERE table_name IN {_ROLE_TABLES} GROUP BY table_name""",
)
def _(spark, folder):
    """Column roles learned from descriptors of whole tables and slices of them; each table is judged by a forest that saw none of it.
    ``learned``: over all tables more columns are right than the commonest role has."""
    profiles = []
    for name in _ROLE_TABLES:
        df = table(spark, folder, name)
        part = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(_ROLE_SLICES))
        profiles.append(settle(P.profile_parts(df, part, _ROLE_SLICES, name)))  # a plan for each table: one for all is replanned at every stage
    known = settle(reduce(DataFrame.unionByName, profiles))
    roles = context.column_roles(known, F.lit(None).cast("string")).select("run_id", "column", "slice", "column_role")
    described = settle(classifier.column_descriptors(known.withColumn("run_id", F.concat_ws("/", "run_id", "slice"))))
    keyed = roles.select(F.concat_ws("/", "run_id", "slice").alias("run_id"), "column", "column_role", F.col("run_id").alias("table"))
    examples = settle(described.join(keyed, ["run_id", "column"]).drop("run_id", "column"))
    judged = settle(classifier.out_of_fold(examples, "column_role", "table", folds=4, trees=40).select("table", "column_role", "predicted"))
    right = judged.where("predicted = column_role").count()
    most = judged.groupBy("column_role").count().agg(F.max("count")).first()[0]
    return judged.groupBy(F.col("table").alias("run_id")).agg(F.count(F.lit(1)).alias("n_columns"), F.bool_and(F.col("predicted").isNotNull()).alias("judged")).withColumn("learned", F.lit(right > most))


# --- missing values -------------------------------------------------------------


@register(
    "missing_values", "E1",
    O.profile_ctes(["labelled", "regime"]) + """
SELECT run_id, column_name AS "column", CASE WHEN r >= 0.6 THEN 'critical' WHEN r >= 0.2 THEN 'high' ELSE 'medium' END AS severity,
 round(r, 4) AS null_rate, n_null AS n_missing FROM (SELECT *, n_null::DOUBLE / n_rows AS r FROM p) WHERE r >= 0.05""",
)
def _(spark, folder):
    both = profiles_of(spark, folder, ["labelled", "regime"])
    rows = both.withColumn("dataset_type", F.lit("unknown"))
    return missingness.missing_value_findings(rows).select(
        "run_id", "column", "severity", "null_rate",
        F.get_json_object("metrics_json", "$.n_missing").cast("bigint").alias("n_missing"),
    )


_GAPPY = ["quality", "toxic", "labelled_chars"]


@register(
    "missing_cluster", "E2",
    O.mask_pair_sql("clustered", _GAPPY) + """,
star AS (SELECT place, column_name, column2 FROM pr WHERE r >= 0.85 UNION ALL SELECT place2, column2, column_name FROM pr WHERE r >= 0.85),
grp AS (SELECT place, column_name, list_sort(list_append(list(DISTINCT column2), column_name)) AS members FROM star GROUP BY place, column_name)
SELECT array_to_string(members, ',') AS columns FROM grp WHERE len(members) >= 3 ORDER BY len(members) DESC, place LIMIT 1""",
)
def _(spark, folder):
    pairs = missingness.mask_correlation(frame(spark, folder, "clustered"), _GAPPY)
    return missingness.missing_cluster(pairs).select(F.array_join("columns", ",").alias("columns"))


@register(
    "missing_time_regime", "E3",
    f"""WITH src AS ({sql_of('regime')}), c AS (SELECT year(placed_at)::DOUBLE AS period, count(*) AS n FROM src
 WHERE o_totalprice IS NULL AND placed_at IS NOT NULL GROUP BY 1)
SELECT 'o_totalprice' AS "column", CAST(sum(n) AS BIGINT) AS n_missing, arg_max(period, n) AS period, round(max(n)::DOUBLE / sum(n), 6) AS missing_share FROM c""",
)
def _(spark, folder):
    df = frame(spark, folder, "regime")
    period = missingness.period_column(settle(prof(spark, folder, "regime")).orderBy("ordinal").collect())
    return missingness.missing_by_period(df, period.value, ["o_totalprice"]).select(
        "column", "n_missing", "period", *_r6("missing_share")
    )


@register(
    "co_missing", "E4",
    O.mask_pair_sql("clustered", _GAPPY) + ' SELECT column_name AS "column", column2, round(r, 6) AS corr FROM pr WHERE r >= 0.85',
)
def _(spark, folder):
    pairs = missingness.mask_correlation(frame(spark, folder, "clustered"), _GAPPY)
    return pairs.filter("corr >= 0.85").select("column", "column2", *_r6("corr"))


# --- duplicates, classes, outliers ----------------------------------------------


@register(
    "duplicate_rows", "E5",
    f"WITH src AS ({sql_of('copies')}) SELECT (SELECT count(*) FROM src) AS n_rows, (SELECT count(*) FROM src) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS dup_count",
)
def _(spark, folder):
    return duplicates.duplicate_counts(frame(spark, folder, "copies"))


_NESTED = """SELECT CASE d.doc_id % 4 WHEN 0 THEN {a}1, NULL{z} WHEN 1 THEN {a}1{z} WHEN 2 THEN {a}NULL, 1{z} END AS steps,
 CASE WHEN d.doc_id % 3 = 0 THEN {s}(l.quality, l.toxic) END AS pair FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""


@register(
    "duplicate_nested_rows", "E5",
    f"""WITH t AS ({_NESTED.format(a='[', z=']', s='row', documents='documents', labels='labels')})
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dup_count FROM t""",
)
def _(spark, folder):
    """Nulls inside arrays and structs, lengths and places count."""
    sql = _NESTED.format(a="array(", z=")", s="struct", documents="{documents}", labels="{labels}")
    df = spark.sql(sql, documents=table(spark, folder, "documents"), labels=table(spark, folder, "labels"))
    return duplicates.duplicate_counts(df)


@register(
    "conflicting_ids", "E6",
    "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1",
)
def _(spark, folder):
    return duplicates.conflicting_ids(table(spark, folder, "lineitem"), "l_orderkey", "l_returnflag")


@register(
    "id_conflict_counts", "E6",
    """SELECT 'l_orderkey' AS "column", count(*) AS conflicting_ids FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1)""",
)
def _(spark, folder):
    return duplicates.id_conflicts(table(spark, folder, "lineitem"), ["l_orderkey"], "l_returnflag")


@register(
    "class_imbalance", "E7",
    f"""WITH c AS (SELECT returned AS class, count(*) AS n FROM ({sql_of('unbalanced')}) GROUP BY 1)
SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_labelled, min(n) AS min_class_count, median(n)::DOUBLE AS median_class_count, max(n) AS max_class_count,
 CAST(arg_min(class, n) AS VARCHAR) AS minority, round(max(n)::DOUBLE / min(n), 6) AS ratio,
 CASE WHEN max(n)::DOUBLE / min(n) >= 100 THEN 'critical' WHEN max(n)::DOUBLE / min(n) >= 10 THEN 'high' END AS severity FROM c""",
)
def _(spark, folder):
    r = F.col("ratio")
    return imbalance.class_summary(frame(spark, folder, "unbalanced"), "returned").select(
        "n_classes", "n_labelled", "min_class_count", "median_class_count", "max_class_count", "minority", *_r6("ratio"),
        F.when(r >= 100, "critical").when(r >= 10, "high").alias("severity"),
    )


_TAILED = ["value", "duration_squared"]


@register(
    "outlier_statistics", "E8",
    O.outlier_sql("tailed", _TAILED) + ' SELECT column_name AS "column", n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3, round(mad, 6) AS mad, n_outliers, round(n_outliers::DOUBLE / n, 6) AS outlier_rate FROM o',
)
def _(spark, folder):
    df = frame(spark, folder, "tailed")
    out = outliers.outlier_metrics(df, {c: col(c) for c in _TAILED})
    return out.select("column", "n", *_r6("q1", "median", "q3", "mad"), "n_outliers", *_r6("outlier_rate"))


@register(
    "outlier_findings", "E8",
    O.outlier_sql("tailed", _TAILED) + f""" SELECT column_name AS "column", CASE WHEN {O.like("regexp_replace(lower(column_name), '[^a-z0-9]+', '_', 'g')", S.HEAVY_TAIL_NAME)} THEN 'HEAVY_TAILED_NUMERIC' ELSE 'OUTLIERS' END AS code,
 CASE WHEN n_outliers::DOUBLE / n >= 0.15 THEN 'medium' ELSE 'low' END AS severity FROM o WHERE n >= 10 AND n_outliers::DOUBLE / n >= 0.05""",
)
def _(spark, folder):
    df = frame(spark, folder, "tailed")
    metrics = settle(outliers.outlier_metrics(df, {c: col(c) for c in _TAILED}))
    rows = metrics.withColumns({"run_id": F.lit("tailed"), "ordinal": F.lit(0)})
    return outliers.outlier_findings(rows).select("column", "code", "severity")


# --- leakage --------------------------------------------------------------------


def _association(spark, folder, name: str, target: str) -> tuple:
    rows = settle(prof(spark, folder, name)).orderBy("ordinal").collect()
    tested, aim = association.describe_columns(rows, target)
    return frame(spark, folder, name), tested, aim


# feature -> is a quantity; the rest of the table is not eligible
_LEAKY = {"lang": False, "n_chars": True, "toxic": False, "final_label": False, "status_flag": False, "outcome_score": True,
          "fate": False, "seen_chars": True}
_ELIGIBLE_SQL = (
    "SELECT column_name AS \"column\", dtype AS dtype_inferred FROM p WHERE column_name <> '{t}' AND NOT id_like AND NOT high_card "
    "AND (dtype = 'numeric' OR cardinality_ratio < 0.5) AND dtype IN ('numeric', 'categorical', 'boolean')"
)


@register("eligible_features", "E9", O.profile_ctes(["lineitem"]) + "\n" + _ELIGIBLE_SQL.format(t="l_returnflag"))
def _(spark, folder):
    rows = settle(prof(spark, folder, "lineitem"))
    names = [r["column"] for r in rows.collect() if association.eligible(r, "l_returnflag")]
    return rows.filter(F.col("column").isin(names)).select("column", "dtype_inferred")


@register(
    "level_codes", "E10",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS level, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM lineitem)"""
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def _(spark, folder):
    return association.level_codes(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


def _association_query(key: str, item: str, name: str, target: str, classes: bool, measured: dict[str, bool], columns: tuple[str, ...]):
    picked = ", ".join(f"round({c}, 6) AS {c}" if c not in ("n_pairs", "exact") else c for c in columns)

    @register(key, item, O.association_sql(name, target, classes, measured) + f'\nSELECT column_name AS "column", {picked} FROM a')
    def _(spark, folder):
        df, tested, aim = _association(spark, folder, name, target)
        out = association.target_association(df, tested, aim)
        return out.select("column", *[F.round(c, 6).alias(c) if c not in ("n_pairs", "exact") else F.col(c) for c in columns])


_ALL = ("n_pairs", "exact", "mi", "corr", "spearman")
_LINE = {"l_partkey": True, "l_suppkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": True,
         "l_discount": True, "l_tax": True, "l_linestatus": False}
_association_query("association_leaky", "E11a-E12", "leaky", "quality", True, _LEAKY, _ALL)
_association_query("association_lineitem", "E11a-E11c", "lineitem", "l_returnflag", True, _LINE, _ALL)
_association_query(
    "association_regression", "E11a-E11c", "redundant", "net", False,
    {"l_quantity": True, "l_extendedprice": True, "l_discount": True, "l_tax": True, "double_quantity": True}, _ALL,
)
_association_query("association_gaps", "E11c", "hot_gaps", "paid", False, {"l_quantity": True, "l_discount": True, "l_tax": True}, _ALL)


@register(
    "mutual_information", "E11a",
    O.association_sql("unbalanced", "returned", True, {"l_partkey": True, "l_suppkey": True, "l_quantity": True, "l_discount": True})
    + '\nSELECT column_name AS "column", round(mi, 6) AS mi_norm FROM a',
)
def _(spark, folder):
    df, tested, aim = _association(spark, folder, "unbalanced", "returned")
    encoded = association.encode(df, tested, aim)
    return association.mutual_information(encoded, tested, aim).select("column", *_r6("mi_norm"))


@register(
    "mutual_information_in_brackets", "E11a",
    O.association_sql("unbalanced", "returned", True, {"l_partkey": True, "l_suppkey": True, "l_quantity": True, "l_discount": True})
    + '\nSELECT column_name AS "column", round(mi, 6) AS mi_norm FROM a',
)
def _(spark, folder):
    """The same with values ranked range by range, as on tables with many distinct values."""
    df, tested, aim = _association(spark, folder, "unbalanced", "returned")
    narrow = S.Settings(exact_in_one_pass=1000)
    return association.mutual_information(association.encode(df, tested, aim, narrow), tested, aim, narrow).select("column", *_r6("mi_norm"))


@register(
    "pearson_with_target", "E11b",
    O.association_sql("leaky", "quality", True, _LEAKY) + '\nSELECT column_name AS "column", n_pairs, round(r, 6) AS r FROM lin',
)
def _(spark, folder):
    df, tested, aim = _association(spark, folder, "leaky", "quality")
    return association.pearson(association.encode(df, tested, aim), tested).select("column", "n_pairs", *_r6("r"))


@register(
    "spearman_with_target", "E11c",
    O.association_sql("leaky", "quality", True, _LEAKY) + '\nSELECT column_name AS "column", round(rho, 6) AS rho FROM spr',
)
def _(spark, folder):
    df, tested, aim = _association(spark, folder, "leaky", "quality")
    return association.spearman(association.encode(df, tested, aim), tested).select("column", *_r6("rho"))


def _leak_code(target: str) -> str:
    c = "column_name"
    evidence = (
        f"({O.like(c, S.LEAKAGE_EVIDENCE)} OR ({O.like(repr(target), S.LEAKAGE_EVIDENCE)} AND {O.like(c, S.LEAKAGE_NAME)}))"
    )
    return f"""SELECT column_name, n_pairs, CASE WHEN copy AND ev THEN 'TARGET_LEAKAGE_TARGET_COPY' WHEN copy THEN 'TARGET_PROXY_RISK'
 WHEN (mi >= 0.98 OR corr >= 0.98) AND ev THEN 'TARGET_LEAKAGE_PERFECT_PREDICTOR' WHEN mi >= 0.98 OR corr >= 0.98 THEN 'TARGET_PROXY_RISK'
 WHEN {O.like(c, S.LEAKAGE_NAME)} AND ev AND (mi >= 0.7 OR corr >= 0.7) THEN 'TARGET_LEAKAGE_SUSPICIOUS_NAME' END AS code,
 copy FROM (SELECT *, n_pairs >= 10 AND (exact OR spearman >= 0.999) AS copy, {evidence} AS ev FROM a)"""


def _leak_query(key: str, item: str, condition: str):
    @register(
        key, item,
        O.association_sql("leaky", "quality", True, _LEAKY)
        + f', lc AS ({_leak_code("quality")})\nSELECT column_name AS "column", code FROM lc WHERE code IS NOT NULL AND {condition}',
    )
    def _(spark, folder):
        df, tested, aim = _association(spark, folder, "leaky", "quality")
        metrics = settle(association.target_association(df, tested, aim)).withColumn("target", F.lit("quality"))
        copy = (F.col("n_pairs") >= 10) & (F.col("exact") | (F.col("spearman") >= 0.999))
        coded = metrics.withColumns({"code": leakage.leakage_class(), "copy": copy})
        return coded.filter(f"code IS NOT NULL AND {condition}").select("column", "code")


_leak_query("target_copies", "E12", "copy")
_leak_query("perfect_predictors", "E13", "NOT copy AND code <> 'TARGET_LEAKAGE_SUSPICIOUS_NAME'")
_leak_query("suspicious_names_with_signal", "E14", "code = 'TARGET_LEAKAGE_SUSPICIOUS_NAME'")


@register(
    "id_features", "E15",
    O.profile_ctes(["events"]) + "\nSELECT column_name AS \"column\", cardinality_ratio FROM p WHERE id_like AND cardinality_ratio >= 0.95 AND column_name <> 'event_type'",
)
def _(spark, folder):
    rows = settle(prof(spark, folder, "events")).withColumn("target", F.lit("event_type"))
    return leakage.id_feature_findings(rows).select(
        "column", F.get_json_object("metrics_json", "$.cardinality_ratio").cast("double").alias("cardinality_ratio")
    )


@register(
    "split_leaks", "E16",
    f"WITH src AS ({sql_of('copies')}) SELECT 'DUPLICATES_SPLIT_LEAK' AS code, n - d AS dup_count FROM (SELECT (SELECT count(*) FROM src) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS d) WHERE n > d",
)
def _(spark, folder):
    counts = settle(duplicates.duplicate_counts(frame(spark, folder, "copies")))
    rows = counts.withColumns({"run_id": F.lit("copies"), "target": F.lit("l_returnflag")})
    return leakage.split_leak_findings(rows).select(
        "code", F.get_json_object("metrics_json", "$.dup_count").cast("bigint").alias("dup_count")
    )


@register(
    "suspicious_names", "E17",
    O.profile_ctes(["leaky", "embeddings"]) + f'\nSELECT run_id, column_name AS "column" FROM p WHERE {O.like("column_name", S.LEAKAGE_NAME)}',
)
def _(spark, folder):
    both = profiles_of(spark, folder, ["leaky", "embeddings"])
    rows = both.withColumn("target", F.lit(None).cast("string"))
    return leakage.suspicious_name_findings(rows).select("run_id", "column")


# --- feature quality and correlation --------------------------------------------

_FEATURE_RUNS = {"part_text": None}


def _feature_query(key: str, item: str, code: str, runs: dict[str, str | None] = _FEATURE_RUNS):
    rule = next(r for r in O.feature_rules() if r[0] == code)

    @register(
        key, item,
        O.profile_ctes(list(runs)) + ",\n" + O.meta_ctes(runs) + f",\nfr AS ({O.FEATURE_ROWS})\n"
        f'SELECT run_id, column_name AS "column", {rule[1]} AS severity, \'{rule[2]}\' AS category FROM fr WHERE {rule[3]}',
    )
    def _(spark, folder):
        about = _about(spark, folder, runs)[0]
        return features.feature_findings(about).filter(F.col("code") == code).select("run_id", "column", "severity", "category")


def _about(spark, folder, runs: dict[str, str | None]) -> tuple[DataFrame, DataFrame]:
    """Settled profiles of several runs with the facts of their run, and the run facts."""
    profiles = profiles_of(spark, folder, runs)
    targets = spark.createDataFrame(list(runs.items()), "run_id string, target string")
    meta = settle(readiness.with_features(context.dataset_types(profiles, targets)))
    facts = meta.select("run_id", "target", "target_provided", "dataset_type")
    joined = profiles.join(F.broadcast(facts), "run_id")  # one row per run
    return settle(context.column_roles(joined, F.col("target"))), meta


_feature_query("constant_findings", "E18", "CONSTANT_COLUMN")
_feature_query("quasi_constant_findings", "E19", "QUASI_CONSTANT_COLUMN")
_feature_query("high_cardinality_findings", "E20", "HIGH_CARDINALITY_CATEGORICAL", {"customer": None, "part_text": None, "archive": None})
_feature_query("numbers_as_text", "E21", "NUMERIC_STORED_AS_STRING")
_feature_query("messy_numeric_text", "E22", "MESSY_NUMERIC_TEXT")
_feature_query("mixed_type_columns", "E23", "MIXED_TYPE_COLUMN")

_REDUNDANT = ["l_quantity", "l_extendedprice", "net", "l_discount", "l_tax", "double_quantity"]


def _pairs(spark, folder, settings=S.DEFAULTS) -> DataFrame:
    return correlation.pair_correlations(
        frame(spark, folder, "redundant"), {c: col(c) for c in _REDUNDANT}, set(_REDUNDANT), settings
    )


@register(
    "near_duplicate_columns", "E24",
    O.pair_sql("redundant", _REDUNDANT) + ' SELECT column_name AS "column", column2, round(abs(r), 6) AS corr FROM pr WHERE abs(r) >= 0.99',
)
def _(spark, folder):
    rows = settle(_pairs(spark, folder)).withColumns({"run_id": F.lit("redundant"), "target": F.lit(None).cast("string")})
    return features.near_duplicate_findings(rows).join(
        rows.select("column", "column2", F.round(F.abs("r"), 6).alias("corr")), ["column", "column2"]
    ).select("column", "column2", "corr")


def _matrix_sql() -> str:
    own = " UNION ALL ".join(f"SELECT '{c}', '{c}', CASE WHEN min({c}) < max({c}) THEN 1.0 ELSE 0.0 END::DOUBLE FROM src" for c in _REDUNDANT)
    cell = "round(coalesce(r, 0), 3)"
    return (O.pair_sql("redundant", _REDUNDANT) + f''' SELECT column_name AS "column", column2, {cell} AS r FROM pr
 UNION ALL SELECT column2, column_name, {cell} FROM pr UNION ALL {own}''')


_MATRIX_SQL = _matrix_sql()


@register("correlation_matrix", "E25", _MATRIX_SQL)
def _(spark, folder):
    return correlation.correlation_matrix(settle(_pairs(spark, folder)), _REDUNDANT)


@register("correlation_matrix_by_products", "E25", _MATRIX_SQL)
def _(spark, folder):
    wide = S.Settings(pairs_by_aggregate=0)
    return correlation.correlation_matrix(settle(_pairs(spark, folder, wide)), _REDUNDANT)


@register(
    "strong_pairs", "E26",
    O.pair_sql("redundant", _REDUNDANT) + """ SELECT column_name AS "column", column2, CASE WHEN a >= 0.99 THEN 'medium' ELSE 'info' END AS severity, round(a, 3) AS corr
 FROM (SELECT *, abs(round(coalesce(r, 0), 3)) AS a FROM pr) WHERE a >= 0.9""",
)
def _(spark, folder):
    rows = settle(_pairs(spark, folder)).withColumns(
        {"run_id": F.lit("redundant"), "dataset_type": F.lit("unknown"), "target_provided": F.lit(False)}
    )
    return correlation.strong_pair_findings(rows).select(
        "column", "column2", "severity", F.get_json_object("metrics_json", "$.corr").cast("double").alias("corr")
    )


# --- readiness ------------------------------------------------------------------

_READY = {"nation": None, "labelled": "quality", "region": "r_name", "archive": None, "lineitem": "l_returnflag"}


def _readiness_query(key: str, item: str, code: str, runs: dict[str, str | None], make: Callable[[DataFrame, DataFrame], DataFrame]):
    @register(
        key, item,
        O.ledger_ctes(runs) + f"\nSELECT run_id, column_name AS \"column\", severity, pen AS readiness_penalty, rcap AS readiness_cap, purpose AS dataset_purpose, purpose_cap AS dataset_purpose_cap FROM f WHERE code = '{code}'",
    )
    def _(spark, folder):
        about, meta = _about(spark, folder, runs)
        guesses = context.possible_targets(about, meta)
        found = findings.number_findings(spark, [make(about, settle(meta.join(guesses, "run_id")))])
        return found.filter(F.col("code") == code).select(
            "run_id", "column", "severity", "readiness_penalty", "readiness_cap", "dataset_purpose", "dataset_purpose_cap"
        )


_readiness_query("no_target_notes", "E27", "NO_TARGET_SUPERVISED_READINESS_NA", _READY, lambda a, m: readiness.sample_size_rules(m))
_readiness_query("small_samples", "E28", "SMALL_SAMPLE_SIZE", _READY, lambda a, m: readiness.sample_size_rules(m))
_readiness_query("rows_per_feature", "E29", "LOW_ROWS_PER_FEATURE", _READY, lambda a, m: readiness.sample_size_rules(m))
_readiness_query(
    "near_unique_features", "E30", "HIGH_CARDINALITY_GENERALIZATION", {"customer": None, "nation": None, "labelled": "quality"},
    lambda a, m: readiness.generalization_findings(a),
)
_readiness_query(
    "near_unique_cluster", "E31", "NEAR_UNIQUE_FEATURE_CLUSTER", {"archive": None, "nation": None},
    lambda a, m: readiness.near_unique_cluster_findings(settle(readiness.near_unique_clusters(a))),
)


def _support(spark, folder, about: DataFrame, runs: dict[str, str | None]) -> DataFrame:
    """Class sizes of the targets of several runs, with what the rules need."""
    parts = [
        imbalance.class_summary(frame(spark, folder, r), t).withColumn("run_id", F.lit(r)) for r, t in runs.items() if t
    ]
    goals = about.filter(F.col("column") == F.col("target")).select("run_id", "target", "dtype_inferred", "n_unique", "n_rows")
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(goals), "run_id")  # one row per run


_WEAK = {"many_classes": "result", "part": "p_name", "labelled": "quality"}


def _support_query(key: str, item: str, code: str, condition: str):
    lows = " UNION ALL ".join(
        f"SELECT '{r}' AS run_id, (SELECT min(n) FROM (SELECT count(*) AS n FROM ({sql_of(r)}) WHERE {t} IS NOT NULL GROUP BY {t})) AS low, "
        f"(SELECT median(n) FROM (SELECT count(*) AS n FROM ({sql_of(r)}) WHERE {t} IS NOT NULL GROUP BY {t}))::DOUBLE AS med"
        for r, t in _WEAK.items()
    )
    picks = " OR ".join(f"(run_id = '{r}' AND column_name = '{t}')" for r, t in _WEAK.items())

    @register(
        key, item,
        O.profile_ctes(list(_WEAK)) + f""", lows AS ({lows})
SELECT run_id, n_unique AS n_classes, low AS min_class_count, med AS median_class_count FROM p JOIN lows USING (run_id)
WHERE ({picks}) AND (dtype IN ('categorical', 'boolean', 'id') OR (dtype = 'numeric' AND n_unique <= 20)) AND n_unique >= 2 AND {condition}""",
    )
    def _(spark, folder):
        about, _ = _about(spark, folder, _WEAK)
        classes = settle(_support(spark, folder, about, _WEAK))
        found = readiness.target_support_findings(classes).filter(F.col("code") == code).select("run_id")
        return classes.join(found, "run_id").select(
            "run_id", F.col("n_unique").alias("n_classes"), "min_class_count", "median_class_count"
        )


_support_query("weak_target_support", "E32", "WEAK_CLASSIFICATION_TARGET_SUPPORT", "low < 5")
_support_query("too_many_classes", "E33", "TOO_MANY_TARGET_CLASSES", "n_unique > n_rows / 10.0")


@register(
    "post_outcome_columns", "E34",
    O.profile_ctes(["late"]) + f"""
SELECT string_agg(column_name, ',' ORDER BY ordinal) AS columns, count(*) AS n_columns FROM p
WHERE {O.like("'result'", S.OUTCOME_TARGET_NAME)} AND column_name <> 'result' AND {O.like('column_name', S.POST_OUTCOME_NAME)}
AND NOT ({O.like('column_name', S.GENERIC_TOTAL_NAME)} AND {O.like("'result'", S.TOTAL_EXEMPT_TARGET)})""",
)
def _(spark, folder):
    about, _ = _about(spark, folder, {"late": "result"})
    return readiness.post_outcome_columns(about).select(
        F.array_join("columns", ",").alias("columns"), F.size("columns").cast("bigint").alias("n_columns")
    )


# --- scores over several whole tables -------------------------------------------


def ledger(spark: SparkSession, folder: str, runs: dict[str, str | None] = _LEDGER_RUNS, about: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered findings and run facts of several tables: gaps, copies, features, readiness."""
    about, meta = about or _about(spark, folder, runs)
    meta = settle(meta.join(context.possible_targets(about, meta), "run_id"))
    copies = settle(
        reduce(
            DataFrame.unionByName,
            [duplicates.duplicate_counts(frame(spark, folder, r)).withColumn("run_id", F.lit(r)) for r in runs],
        )
    )
    weak = settle(_support(spark, folder, about, runs)).filter(readiness.weak_target()).select("run_id", F.lit(True).alias("weak_target"))
    crowd = readiness.near_unique(about).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_near_unique"))
    facts = settle(
        meta.join(weak, "run_id", "left").join(crowd, "run_id", "left").withColumns(
            {
                "weak_target": F.coalesce("weak_target", F.lit(False)),
                "n_near_unique": F.coalesce("n_near_unique", F.lit(0)),
                "late_columns": F.lit(0),
            }
        )
    )
    parts = [
        missingness.missing_value_findings(about),
        duplicates.duplicate_findings(copies),
        features.feature_findings(about),
        readiness.sample_size_rules(meta),
        readiness.generalization_findings(about),
        readiness.near_unique_cluster_findings(settle(readiness.near_unique_clusters(about))),
        readiness.purpose_findings(facts),
    ]
    numbered = settle(findings.number_findings(spark, parts))
    described = meta.select(
        "run_id", F.col("run_id").alias("dataset_name"), "n_rows", F.col("n_rows").alias("n_rows_analyzed"), "n_cols",
        F.lit(False).alias("sampled"), "target", "target_provided", "possible_targets", "dataset_type",
    )
    return numbered, described


@register(
    "dataset_purpose_labels", "E35",
    O.ledger_ctes(_LEDGER_RUNS) + "\nSELECT run_id, severity, purpose AS dataset_purpose, ocap AS overall_cap FROM f WHERE code = 'DATASET_PURPOSE_CLASSIFICATION'",
)
def _(spark, folder):
    numbered, _ = ledger(spark, folder)
    return numbered.filter("code = 'DATASET_PURPOSE_CLASSIFICATION'").select("run_id", "severity", "dataset_purpose", "overall_cap")


@register("fingerprints", "P15", O.ledger_ctes(_LEDGER_RUNS) + _FINGERPRINT)
def _(spark, folder):
    about = _about(spark, folder, _LEDGER_RUNS)  # the profiles, counted once for findings and types
    return P.fingerprint(about[0], ledger(spark, folder, about=about)[0])


def _ledger_query(key: str, item: str, sql: str, make: Callable[[DataFrame, DataFrame], DataFrame]):
    @register(key, item, O.scoring_ctes(_LEDGER_RUNS) + "\n" + sql)
    def _(spark, folder):
        return make(*ledger(spark, folder))


def _scored(f: DataFrame, m: DataFrame) -> DataFrame:
    return scoring.judge(settle(m.join(scoring.tally(scoring.penalties(f)), "run_id", "left")), m.columns)


_ledger_query(
    "severity_weights", "Y1", 'SELECT run_id, seq, code, sw AS weight FROM w',
    lambda f, m: f.select("run_id", "seq", "code", scoring.severity_weight().alias("weight")),
)
_ledger_query(
    "finding_weights", "Y2-Y3", "SELECT run_id, seq, cat AS category, iw AS integrity_weight, rw AS readiness_weight FROM w",
    lambda f, m: scoring.penalties(f).select(
        "run_id", "seq", "category", F.col("iw").alias("integrity_weight"), F.col("rw").alias("readiness_weight")
    ),
)
_ledger_query(
    "capped_penalties", "Y4", "SELECT run_id, seq, code, round(ic, 2)::DOUBLE AS integrity_penalty, round(rc, 2)::DOUBLE AS readiness_penalty FROM c",
    lambda f, m: scoring.penalties(f).select(
        "run_id", "seq", "code", "integrity_penalty", F.col("readiness_penalty_applied").alias("readiness_penalty")
    ),
)
_ledger_query(
    "integrity_and_readiness", "Y5", "SELECT run_id, integrity::DOUBLE AS integrity_score, readiness::DOUBLE AS readiness_score FROM s",
    lambda f, m: _scored(f, m).select("run_id", "integrity_score", "readiness_score"),
)
_ledger_query(
    "overall_scores", "Y6", "SELECT run_id, overall AS overall_score FROM s",
    lambda f, m: _scored(f, m).select("run_id", "overall_score"),
)
_ledger_query(
    "grades", "Y7",
    f"SELECT run_id, {O.GRADE.format('integrity')} AS integrity_grade, {O.GRADE.format('readiness')} AS readiness_grade, {O.OVERALL_GRADE.format('overall')} AS overall_grade FROM s",
    lambda f, m: _scored(f, m).select("run_id", "integrity_grade", "readiness_grade", "overall_grade"),
)
_ledger_query(
    "purposes", "Y8", "SELECT run_id, purpose AS dataset_purpose FROM s",
    lambda f, m: _scored(f, m).select("run_id", "dataset_purpose"),
)
_ledger_query(
    "verdicts", "Y9", "SELECT run_id, verdict FROM z", lambda f, m: _scored(f, m).select("run_id", "verdict"),
)
_ledger_query(
    "confidences", "Y10", "SELECT run_id, iconf AS integrity_confidence, rconf AS readiness_confidence, oconf AS overall_confidence FROM z",
    lambda f, m: _scored(f, m).select("run_id", "integrity_confidence", "readiness_confidence", "overall_confidence"),
)
_ledger_query(
    "severity_counts", "Y11",
    "SELECT run_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in S.SEVERITY_RANK) + " FROM f GROUP BY run_id",
    lambda f, m: scoring.severity_counts(f),
)
_ledger_query(
    "finding_sections", "R5",
    """SELECT run_id, section, (row_number() OVER (PARTITION BY run_id, section ORDER BY sev_rank, seq))::INT AS position, code FROM (SELECT *,
 CASE WHEN severity = 'info' THEN 'info' WHEN cat = 'modeling_warning' THEN 'modeling' ELSE 'integrity' END AS section FROM c)""",
    lambda f, m: views.finding_groups(scoring.penalties(f)).select("run_id", "section", "position", "code"),
)
_ledger_query(
    "top_findings", "R6",
    'SELECT run_id, position, code, column_name AS "column" FROM (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY sev_rank, seq))::INT AS position FROM f) WHERE position <= 15',
    lambda f, m: views.top_findings(f).select("run_id", "position", "code", "column"),
)
_ledger_query(
    "recommended_actions", "R8",
    """SELECT run_id, position, code FROM (SELECT *, (row_number() OVER (PARTITION BY run_id ORDER BY sev_rank, seq))::INT AS position FROM f WHERE severity <> 'info') WHERE position <= 5
 UNION ALL SELECT run_id, 1, NULL FROM meta WHERE run_id NOT IN (SELECT run_id FROM f WHERE severity <> 'info')""",
    lambda f, m: views.recommendations(f, m).join(
        f.withColumn(
            "position",
            F.when(F.col("severity") != "info", F.row_number().over(_reading_order())),
        ).select("run_id", "position", "code"),
        ["run_id", "position"], "left",
    ).select("run_id", "position", "code"),
)


def _reading_order():
    from pyspark.sql import Window

    return Window.partitionBy("run_id", F.col("severity") == "info").orderBy("severity_rank", "seq")


@register("executive_summaries", "R7")
def _(spark, folder):
    numbered, meta = ledger(spark, folder)
    return narrative.executive_summary(settle(_scored(numbered, meta)), numbered)


# --- views ----------------------------------------------------------------------


@register(
    "missingness_view", "R1",
    O.profile_ctes(["clustered"]) + """
SELECT run_id, (row_number() OVER (ORDER BY null_rate DESC, ordinal))::INT AS position, column_name AS "column", round(null_rate * 100, 2) AS missing_percent FROM p WHERE null_rate > 0
ORDER BY position LIMIT 15""",
)
def _(spark, folder):
    return views.missingness_view(prof(spark, folder, "clustered"))


@register(
    "outlier_view", "R2",
    O.outlier_sql("tailed", _TAILED) + ' SELECT (row_number() OVER (ORDER BY round(n_outliers::DOUBLE / n, 4) DESC))::INT AS position, column_name AS "column", round(round(n_outliers::DOUBLE / n, 4) * 100, 2) AS outlier_percent FROM o ORDER BY position LIMIT 15',
)
def _(spark, folder):
    metrics = settle(outliers.outlier_metrics(frame(spark, folder, "tailed"), {c: col(c) for c in _TAILED}))
    rows = metrics.withColumns({"run_id": F.lit("tailed"), "ordinal": F.lit(0)})
    return views.outlier_view(rows).select("position", "column", "outlier_percent")


@register(
    "class_view", "R3",
    "SELECT l_returnflag AS class, round(round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 4) * 100, 2) AS percent FROM lineitem GROUP BY 1",
)
def _(spark, folder):
    return views.class_view(imbalance.class_proportions(table(spark, folder, "lineitem"), "l_returnflag"))


@register("heatmap_view", "R4", _MATRIX_SQL)
def _(spark, folder):
    """Every column against every other, itself included."""
    return correlation.correlation_matrix(settle(_pairs(spark, folder)), _REDUNDANT)


# --- usage ----------------------------------------------------------------------

# the event stream as a usage log
_USAGE_SQL = (
    "SELECT CASE event_type WHEN 'view' THEN 'page_view' WHEN 'purchase' THEN 'analysis_completed' ELSE event_type END AS event, "
    "CAST(event_id AS VARCHAR(20)) AS eventId, CAST(ts AS VARCHAR(30)) AS occurredAt, "
    "CASE WHEN user_id % 50 = 0 THEN 'anonymous' ELSE concat('v', CAST(user_id AS VARCHAR(20))) END AS anonymousUserId, "
    "CASE WHEN user_id % 3 = 0 THEN 'demo' ELSE 'upload' END AS source FROM events"
)


def usage_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(_USAGE_SQL.replace("FROM events", "FROM {events}"), events=table(spark, folder, "events"))


@register("usage_log_roundtrip", "S5-S6", f"SELECT event, source, count(*) AS n FROM ({_USAGE_SQL}) GROUP BY ALL")
def _(spark, folder):
    path = f"{checkpoint_folder(spark)}/usage-{uuid.uuid4().hex}"
    usage_log.write_usage(usage_events(spark, folder), path)
    return usage_log.read_usage(spark, path).groupBy("event", "source").agg(F.count(F.lit(1)).alias("n"))


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has put out once all its input is read: every batch's result is written, the last one is read."""
    path = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _appended(spark: SparkSession, stream: DataFrame, arrivals: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """All that a stream has put out once its input, and then that of each of ``arrivals``, is read; the file sink takes each batch once."""
    path = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    for arrive in (lambda: None, *arrivals):
        arrive()
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_folder(spark)}/usage-{uuid.uuid4().hex}"
    usage_log.write_usage(usage_events(spark, folder).repartition(3, "eventId"), path)
    return usage_log.read_usage_stream(spark, path, files_per_trigger=1)


@register("usage_stream_roundtrip", "S5-S6", f"SELECT event, source, count(*) AS n FROM ({_USAGE_SQL}) GROUP BY ALL")
def _(spark, folder):
    """The log read as a stream and appended to a second log."""
    path = f"{checkpoint_folder(spark)}/usage-{uuid.uuid4().hex}"
    usage_log.write_usage_stream(_usage_stream(spark, folder), f"{path}/log", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return usage_log.read_usage(spark, f"{path}/log").groupBy("event", "source").agg(F.count(F.lit(1)).alias("n"))


_KNOWN = "anonymousUserId <> 'anonymous'"
_TOTALS = f"""SELECT count(DISTINCT anonymousUserId) FILTER (WHERE {_KNOWN}) AS uniqueVisitors,
 count(DISTINCT anonymousUserId) FILTER (WHERE {_KNOWN} AND event = 'analysis_completed') AS uniqueUsers,
 count(*) FILTER (WHERE event = 'page_view') AS pageViews, count(*) FILTER (WHERE event = 'analysis_completed') AS submissions FROM ({_USAGE_SQL})"""


@register("usage_totals_stream", "U1", f'SELECT "pageViews", submissions, true AS near FROM ({_TOTALS})')
def _(spark, folder):
    """Running totals over three micro-batches; ``near``: the sketched uniques are within five percent of the log's."""
    out = _drained(spark, stream_usage.streaming_totals(_usage_stream(spark, folder)), "complete")
    exact = usage.usage_totals(usage_events(spark, folder)).first()
    near = (F.abs(F.col("uniqueVisitors") - exact["uniqueVisitors"]) <= 0.05 * exact["uniqueVisitors"]) & (F.abs(F.col("uniqueUsers") - exact["uniqueUsers"]) <= 0.05 * exact["uniqueUsers"])
    return out.select("pageViews", "submissions", near.alias("near"))


@register(
    "over_limit_stream", "U6",
    f"""SELECT client, start, count(*) AS attempts FROM (SELECT "anonymousUserId" AS client, (floor(epoch(CAST("occurredAt" AS TIMESTAMP)) / 600)::BIGINT - k) * 600 AS start
 FROM ({_USAGE_SQL}), (SELECT unnest(range(0, 6)) AS k)) GROUP BY ALL HAVING count(*) > 2""",
)
def _(spark, folder):
    events = stream_usage.with_event_time(_usage_stream(spark, folder), F.to_timestamp("occurredAt"), "60 days")
    out = _drained(spark, stream_usage.streaming_over_limit(events, F.col("anonymousUserId"), limit=2), "complete")
    return out.select("client", F.col("start").cast("timestamp").cast("bigint").alias("start"), "attempts")


_TRAILING = """SELECT client, second, attempts, CAST("trailing" AS BIGINT) AS "trailing", "trailing" > 2 AS over_limit FROM (
 SELECT client, second, attempts, sum(attempts) OVER (PARTITION BY client ORDER BY second RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS "trailing" FROM (
 SELECT user_id AS client, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS attempts FROM events GROUP BY 1, 2))"""


def _keyed_state(spark: SparkSession):
    """The state store that maps and timers need, for the streams run inside."""
    return held(spark, *stream_usage.STATE_STORE)


@register("usage_uniques_stream", "U1", _TOTALS)
def _(spark, folder):
    """Exact totals of a stream: what three micro-batches with returning visitors add, summed up."""
    with _keyed_state(spark):
        out = _appended(spark, stream_usage.streaming_uniques(_usage_stream(spark, folder)))
    return out.agg(*[F.sum(c).alias(c) for c in ("uniqueVisitors", "uniqueUsers", "pageViews", "submissions")])


def _disordered_stream(spark: SparkSession, folder: str, steps: int = 4, disorder: int = 7200) -> tuple[DataFrame, list[Callable[[], None]]]:
    """``events`` arriving in time slices, each event up to ``disorder`` seconds late, and last a far later one that lets every watermark pass.

    The first slice is there; the others arrive by the calls returned. A slice is one micro-batch whatever its number of files: in two, what
    comes first could let the watermark pass the rest."""
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    second = F.unix_seconds("ts")
    arrives = second + F.pmod(F.xxhash64("user_id", "ts"), F.lit(disorder))
    first, last = events.agg(F.min(second), F.max(second)).first()
    path = f"{checkpoint_folder(spark)}/late-{uuid.uuid4().hex}"
    span = ((last or 0) - (first or 0) + disorder) // steps + 1
    slices = events.withColumn("step", F.floor((arrives - (first or 0)) / span))
    end = spark.createDataFrame([((last or 0) + 10 ** 8,)], "s bigint").select(F.lit(None).cast("bigint").alias("user_id"), F.timestamp_seconds("s").alias("ts"))

    def arrival(rows: DataFrame) -> Callable[[], None]:
        return lambda: rows.write.mode("append").parquet(path)

    now, *later = [arrival(rows) for rows in (*[slices.where(F.col("step") == step).drop("step") for step in range(steps)], end)]
    now()
    return spark.readStream.schema("user_id bigint, ts timestamp").parquet(path), later


@register("over_limit_stream_exact", "U6", _TRAILING)
def _(spark, folder):
    """The trailing hour of every attempt on a stream out of order: row by row what the batch gives."""
    with _keyed_state(spark):
        arriving, later = _disordered_stream(spark, folder)
        events = stream_usage.with_event_time(arriving, F.col("ts"), "7200 seconds")
        return _appended(spark, stream_usage.streaming_over_limit_exact(events, F.col("user_id"), limit=2), later)


@register("usage_totals", "U1", _TOTALS)
def _(spark, folder):
    return usage.usage_totals(usage_events(spark, folder))


@register(
    "public_numbers", "U2",
    f"SELECT CAST(greatest(5, ceil(uniqueUsers / 5.0) * 5) AS BIGINT) AS trustedUsers, CAST(greatest(10, ceil(submissions / 5.0) * 5) AS BIGINT) AS totalUses FROM ({_TOTALS})",
)
def _(spark, folder):
    return usage.public_numbers(usage.usage_totals(usage_events(spark, folder)))


@register("usage_by_source", "U3", f"SELECT source, count(*) AS analyses FROM ({_USAGE_SQL}) WHERE event = 'analysis_completed' GROUP BY source")
def _(spark, folder):
    return usage.usage_by_source(usage_events(spark, folder))


@register(
    "anonymized_events", "U4",
    """SELECT event_id, substr(CASE WHEN props = '' THEN '/' ELSE props END, 1, 240) AS path, substr(trim('  u' || CAST(user_id AS VARCHAR) || ' '), 1, 128) AS anonymousUserId,
 CAST(NULL AS VARCHAR) AS sessionId, substr(sha256('10.0.0.' || CAST(user_id % 256 AS VARCHAR)), 1, 24) AS ipHash, substr(sha256(event_type), 1, 24) AS userAgentHash,
 'csv' AS fileExtension FROM events""",
)
def _(spark, folder):
    raw = table(spark, folder, "events").select(
        "event_id",
        F.col("props").alias("path"),
        F.concat(F.lit("  u"), F.col("user_id").cast("string"), F.lit(" ")).alias("visitor"),
        F.lit("   ").alias("session"),
        F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" , 192.168.0.1")).alias("ip"),
        F.concat(F.lit(" "), F.col("event_type")).alias("user_agent"),
        F.concat(F.lit("in.d/"), F.col("event_type"), F.lit(".CSV")).alias("file_name"),
    )
    return usage_log.anonymize(raw)


@register(
    "file_extensions", "U5",
    """SELECT CASE WHEN ext = '' THEN 'unknown' ELSE lower(ext) END AS extension, count(*) AS n FROM
 (SELECT regexp_extract(list_last(string_split(url, '/')), '^.+\\.([^.]+)$', 1) AS ext FROM pages) GROUP BY 1""",
)
def _(spark, folder):
    return table(spark, folder, "pages").groupBy(usage_log.file_extension(F.col("url")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "over_limit_attempts", "U6",
    _TRAILING,
)
def _(spark, folder):
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return usage.over_limit(table(spark, folder, "events"), F.col("user_id"), second, limit=2)


# --- repairs --------------------------------------------------------------------


@register("drop_columns", "F1", f"SELECT * EXCLUDE (text, source) FROM ({sql_of('labelled')})")
def _(spark, folder):
    return repair.drop_columns(frame(spark, folder, "labelled"), ["text", "source"])


@register(
    "fill_median", "F2",
    f"""WITH src AS ({sql_of('clustered')}), m AS (SELECT median(labelled_chars) AS a, median(quality) AS b FROM src)
SELECT doc_id, coalesce(labelled_chars, a)::DOUBLE AS labelled_chars, coalesce(quality, b)::DOUBLE AS quality FROM src, m""",
)
def _(spark, folder):
    out = repair.fill_median(frame(spark, folder, "clustered"), ["labelled_chars", "quality"])
    return out.select("doc_id", F.col("labelled_chars").cast("double").alias("labelled_chars"), F.col("quality").cast("double").alias("quality"))


_BIG = "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 9007199254740993 + d.doc_id END AS big FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@register("fill_median_of_big_integers", "F2", f"SELECT doc_id, CAST(big AS VARCHAR) AS kept, big IS NULL AS filled FROM ({_BIG})")
def _(spark, folder):
    df = spark.sql(_BIG.replace("documents d", "{documents} d").replace("labels l", "{labels} l"),
                   documents=table(spark, folder, "documents"), labels=table(spark, folder, "labels"))
    out = repair.fill_median(df.withColumn("was", F.col("big")), ["big"])
    same = F.when(F.col("was").isNotNull(), F.col("big").cast("decimal(38, 0)").cast("string"))
    return out.select("doc_id", same.alias("kept"), (F.col("was").isNull() & F.col("big").isNotNull()).alias("filled"))


@register(
    "fill_constant", "F3",
    f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'Unknown') AS quality FROM ({sql_of('clustered')})",
)
def _(spark, folder):
    return repair.fill_constant(frame(spark, folder, "clustered"), ["quality"]).select("doc_id", "quality")


@register(
    "missing_flags", "F4",
    f"SELECT doc_id, quality, (quality IS NULL)::INT AS quality_missing, (toxic IS NULL)::INT AS toxic_missing FROM ({sql_of('clustered')})",
)
def _(spark, folder):
    return repair.add_missing_flags(frame(spark, folder, "clustered"), ["quality", "toxic"]).select(
        "doc_id", "quality", "quality_missing", "toxic_missing"
    )


_HALF_PRICED = "SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders"


@register(
    "fill_median_by_year", "F5",
    f"""WITH src AS ({_HALF_PRICED}), m AS (SELECT year(o_orderdate) AS y, median(price) AS med FROM src GROUP BY 1)
SELECT o_orderkey, round(coalesce(price, med), 6) AS price FROM src LEFT JOIN m ON year(o_orderdate) = y""",
)
def _(spark, folder):
    df = spark.sql(_HALF_PRICED.replace("FROM orders", "FROM {orders}"), orders=table(spark, folder, "orders"))
    return repair.fill_median_by(df, "price", F.year("o_orderdate")).select("o_orderkey", *_r6("price"))


@register("drop_duplicates", "F6", f"SELECT DISTINCT * FROM ({sql_of('copies')})")
def _(spark, folder):
    return repair.drop_duplicate_rows(frame(spark, folder, "copies"))


@register(
    "majority_labels", "F7",
    """SELECT id, label, n FROM (SELECT l_orderkey AS id, l_returnflag AS label, count(*) AS n,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1""",
)
def _(spark, folder):
    return repair.majority_label(table(spark, folder, "lineitem"), "l_orderkey", "l_returnflag")


@register(
    "stratified_split_counts", "F8",
    """SELECT o_orderpriority, split, n FROM (SELECT o_orderpriority, CAST(round(0.2 * count(*)) AS BIGINT) AS t, count(*) AS c FROM orders GROUP BY 1),
 LATERAL (SELECT 'test' AS split, t AS n UNION ALL SELECT 'train', c - t)""",
)
def _(spark, folder):
    out = repair.stratified_split(table(spark, folder, "orders"), "o_orderpriority", ["o_orderkey"])
    return out.groupBy("o_orderpriority", "split").agg(F.count(F.lit(1)).alias("n"))


@register(
    "class_weights", "F9",
    """SELECT o_orderkey, round((SELECT count(*) FROM orders)::DOUBLE / ((SELECT count(DISTINCT o_orderstatus) FROM orders) * n), 6) AS weight
 FROM orders JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) USING (o_orderstatus)""",
)
def _(spark, folder):
    return repair.class_weights(table(spark, folder, "orders"), "o_orderstatus").select("o_orderkey", *_r6("weight"))


@register(
    "group_split_keys", "F10",
    "SELECT count(DISTINCT l_orderkey) AS orders_seen, 0::BIGINT AS orders_on_both_sides FROM lineitem",
)
def _(spark, folder):
    out = repair.group_split(table(spark, folder, "lineitem"), ["l_orderkey"])
    sides = out.groupBy("l_orderkey").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return sides.agg(
        F.count(F.lit(1)).alias("orders_seen"), F.count_if(F.col("a") != F.col("b")).alias("orders_on_both_sides")
    )


@register("log_clipped", "F11", "SELECT event_id, round(ln(1 + greatest(value, 0)), 6) AS value FROM events")
def _(spark, folder):
    return repair.log_clip(table(spark, folder, "events"), ["value"]).select("event_id", *_r6("value"))


@register(
    "winsorized", "F12",
    """WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, b""",
)
def _(spark, folder):
    return repair.winsorize(table(spark, folder, "events"), ["value"]).select("event_id", *_r6("value"))


@register(
    "robust_scaled", "F12",
    """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS m, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, round((value - m) / (q3 - q1), 6) AS value FROM events, b""",
)
def _(spark, folder):
    return repair.robust_scale(table(spark, folder, "events"), ["value"]).select("event_id", *_r6("value"))


@register(
    "rare_levels_grouped", "F13",
    """WITH top AS (SELECT p_name FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 20)
SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM top) THEN p_name ELSE 'other' END AS p_name FROM part""",
)
def _(spark, folder):
    return repair.group_rare_levels(table(spark, folder, "part"), "p_name").select("p_partkey", "p_name")


@register(
    "rare_classes_merged", "F14",
    """SELECT p_partkey, CASE WHEN n < 25 THEN 'other' ELSE p_name END AS p_name FROM part JOIN (SELECT p_name, count(*) AS n FROM part GROUP BY 1) USING (p_name)""",
)
def _(spark, folder):
    return repair.merge_rare_classes(table(spark, folder, "part"), "p_name", 25).select("p_partkey", "p_name")


@register(
    "text_to_number", "F15",
    f"SELECT p_partkey, CASE WHEN {O.number_test('size_text')} THEN try_cast(size_text AS DOUBLE) END AS size_text, CASE WHEN {O.number_test('mixed')} THEN try_cast(mixed AS DOUBLE) END AS mixed FROM ({sql_of('part_text')})",
)
def _(spark, folder):
    return repair.to_number(frame(spark, folder, "part_text"), ["size_text", "mixed"]).select("p_partkey", "size_text", "mixed")


@register(
    "units_stripped", "F16",
    f"SELECT p_partkey, CASE WHEN {O.number_test(O.cleaned('price_text'))} THEN try_cast({O.cleaned('price_text')} AS DOUBLE) END AS price_text FROM ({sql_of('part_text')})",
)
def _(spark, folder):
    return repair.strip_units(frame(spark, folder, "part_text"), ["price_text"]).select("p_partkey", "price_text")
