"""ANSI SQL for the comparison engine: the same results from the same tables, written independently."""

from __future__ import annotations

from .. import settings as S
from ..functions.text import INFINITY, ISO_DATETIME, NUMBER
from ..operators.value_counts import BOOLEAN_WORDS
from ..plans import context as C
from .tables import columns_of, sql_of


def q(name: str) -> str:
    return '"' + name + '"'


def number_test(v: str) -> str:
    return f"(regexp_matches({v}, '{NUMBER}') OR regexp_matches({v}, '{INFINITY}'))"


def cleaned(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9.\\-]+', '', 'g')"


def date_test(v: str) -> str:
    return (
        f"(regexp_matches({v}, '{ISO_DATETIME}') AND "
        f"try_cast(replace(trim({v}), '/', '-') AS TIMESTAMP) IS NOT NULL)"
    )


def like(name: str, pattern: str) -> str:
    return f"regexp_matches({name}, '(?i){pattern}')"


def share(condition: str, v: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE {v} IS NOT NULL)"


def raw_profile(source: str, run: str | None = None, tag: str = "src") -> str:
    """One row of plain counts per column."""
    parts = []
    for i, (name, kind) in enumerate(columns_of(source).items()):
        c = q(name)
        head = f"SELECT '{run or source}' AS run_id, {i} AS ordinal, '{name}' AS column_name, '{kind}' AS kind, count(*) AS n_rows, count(*) - count({c}) AS n_null"
        if kind == "nested":
            parts.append(
                head + ", NULL::BIGINT AS n_unique, NULL::BIGINT AS top_count, false AS is_bool, NULL::DOUBLE AS num, "
                f"NULL::DOUBLE AS cln, NULL::DOUBLE AS dat, NULL::DOUBLE AS avg_len FROM {tag}"
            )
            continue
        word = f"lower(trim(CAST({c} AS VARCHAR)))"
        booleans = " OR ".join(
            f"bool_and({word} IN ({', '.join(repr(w) for w in pair)}))" for pair in BOOLEAN_WORDS
        )
        tail = (
            f", count(DISTINCT {c}) AS n_unique, "
            f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {tag} GROUP BY {c})) AS top_count, "
            f"coalesce({booleans}, false) AS is_bool, "
        )
        if kind == "string":
            clean = cleaned(c)
            tail += (
                f"{share(number_test(c), c)} AS num, {share(number_test(clean), c)} AS cln, "
                f"{share(date_test(c), c)} AS dat, avg(length({c})) AS avg_len"
            )
        else:
            tail += "NULL::DOUBLE AS num, NULL::DOUBLE AS cln, NULL::DOUBLE AS dat, NULL::DOUBLE AS avg_len"
        parts.append(head + tail + f" FROM {tag}")
    return " UNION ALL ".join(parts)


def normalized(name: str = "column_name") -> str:
    return f"regexp_replace(regexp_replace(lower(trim({name})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def name_kind(name: str = "column_name") -> str:
    n = normalized(name)
    return (
        f"CASE WHEN {like(n, S.MEASUREMENT_NAME)} THEN 'measurement' "
        f"WHEN {like(n, S.IDENTIFIER_NAME)} THEN 'identifier' ELSE 'unknown' END"
    )


def profile_ctes(sources: list[str], runs: dict[str, str] | None = None) -> str:
    """``WITH`` list ending in ``p``: full profiles of one or more tables, keyed by run_id."""
    runs = runs or {}
    ctes = [f"src_{i} AS ({sql_of(s)})" for i, s in enumerate(sources)]
    raw = " UNION ALL ".join(raw_profile(s, runs.get(s, s), f"src_{i}") for i, s in enumerate(sources))
    ctes.append(f"raw AS ({raw})")
    ctes.append(
        f"""typed AS (SELECT *, {name_kind()} AS name_kind,
 n_unique::DOUBLE / nullif(n_rows, 0) AS ratio,
 CASE WHEN kind = 'nested' THEN 'nested' WHEN n_null = n_rows THEN 'categorical'
  WHEN n_unique <= 2 AND is_bool THEN 'boolean' WHEN kind = 'boolean' THEN 'boolean'
  WHEN kind = 'number' THEN 'numeric' WHEN kind = 'datetime' THEN 'datetime'
  WHEN num >= 0.9 THEN 'numeric' WHEN dat >= 0.9 THEN 'datetime'
  WHEN n_unique::DOUBLE / n_rows >= 0.95 THEN 'id'
  WHEN avg_len > 40 AND n_unique::DOUBLE / n_rows > 0.5 THEN 'text' ELSE 'categorical' END AS structural
 FROM raw)"""
    )
    ctes.append(
        """p AS (SELECT *,
 CASE WHEN id_like THEN 'id' WHEN structural = 'id' THEN 'categorical' ELSE structural END AS dtype,
 (CASE WHEN id_like THEN false WHEN structural IN ('id', 'categorical', 'text') THEN n_unique >= 50 OR ratio >= 0.5 ELSE false END) AS high_card,
 coalesce(n_unique, 2) <= 1 AS constant,
 round(coalesce(n_null::DOUBLE / nullif(n_rows, 0), 0), 4) AS null_rate,
 round(coalesce(ratio, 0), 4) AS cardinality_ratio
 FROM (SELECT *, name_kind = 'identifier' AND coalesce(n_unique, 0) >= 2 AS id_like FROM typed))"""
    )
    return "WITH " + ",\n".join(ctes)


PROFILE_COLUMNS = (
    'run_id, ordinal, column_name AS "column", kind, dtype AS dtype_inferred, name_kind, n_rows, n_null, null_rate, n_unique, '
    "cardinality_ratio, top_count, round(top_count::DOUBLE / n_rows, 6) AS top_share, round(num, 6) AS numeric_parse_rate, "
    "round(cln, 6) AS clean_numeric_parse_rate, round(dat, 6) AS datetime_parse_rate, round(avg_len, 6) AS avg_len, "
    "id_like AS is_id_like, high_card AS is_high_cardinality, constant AS is_constant"
)


def roles(target: str | None) -> str:
    """Column role over ``p``."""
    name = "lower(column_name)"

    def any_of(words: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"

    two = "(dtype = 'boolean' OR (dtype = 'numeric' AND n_unique <= 2))"
    is_target = f"column_name = '{target}'" if target else "false"
    return (
        f"CASE WHEN {is_target} THEN 'target' WHEN name_kind = 'identifier' THEN 'identifier' "
        f"WHEN dtype = 'datetime' OR {any_of(C.TIME_WORDS)} THEN 'timestamp' "
        f"WHEN {two} AND {any_of(C.TARGET_WORDS)} THEN 'target' WHEN {two} THEN 'binary_flag' "
        f"WHEN name_kind = 'measurement' OR dtype = 'numeric' THEN 'measurement' WHEN dtype = 'text' THEN 'text' "
        f"WHEN {any_of(C.DERIVED_WORDS)} THEN 'derived_feature' ELSE 'categorical' END"
    )


def meta_ctes(targets: dict[str, str | None]) -> str:
    """CTEs ``tg, seen, meta`` after ``p``."""
    rows = ", ".join(f"('{r}', {repr(t) if t else 'NULL'})" for r, t in targets.items())

    def has(pattern: str) -> str:
        return f"bool_or({like('lower(column_name)', pattern)})"

    fixture = " + ".join(f"{has(x)}::INT" for x in C.FIXTURE_PATTERNS)
    archive = " + ".join(f"{has(x)}::INT" for x in C.ARCHIVE_PATTERNS)
    return f"""tg(run_id, target) AS (VALUES {rows}),
seen AS (SELECT run_id, count(*) AS n_cols, max(n_rows) AS n_rows, {fixture} AS fixture, {archive} AS archive,
 {has(C.NETWORK_PATTERN)} AS network, {has(C.YEAR_PATTERN)} AS yr, {has(C.DATE_PATTERN)} AS dt,
 {has(C.LOCATION_PATTERN)} AS loc, {has(C.BUSINESS_PATTERN)} AS business, {has(C.ECOMMERCE_PATTERN)} AS shop,
 {has(C.SURVEY_PATTERN)} AS survey,
 count(*) FILTER (WHERE dtype = 'numeric') AS n_numeric,
 count(*) FILTER (WHERE dtype IN ('categorical', 'text', 'boolean')) AS n_categorical,
 count(*) FILTER (WHERE dtype = 'datetime') AS n_datetime, count(*) FILTER (WHERE id_like) AS n_id_like
 FROM p GROUP BY run_id),
meta AS (SELECT seen.*, tg.target, tg.target IS NOT NULL AS given,
 greatest(n_cols - CASE WHEN tg.target IS NOT NULL THEN 1 ELSE 0 END, 1) AS n_features,
 CASE WHEN fixture >= 4 THEN 'fixture_schedule' WHEN archive >= 5 AND n_rows <= 200 THEN 'historical_archive'
  WHEN network THEN 'network_logs' WHEN yr AND loc THEN 'panel_data'
  WHEN dt AND n_numeric::DOUBLE / n_cols >= 0.5 THEN 'time_series' WHEN tg.target IS NOT NULL THEN 'supervised_tabular_ml'
  WHEN business THEN 'business_tabular' WHEN shop THEN 'ecommerce' WHEN survey THEN 'survey_data'
  WHEN n_numeric::DOUBLE / n_cols >= 0.75 THEN 'scientific_measurements' ELSE 'unknown' END AS dataset_type
 FROM seen JOIN tg USING (run_id))"""


# --- pieces of the checks -----------------------------------------------------

FEATURE_ROWS = (
    "SELECT p.*, meta.target, meta.given, meta.dataset_type, "
    "dtype IN ('categorical', 'text') AND high_card AND NOT id_like AS wide, "
    "meta.dataset_type = 'historical_archive' AND NOT given AS archive_run, "
    "kind = 'string' AND dtype <> 'numeric' AND n_rows - n_null >= 20 AS long_text "
    "FROM p JOIN (SELECT run_id, target, given, dataset_type FROM meta) AS meta USING (run_id) WHERE kind <> 'nested' AND (target IS NULL OR column_name <> target) AND null_rate < 0.2"
)


def feature_rules() -> list[tuple[str, str, str, str]]:
    """(code, severity, category, condition) over ``fr``."""
    messy = (
        "(NOT constant AND long_text AND name_kind = 'measurement' AND cln >= 0.5 AND cln > num + 0.2 AND NOT (wide AND archive_run))"
    )
    mixed = f"(NOT constant AND long_text AND NOT {messy} AND num > 0.1 AND num < 0.9 AND NOT (wide AND archive_run))"
    return [
        ("CONSTANT_COLUMN", "'medium'", "data_integrity", "constant"),
        ("QUASI_CONSTANT_COLUMN", "'low'", "data_integrity", "NOT constant AND top_count::DOUBLE / n_rows >= 0.99 AND n_unique > 1"),
        ("HIGH_CARDINALITY_CATEGORICAL", "'low'", "modeling_warning", "NOT constant AND wide AND NOT archive_run"),
        ("NUMERIC_STORED_AS_STRING", "'medium'", "data_integrity", "NOT constant AND dtype = 'numeric' AND kind = 'string'"),
        ("MESSY_NUMERIC_TEXT", "CASE WHEN 1 - cln >= 0.1 THEN 'high' ELSE 'medium' END", "data_integrity", messy),
        ("MIXED_TYPE_COLUMN", "'medium'", "data_integrity", mixed),
    ]


SEVERITY_RANK = "CASE {0} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"


def ledger_ctes(runs: dict[str, str | None]) -> str:
    """``WITH`` list ending in ``f``: numbered findings of whole tables, for the scoring queries.

    Covers gaps, copies, feature quality, sample size, generalisation and purpose.
    """
    sources = list(runs)
    base = profile_ctes(sources) + ",\n" + meta_ctes(runs)
    dups = " UNION ALL ".join(
        f"SELECT '{s}' AS run_id, (SELECT count(*) FROM src_{i}) AS n, "
        f"(SELECT count(*) FROM (SELECT DISTINCT * FROM src_{i})) AS d"
        for i, s in enumerate(sources)
    )
    nothing = "NULL::DOUBLE AS null_rate_m, NULL::DOUBLE AS pen, NULL::DOUBLE AS rcap, NULL::DOUBLE AS ocap, NULL::VARCHAR AS purpose, NULL::VARCHAR AS purpose_cap"
    feature_parts = [
        f"SELECT run_id, 6 AS eng, 'feature_quality' AS engine, '{code}' AS code, {sev} AS severity, '{cat}' AS category, "
        f"column_name, 0 AS block, ordinal AS place, {k} AS place2, {nothing} FROM fr WHERE {cond}"
        for k, (code, sev, cat, cond) in enumerate(feature_rules())
    ]
    weak_by_run = " UNION ALL ".join(
        f"SELECT '{s}' AS run_id, (SELECT min(n) FROM (SELECT count(*) AS n FROM src_{i} WHERE {q(t)} IS NOT NULL GROUP BY {q(t)})) AS low"
        if t else f"SELECT '{s}' AS run_id, NULL::BIGINT AS low"
        for i, (s, t) in enumerate(runs.items())
    )
    parts = [
        "SELECT run_id, 1, 'missingness', 'MISSING_VALUES', CASE WHEN r >= 0.6 THEN 'critical' WHEN r >= 0.2 THEN 'high' ELSE 'medium' END, "
        "'data_integrity', column_name, 1, ordinal, 0, round(r, 4), NULL, NULL, NULL, NULL, NULL FROM "
        "(SELECT *, n_null::DOUBLE / n_rows AS r FROM p) WHERE r >= 0.05",
        "SELECT run_id, 2, 'duplicates', 'EXACT_DUPLICATE_ROWS', CASE WHEN (n - d)::DOUBLE / n >= 0.05 THEN 'high' "
        "WHEN (n - d)::DOUBLE / n >= 0.01 THEN 'medium' ELSE 'low' END, 'data_integrity', NULL, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL "
        "FROM dups WHERE n > d",
        "SELECT run_id, 8, 'model_readiness', 'NO_TARGET_SUPERVISED_READINESS_NA', 'info', 'modeling_warning', NULL, 0, 0, 0, NULL, NULL, NULL, NULL, NULL, NULL "
        "FROM meta WHERE NOT given",
        "SELECT run_id, 8, 'model_readiness', 'SMALL_SAMPLE_SIZE', CASE WHEN n_rows < 30 THEN 'critical' WHEN n_rows < 100 THEN 'high' ELSE 'medium' END, "
        "'modeling_warning', NULL, 1, 0, 0, NULL, CASE WHEN n_rows < 30 THEN 35.0 WHEN n_rows < 100 THEN 25.0 ELSE 12.0 END, "
        "CASE WHEN n_rows < 30 THEN 40.0 END, NULL, NULL, CASE WHEN n_rows < 30 THEN 'Not suitable for supervised ML' WHEN n_rows < 100 "
        "THEN 'Toy ML / demo only' ELSE 'Trainable with caution' END FROM meta WHERE n_rows < 500",
        "SELECT run_id, 8, 'model_readiness', 'LOW_ROWS_PER_FEATURE', CASE WHEN per < 5 THEN 'high' WHEN per < 10 THEN 'medium' ELSE 'low' END, "
        "'modeling_warning', NULL, 2, 0, 0, NULL, CASE WHEN per < 5 THEN 20.0 WHEN per < 10 THEN 10.0 ELSE 5.0 END, "
        "CASE WHEN per < 5 THEN 55.0 END, NULL, NULL, NULL FROM (SELECT *, n_rows::DOUBLE / n_features AS per FROM meta) WHERE per < 20",
        "SELECT run_id, 8, 'model_readiness', 'HIGH_CARDINALITY_GENERALIZATION', CASE WHEN r >= 0.9 THEN 'high' WHEN r >= 0.7 THEN 'medium' ELSE 'low' END, "
        "'modeling_warning', column_name, 3, ordinal, 0, NULL, CASE WHEN r >= 0.9 THEN 8.0 WHEN r >= 0.7 THEN 5.0 ELSE 2.0 END, "
        "CASE WHEN r >= 0.9 AND n_rows < 100 THEN 50.0 END, NULL, NULL, NULL FROM nu WHERE NOT archive_run",
        "SELECT run_id, 8, 'model_readiness', 'NEAR_UNIQUE_FEATURE_CLUSTER', 'low', 'modeling_warning', NULL, 4, 0, 0, NULL, 6.0, NULL, NULL, NULL, NULL "
        "FROM (SELECT DISTINCT run_id FROM nu WHERE archive_run)",
        "SELECT run_id, 8, 'model_readiness', 'DATASET_PURPOSE_CLASSIFICATION', CASE WHEN purpose = 'Trainable with caution' THEN 'info' ELSE 'low' END, "
        "'modeling_warning', NULL, 8, 0, 0, NULL, NULL, NULL, CASE purpose WHEN 'Not suitable for supervised ML' THEN 60.0 "
        "WHEN 'EDA-only / visualization dataset' THEN 70.0 END, purpose, NULL FROM pu WHERE purpose <> 'Strong ML candidate'",
    ]
    return (
        base
        + f""",
dups AS ({dups}),
fr AS ({FEATURE_ROWS}),
nu AS (SELECT p.*, n_unique::DOUBLE / n_rows AS r, dataset_type = 'historical_archive' AND NOT given AS archive_run
 FROM p JOIN (SELECT run_id, target, given, dataset_type FROM meta) USING (run_id)
 WHERE (target IS NULL OR column_name <> target) AND NOT id_like AND dtype IN ('categorical', 'text', 'id')
 AND n_unique::DOUBLE / n_rows >= 0.5),
wk AS ({weak_by_run}),
pf AS (SELECT m.run_id, m.n_rows, m.n_rows::DOUBLE / m.n_features AS per,
 (SELECT count(*) FROM nu WHERE nu.run_id = m.run_id) AS crowd,
 coalesce((SELECT (dtype IN ('categorical', 'boolean', 'id') OR (dtype = 'numeric' AND n_unique <= 20)) AND n_unique >= 2
   AND (wk.low < 5 OR n_unique > m.n_rows / 10.0) FROM p JOIN wk USING (run_id)
   WHERE p.run_id = m.run_id AND p.column_name = m.target), false) AS weak
 FROM meta m),
pu AS (SELECT run_id, CASE WHEN n_rows < 30 OR (n_rows < 50 AND per < 5 AND weak) THEN 'Not suitable for supervised ML'
 WHEN n_rows < 50 AND (crowd > 0 OR weak OR per < 5) THEN 'EDA-only / visualization dataset'
 WHEN n_rows < 100 THEN 'Toy ML / demo only' WHEN n_rows < 500 OR per < 20 OR weak THEN 'Trainable with caution'
 ELSE 'Strong ML candidate' END AS purpose FROM pf),
f0 AS ({" UNION ALL ".join(feature_parts + parts)}),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY eng, block, place, place2, code, column_name) AS seq,
 {SEVERITY_RANK.format('severity')} AS sev_rank FROM f0)"""
    )


def scoring_ctes(runs: dict[str, str | None]) -> str:
    """``ledger_ctes`` plus ``w`` (weights), ``c`` (costs), ``s`` (scores) and ``z`` (words)."""
    weight = "CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 12.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 2.0 ELSE 0.0 END"
    return (
        ledger_ctes(runs)
        + f""",
w0 AS (SELECT *, {weight}::DOUBLE AS sw,
 CASE WHEN engine = 'outliers' OR code = 'HIGH_CARDINALITY_CATEGORICAL' THEN 'modeling_warning' ELSE category END AS cat FROM f),
w AS (SELECT *,
 (CASE WHEN engine = 'outliers' THEN 1.0 WHEN cat = 'modeling_warning' THEN 0.0
  WHEN code IN ('STRUCTURAL_MISSINGNESS_TIME_REGIME', 'CO_MISSING_GROUP') THEN least(sw, 2.0)
  WHEN code = 'MISSING_VALUES' AND coalesce(null_rate_m, 0) < 0.1 THEN least(sw, 3.0) ELSE sw END)::DOUBLE AS iw,
 (CASE WHEN pen IS NOT NULL THEN pen WHEN engine = 'outliers' THEN least(sw, 5.0)
  WHEN code IN ('STRUCTURAL_MISSINGNESS_TIME_REGIME', 'CO_MISSING_GROUP') THEN greatest(sw, 3.0) ELSE sw END)::DOUBLE AS rw,
 CASE WHEN code = 'MESSY_NUMERIC_TEXT' THEN engine || ':' || code ELSE engine END AS grp FROM w0),
c AS (SELECT *, greatest(0, least(iw, icap - ibefore)) AS ic, greatest(0, least(rw, rcap_g - rbefore)) AS rc FROM (
 SELECT *, CASE engine WHEN 'outliers' THEN 3.0 ELSE 40.0 END AS icap,
 CASE grp WHEN 'outliers' THEN 12.0 WHEN 'correlation' THEN 8.0 WHEN 'feature_quality' THEN 7.0
  WHEN 'feature_quality:MESSY_NUMERIC_TEXT' THEN 24.0 WHEN 'imbalance' THEN 18.0 WHEN 'model_readiness' THEN 60.0 ELSE 40.0 END AS rcap_g,
 sum(iw) OVER (PARTITION BY run_id, engine ORDER BY seq) - iw AS ibefore,
 sum(rw) OVER (PARTITION BY run_id, grp ORDER BY seq) - rw AS rbefore FROM w)),
t AS (SELECT run_id, sum(ic) AS it, sum(rc) AS rt, min(rcap) AS rcap, min(ocap) AS ocap,
 min(least(CASE purpose WHEN 'Not suitable for supervised ML' THEN 0 WHEN 'EDA-only / visualization dataset' THEN 1 WHEN 'Toy ML / demo only' THEN 2 WHEN 'Trainable with caution' THEN 3 WHEN 'Strong ML candidate' THEN 4 ELSE 9 END,
  CASE purpose_cap WHEN 'Not suitable for supervised ML' THEN 0 WHEN 'EDA-only / visualization dataset' THEN 1 WHEN 'Toy ML / demo only' THEN 2 WHEN 'Trainable with caution' THEN 3 WHEN 'Strong ML candidate' THEN 4 ELSE 9 END)) AS worst,
 count(*) FILTER (WHERE code IN ('MIXED_TYPE_COLUMN', 'NUMERIC_STORED_AS_STRING', 'MESSY_NUMERIC_TEXT') AND severity IN ('high', 'critical')) AS corrupt,
 count(*) FILTER (WHERE code = 'MISSING_VALUES' AND severity IN ('high', 'critical')) AS gaps,
 count(*) AS nf,
 count(*) FILTER (WHERE cat <> 'modeling_warning' AND severity = 'critical') AS icrit,
 count(*) FILTER (WHERE cat <> 'modeling_warning' AND severity = 'high') AS ihigh,
 count(*) FILTER (WHERE cat <> 'modeling_warning' AND severity <> 'info') AS iev,
 count(*) FILTER (WHERE (cat = 'modeling_warning' OR rc > 0) AND severity = 'critical') AS rcrit,
 count(*) FILTER (WHERE (cat = 'modeling_warning' OR rc > 0) AND severity = 'high') AS rhigh,
 count(*) FILTER (WHERE (cat = 'modeling_warning' OR rc > 0) AND severity <> 'info') AS rev
 FROM c GROUP BY run_id),
s0 AS (SELECT m.run_id, m.n_rows, m.given, m.dataset_type, t.*  EXCLUDE (run_id),
 round(greatest(0, least(100, 100 - coalesce(it, 0))), 1) AS integrity,
 least(round(greatest(0, least(100, 100 - coalesce(rt, 0))), 1), coalesce(rcap, 100)) AS r0
 FROM (SELECT run_id, n_rows, given, dataset_type FROM meta) m LEFT JOIN t ON m.run_id = t.run_id),
s1 AS (SELECT *, CASE WHEN given THEN r0 WHEN dataset_type = 'fixture_schedule' THEN least(r0, 60)
 WHEN dataset_type = 'historical_archive' THEN least(r0, 30) ELSE least(r0, 55) END AS readiness FROM s0),
s2 AS (SELECT *, CASE WHEN NOT given THEN CASE dataset_type WHEN 'fixture_schedule' THEN 'Simulation / forecasting / scheduling analysis'
  WHEN 'historical_archive' THEN 'EDA / visualization / historical analysis' ELSE 'Data integrity and exploratory analysis' END
 WHEN worst = 0 THEN 'Not suitable for supervised ML' WHEN worst = 1 THEN 'EDA-only / visualization dataset'
 WHEN worst = 2 THEN 'Toy ML / demo only' WHEN worst = 3 THEN 'Trainable with caution' WHEN worst = 4 THEN 'Strong ML candidate'
 WHEN readiness >= 85 THEN 'Strong ML candidate' WHEN readiness >= 70 THEN 'Trainable with caution'
 WHEN readiness >= 50 THEN 'Toy ML / demo only' ELSE 'EDA-only / visualization dataset' END AS purpose,
 CASE WHEN given THEN 0.6 * integrity + 0.4 * readiness WHEN dataset_type = 'fixture_schedule' THEN 0.8 * integrity + 0.2 * readiness
 WHEN dataset_type = 'historical_archive' THEN 0.7 * integrity + 0.3 * readiness ELSE 0.9 * integrity + 0.1 * readiness END AS o0 FROM s1),
s3 AS (SELECT *, CASE WHEN NOT given AND dataset_type = 'fixture_schedule' THEN least(greatest(round_even(o0, 0), 70), 85)
 WHEN NOT given AND dataset_type = 'historical_archive' THEN least(greatest(round_even(o0, 0), 60), 75) ELSE round_even(o0, 0) END AS o1 FROM s2),
s AS (SELECT *, least(o1, CASE WHEN corrupt > 0 THEN 55 ELSE 100 END, CASE WHEN gaps >= 3 THEN 70 ELSE 100 END,
 CASE WHEN given AND readiness < 40 THEN 65 ELSE 100 END, CASE WHEN given AND purpose = 'EDA-only / visualization dataset' THEN 70 ELSE 100 END,
 CASE WHEN given AND purpose = 'Not suitable for supervised ML' THEN 60 ELSE 100 END,
 CASE WHEN given THEN coalesce(ocap, 100) ELSE 100 END)::DOUBLE AS overall FROM s3),
z0 AS (SELECT *,
 CASE WHEN icrit > 0 OR ihigh > 0 OR iev >= 3 THEN 'high' WHEN (n_rows >= 200 AND nf >= 1) OR n_rows >= 100 THEN 'medium' ELSE 'low' END AS iconf,
 CASE WHEN NOT given OR n_rows < 50 THEN 'low' WHEN (rcrit > 0 OR rhigh > 0 OR rev >= 3) AND n_rows >= 200 THEN 'high'
  WHEN rcrit > 0 OR rhigh > 0 OR rev >= 3 OR (n_rows >= 200 AND nf >= 1) OR n_rows >= 100 THEN 'medium' ELSE 'low' END AS rconf FROM s),
z AS (SELECT *, CASE WHEN rconf = 'low' THEN 'low' WHEN iconf = rconf THEN iconf ELSE 'medium' END AS oconf,
 CASE WHEN NOT given AND dataset_type = 'fixture_schedule' THEN 'Suitable for simulation, scheduling analysis, and forecasting once outcome labels are added.'
 WHEN NOT given AND dataset_type = 'historical_archive' AND integrity >= 90 THEN 'Excellent historical dataset, but not suitable for reliable supervised ML because it has too few rows.'
 WHEN NOT given AND dataset_type = 'historical_archive' THEN 'Best suited for EDA, visualization, and historical comparison.'
 WHEN NOT given THEN 'Supervised ML readiness requires a target column.'
 WHEN integrity < 60 THEN 'Fix data integrity before modeling'
 WHEN purpose = 'Not suitable for supervised ML' AND integrity >= 80 THEN 'Clean dataset, but not suitable for reliable supervised ML. Best used for EDA, visualization, and historical analysis.'
 WHEN purpose <> 'Strong ML candidate' THEN purpose
 WHEN overall >= 85 AND readiness >= 75 AND readiness < 90 THEN 'Trainable with warnings'
 WHEN overall >= 85 AND readiness >= 75 THEN 'Ready for baseline modeling'
 WHEN readiness < 70 THEN 'Structurally usable, but modeling risk is high' ELSE 'Review before modeling' END AS verdict FROM z0)"""
    )


GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 75 THEN 'B' WHEN {0} >= 60 THEN 'C' WHEN {0} >= 45 THEN 'D' ELSE 'F' END"
OVERALL_GRADE = (
    "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 85 THEN 'A-' WHEN {0} >= 80 THEN 'B+' WHEN {0} >= 75 THEN 'B' "
    "WHEN {0} >= 70 THEN 'B-' WHEN {0} >= 60 THEN 'C' WHEN {0} >= 45 THEN 'D' ELSE 'F' END"
)


# --- numeric checks -------------------------------------------------------------


def quantile_rows(source: str, columns: list[str]) -> str:
    """``column_name, x`` long form."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({q(c)} AS DOUBLE) AS x FROM ({sql_of(source)}) WHERE {q(c)} IS NOT NULL"
        for c in columns
    )


def outlier_sql(source: str, columns: list[str]) -> str:
    return f"""WITH v AS ({quantile_rows(source, columns)}),
st AS (SELECT column_name, count(*) AS n, quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3, mad(x) AS mad
 FROM v GROUP BY column_name),
o AS (SELECT st.*, count(*) FILTER (WHERE (q3 > q1 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)))
 OR (mad > 0 AND abs(0.6745 * (x - med) / mad) > 3.5)) AS n_outliers
 FROM v JOIN st USING (column_name) GROUP BY ALL)"""


def corr_sql(a: str, b: str) -> str:
    """Pearson over complete pairs; NULL where a side is constant."""
    r = f"corr({a}, {b})"
    return f"CASE WHEN isnan({r}) OR isinf({r}) THEN NULL ELSE greatest(-1.0, least(1.0, {r})) END"


def pair_sql(source: str, columns: list[str]) -> str:
    """``column_name, column2, place, place2, r`` for every pair."""
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            parts.append(
                f"SELECT '{a}' AS column_name, '{b}' AS column2, {i} AS place, {j} AS place2, "
                f"{corr_sql(f'CAST({q(a)} AS DOUBLE)', f'CAST({q(b)} AS DOUBLE)')} AS r FROM src"
            )
    return f"WITH src AS ({sql_of(source)}), pr AS ({' UNION ALL '.join(parts)})"


def mask_pair_sql(source: str, columns: list[str]) -> str:
    """``column_name, column2, place, place2, r`` of null masks; only pairs that coincide."""
    parts = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            parts.append(
                f"SELECT '{a}' AS column_name, '{b}' AS column2, {i} AS place, {j} AS place2, "
                f"{corr_sql(f'({q(a)} IS NULL)::INT', f'({q(b)} IS NULL)::INT')} AS r, "
                f"count(*) FILTER (WHERE {q(a)} IS NULL AND {q(b)} IS NULL) AS both_null FROM src"
            )
    return f"WITH src AS ({sql_of(source)}), pr AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE both_null > 0)"


def association_sql(source: str, target: str, classes: bool, features: dict[str, bool]) -> str:
    """CTEs ending in ``a``: column_name, n_pairs, exact, mi, corr, spearman.

    ``features`` maps a name to "is a quantity". Codes follow value order; missing
    labels are -1, missing quantities take the median in the mutual information.
    """
    t = q(target)
    ctes = [f"src AS (SELECT * FROM ({sql_of(source)}) WHERE {t} IS NOT NULL)"]
    fitting = f"count(*) // (5 * count(DISTINCT {t}))" if classes else "CAST(floor(sqrt(count(*) // 5)) AS BIGINT)"
    ctes.append(f"nb AS (SELECT greatest(2, least(20, {fitting})) AS b FROM src)")
    y = f"(dense_rank() OVER (ORDER BY {t}) - 1)::DOUBLE" if classes else f"CAST({t} AS DOUBLE)"
    parts = []
    for name, quantity in features.items():
        c = q(name)
        if quantity:
            x, label = f"CAST({c} AS DOUBLE)", "NULL::VARCHAR"
        else:
            x = f"CASE WHEN {c} IS NULL THEN -1.0::DOUBLE ELSE (dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1)::DOUBLE END"
            label = f"coalesce('=' || CAST({c} AS VARCHAR), '-')"
        parts.append(
            f"SELECT '{name}' AS column_name, {str(quantity).lower()} AS quantity, {x} AS x, {y} AS y, {label} AS label, "
            f"CAST({t} AS VARCHAR) AS cls FROM src"
        )
    ctes.append(f"v AS ({' UNION ALL '.join(parts)})")
    ctes.append(
        f"""lin AS (SELECT column_name, count(x) AS n_pairs, count(*) FILTER (WHERE x = y) AS n_equal, {corr_sql('x', 'y')} AS r
 FROM v GROUP BY column_name),
rk AS (SELECT column_name, rank() OVER (PARTITION BY column_name ORDER BY x) + (count(*) OVER (PARTITION BY column_name, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY column_name ORDER BY y) + (count(*) OVER (PARTITION BY column_name, y) - 1) / 2.0 AS ry FROM v WHERE x IS NOT NULL),
spr AS (SELECT column_name, {corr_sql('rx', 'ry')} AS rho FROM rk GROUP BY column_name),
md AS (SELECT column_name, median(x) AS med FROM v WHERE quantity GROUP BY column_name),
pos AS (SELECT column_name, x, row_number() OVER (PARTITION BY column_name ORDER BY x) AS rn,
 count(*) OVER (PARTITION BY column_name) AS n FROM v WHERE quantity AND x IS NOT NULL),
edge AS (SELECT DISTINCT column_name, x AS e FROM pos JOIN (SELECT b, unnest(range(1, b)) AS i FROM nb) g ON rn = (n * i + b - 1) // b),
ypos AS (SELECT y, row_number() OVER (ORDER BY y) AS rn, count(*) OVER () AS n FROM (SELECT {y} AS y FROM src)),
yedge AS (SELECT DISTINCT y AS e FROM ypos JOIN (SELECT b, unnest(range(1, b)) AS i FROM nb) g ON rn = (n * i + b - 1) // b),
vb AS (SELECT v.column_name, quantity,
 CASE WHEN quantity THEN CAST((SELECT count(*) FROM edge WHERE edge.column_name = v.column_name AND edge.e < coalesce(v.x, md.med)) AS VARCHAR)
  ELSE label END AS xb,
 {"cls" if classes else "CAST((SELECT count(*) FROM yedge WHERE yedge.e < v.y) AS VARCHAR)"} AS yb
 FROM v LEFT JOIN md ON v.column_name = md.column_name),
jt AS (SELECT column_name, xb, yb, count(*)::DOUBLE AS n FROM vb GROUP BY ALL),
tot AS (SELECT column_name, sum(n) AS n, count(*) AS kxy, sum(n * ln(n)) AS sxy FROM jt GROUP BY column_name),
tx AS (SELECT column_name, sum(n * ln(n)) AS sx, count(*) AS kx FROM (SELECT column_name, xb, sum(n) AS n FROM jt GROUP BY ALL) GROUP BY column_name),
ty AS (SELECT column_name, sum(n * ln(n)) AS sy, count(*) AS ky FROM (SELECT column_name, yb, sum(n) AS n FROM jt GROUP BY ALL) GROUP BY column_name),
mi AS (SELECT column_name, tot.n, ky, kx = kxy AND ky = kxy AS one_to_one, ln(tot.n) - sy / tot.n AS hy,
 greatest(0, ln(tot.n) + (sxy - sx - sy) / tot.n) AS mi FROM tot JOIN tx USING (column_name) JOIN ty USING (column_name)),
a AS (SELECT column_name, n_pairs, n_pairs >= 10 AND coalesce(CASE WHEN {str(classes).lower()} AND NOT quantity THEN one_to_one ELSE n_equal = n_pairs END, false) AS exact,
 CASE WHEN mi.n >= 20 AND (ky >= 2 OR {str(not classes).lower()}) THEN mi.mi / CASE WHEN hy > 1e-9 THEN hy ELSE 1 END ELSE 0 END AS mi,
 CASE WHEN n_pairs >= 10 THEN coalesce(abs(r), 0) ELSE 0 END AS corr,
 CASE WHEN n_pairs >= 10 THEN coalesce(abs(rho), 0) ELSE 0 END AS spearman
 FROM lin LEFT JOIN spr USING (column_name) JOIN mi USING (column_name) JOIN (SELECT DISTINCT column_name, quantity FROM v) USING (column_name))"""
    )
    return "WITH " + ",\n".join(ctes)
