"""Inputs of the registered queries: the given tables, and tables with known faults made from them.

Every input exists twice: as a DataFrame and as the same SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns and physical kinds of the given tables.
TABLES = {
    "region": {"r_regionkey": "number", "r_name": "string"},
    "nation": {"n_nationkey": "number", "n_name": "string", "n_regionkey": "number"},
    "customer": {
        "c_custkey": "number", "c_name": "string", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "string",
    },
    "supplier": {"s_suppkey": "number", "s_name": "string", "s_nationkey": "number", "s_acctbal": "number"},
    "part": {
        "p_partkey": "number", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "number",
        "p_retailprice": "number",
    },
    "orders": {
        "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number",
        "o_orderdate": "datetime", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number",
        "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime",
    },
    "events": {
        "event_id": "number", "ts": "datetime", "user_id": "number", "event_type": "string", "value": "number",
        "props": "string",
    },
    "documents": {"doc_id": "number", "text": "string", "lang": "string", "source": "string", "n_chars": "number"},
    "embeddings": {"vec_id": "number", "embedding": "nested", "label": "number"},
    "pages": {"page_id": "number", "url": "string", "html": "string"},
    "benchmark": {"item_id": "number", "text": "string"},
    "labels": {"doc_id": "number", "quality": "number", "toxic": "number"},
    "conversations": {"conv_id": "number", "turn": "number", "role": "string", "text": "string"},
}

# name -> (SQL that both engines run, columns with kinds)
DERIVED = {
    # half the documents have no label: both label columns are missing together
    "labelled": (
        "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        {**TABLES["documents"], "quality": "number", "toxic": "number"},
    ),
    # three columns missing together
    "clustered": (
        "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, "
        "CASE WHEN l.quality IS NOT NULL THEN d.n_chars END AS labelled_chars "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        {"doc_id": "number", "lang": "string", "n_chars": "number", "quality": "number", "toxic": "number",
         "labelled_chars": "number"},
    ),
    # a value that is not recorded in one year
    "regime": (
        "SELECT o_orderkey, o_custkey, o_orderstatus, "
        "CASE WHEN year(o_orderdate) = 1998 THEN NULL ELSE o_totalprice END AS o_totalprice, "
        "o_orderdate AS placed_at, o_orderpriority FROM orders",
        {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number",
         "placed_at": "datetime", "o_orderpriority": "string"},
    ),
    # exact copies of every first line
    "copies": (
        "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1",
        TABLES["lineitem"],
    ),
    # numbers as text, numbers with units, mixed types, constant and almost constant columns
    "part_text": (
        "SELECT p_partkey, p_name, p_type, CAST(p_size AS VARCHAR(20)) AS size_text, "
        "CASE WHEN p_size % 5 = 0 THEN 'ask' ELSE concat(CAST(p_size AS VARCHAR(20)), ',000 USD') END AS price_text, "
        "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR(20)) ELSE p_type END AS mixed, "
        "1 AS fixed, CASE WHEN p_partkey % 400 = 0 THEN 1 ELSE 0 END AS rare_flag, "
        "CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'no' END AS answer, p_retailprice FROM part",
        {"p_partkey": "number", "p_name": "string", "p_type": "string", "size_text": "string", "price_text": "string",
         "mixed": "string", "fixed": "number", "rare_flag": "number", "answer": "string", "p_retailprice": "number"},
    ),
    # dates as text
    "order_text": (
        "SELECT o_orderkey, substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS placed, "
        "substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS placed_month, o_orderpriority FROM orders",
        {"o_orderkey": "number", "placed": "string", "placed_month": "string", "o_orderpriority": "string"},
    ),
    # a class of a twentieth
    "unbalanced": (
        "SELECT l_partkey, l_suppkey, l_quantity, l_discount, "
        "CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 1 ELSE 0 END AS returned FROM lineitem",
        {"l_partkey": "number", "l_suppkey": "number", "l_quantity": "number", "l_discount": "number",
         "returned": "number"},
    ),
    # a copy of the target, a near copy, and a score made from it
    "leaky": (
        "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, "
        "l.quality AS final_label, "
        "CASE WHEN d.doc_id % 400 = 0 THEN 1 - l.quality ELSE l.quality END AS status_flag, "
        "CASE WHEN d.doc_id % 10 = 0 THEN (d.doc_id % 1000) / 1000.0E0 ELSE l.quality + (d.doc_id % 100) / 1000.0E0 END AS outcome_score, "
        "CASE WHEN l.quality = 1 THEN 'kept' ELSE 'gone' END AS fate, "
        "CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.n_chars END AS seen_chars "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
        {"doc_id": "number", "lang": "string", "n_chars": "number", "quality": "number", "toxic": "number",
         "final_label": "number", "status_flag": "number", "outcome_score": "number", "fate": "string",
         "seen_chars": "number"},
    ),
    # values with a heavy tail, next to values without
    "tailed": (
        "SELECT event_id, value, value * value AS duration_squared, event_type FROM events",
        {"event_id": "number", "value": "number", "duration_squared": "number", "event_type": "string"},
    ),
    # two near duplicates, one strong pair, one weak pair
    "redundant": (
        "SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_discount, l_tax, "
        "l_quantity * 2 + 1 AS double_quantity FROM lineitem",
        {c: "number" for c in ("l_quantity", "l_extendedprice", "net", "l_discount", "l_tax", "double_quantity")},
    ),
    # quantities with gaps, and a target value that nearly half of the rows share
    "hot_gaps": (
        "SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_discount, "
        "CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_linenumber <= 2 THEN 1000 ELSE l_extendedprice END AS paid FROM lineitem",
        {c: "number" for c in ("l_quantity", "l_discount", "l_tax", "paid")},
    ),
    # a target with far too many classes
    "many_classes": (
        "SELECT c_custkey, c_nationkey, c_acctbal, c_name AS result FROM customer",
        {"c_custkey": "number", "c_nationkey": "number", "c_acctbal": "number", "result": "string"},
    ),
    # columns that are only known after the outcome
    "late": (
        "SELECT p_size, p_size * 2 AS goals, p_size + 1 AS final_score, p_retailprice AS points, "
        "p_retailprice AS order_total, p_type AS result FROM part",
        {"p_size": "number", "goals": "number", "final_score": "number", "points": "number", "order_total": "number",
         "result": "string"},
    ),
    # a short archive: one row per nation, nearly unique names
    "archive": (
        "SELECT n_nationkey AS edition, 1900 + n_nationkey AS year, n_name AS host, "
        "concat('winner ', n_name) AS winner, concat('second ', n_name) AS runner_up, n_regionkey AS goals, "
        "n_nationkey * 2 AS matches FROM nation",
        {"edition": "number", "year": "number", "host": "string", "winner": "string", "runner_up": "string",
         "goals": "number", "matches": "number"},
    ),
}


def columns_of(name: str) -> dict[str, str]:
    return DERIVED[name][1] if name in DERIVED else TABLES[name]


def sql_of(name: str) -> str:
    return DERIVED[name][0] if name in DERIVED else f"SELECT * FROM {name}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frame(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given or derived table by name."""
    if name in TABLES:
        return table(spark, folder, name)
    text = DERIVED[name][0]
    used = {t: table(spark, folder, t) for t in TABLES if f" {t} " in f" {text} "}
    for t in used:
        text = f" {text} ".replace(f" {t} ", f" {{{t}}} ").strip()
    return spark.sql(text, **used)
