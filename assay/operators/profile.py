"""Column profiles: counts, rates, logical type, name kind and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import name_kind, ratio, rounded
from ..functions.text import as_datetime, clean_number, is_number
from ..settings import DEFAULTS, Settings
from .columns import chunks, col, kinds, missing_as_null, quoted
from .value_counts import counted, distinct_summary, sample_values, smallest_values

def profile(
    df: DataFrame,
    run_id: str = "table",
    settings: Settings = DEFAULTS,
    order_by: Column | None = None,
) -> DataFrame:
    """One row per column with everything the checks decide on.

    The counts of (column, value) give presence, distinct values, the commonest
    value and the boolean test; text of up to 64 bytes is parsed once per distinct value, longer text once per row.
    With ``exact_distinct=False`` the profile comes from the mergeable state of the columns; those whose distinct count is too
    near a threshold to decide by are then grouped exactly.
    """
    df = missing_as_null(df)
    spark = df.sparkSession
    if settings.exact_distinct:
        counts = counted(df, settings=settings)
        joined = _summed(column_list(df, settings), distinct_summary(counts, spark))
    else:
        from .column_state import column_state

        return profile_of_state(column_state(df, settings), run_id, settings, df)
    if settings.sample_values and counts:
        key = "ordinal" if order_by is None else "column"
        chosen = (
            smallest_values(counts, settings.sample_values)
            if order_by is None
            else sample_values(df, settings.sample_values, order_by)
        )
        samples = (
            chosen.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("position", "value"))).alias("s"))
            .select(key, F.col("s.value").alias("sample_values"))
        )
        joined = joined.join(F.broadcast(samples), key, "left")  # one row per column
    else:
        joined = joined.withColumn("sample_values", F.lit(None).cast("array<string>"))
    return describe(joined, settings).select(F.lit(run_id).alias("run_id"), "*")


def _summed(columns: DataFrame, summary: DataFrame) -> DataFrame:
    nested = F.col("kind") == "nested"
    return columns.join(F.broadcast(summary), "ordinal", "left").withColumns(  # one row per column
        {
            "n_present": F.when(nested, F.col("n_nested")).otherwise(F.coalesce("n_present", F.lit(0))),
            "n_unique": F.when(~nested, F.coalesce("n_unique", F.lit(0))),
        }
    )


def profile_parts(df: DataFrame, part: Column, parts: int, run_id: str = "table", settings: Settings = DEFAULTS) -> DataFrame:
    """Profiles of a table (``slice`` 0) and of its parts (``slice`` k: rows with ``part`` = k - 1), from one grouping; no sample values.

    ``part`` may need the whole row, so every scan reads it whole: a first one counts rows and estimates distinct values, and by that
    columns of few values share the scan of their grouping. The estimate decides on scans only.
    """
    df, width, spark = missing_as_null(df), len(df.columns), df.sparkSession
    columns = column_list(df, settings, part, parts, estimate=True)
    rows = columns.collect()  # one row per column and part
    about = {r["column"]: r["n_about"] for r in rows[:width] if r["n_about"] is not None}
    summary = distinct_summary(counted(df, settings=settings, part=part, parts=parts, about=about), spark)
    joined = _summed(spark.createDataFrame(rows, columns.schema).drop("n_about"), summary).withColumn("sample_values", F.lit(None).cast("array<string>"))
    return describe(joined, settings).select(
        F.lit(run_id).alias("run_id"), "*", F.floor(F.col("ordinal") / width).cast("int").alias("slice")
    ).withColumn("ordinal", F.col("ordinal") % width)


def profile_of_state(state: DataFrame, run_id: str = "table", settings: Settings = DEFAULTS, df: DataFrame | None = None) -> DataFrame:
    """A profile from a stored state. With the table at hand, columns too near a threshold are counted exactly."""
    from .column_state import summary

    known = summary(state)
    spark = state.sparkSession
    rows = known.collect()  # one row per column
    known = spark.createDataFrame(rows, known.schema).drop("slack")
    open_columns = [r["column"] for r in rows if undecided(r, settings)]
    if df is not None and open_columns:
        exact = distinct_summary(counted(df, open_columns), spark).select("ordinal", F.col("n_unique").alias("u"), F.col("top_count").alias("t"), F.col("is_boolean").alias("b"))
        known = known.join(F.broadcast(exact), "ordinal", "left").withColumns(  # one row per column
            {"n_unique": F.coalesce("u", "n_unique"), "top_count": F.coalesce("t", "top_count"), "is_boolean": F.coalesce("b", "is_boolean")}).drop("u", "t", "b")
    if not settings.sample_values:
        known = known.withColumn("sample_values", F.lit(None).cast("array<string>"))
    return describe(known, settings).select(F.lit(run_id).alias("run_id"), "*")


def undecided(row, settings: Settings) -> bool:
    """Is the estimated distinct count within four deviations of a threshold that a rule compares its ratio with?"""
    n, found = row["n_rows"], row["n_unique"] or 0
    near = 4 * row["slack"]
    shares = (0.5, settings.high_cardinality_ratio, settings.id_ratio, 1.0)
    return near > 0 and any(abs(found - share * n) <= near for share in shares)


def column_list(df: DataFrame, settings: Settings = DEFAULTS, part: Column | None = None, parts: int = 0, estimate: bool = False) -> DataFrame:
    """One row per column: position, name, type, row count; presence of nested columns. Those of the table's parts, if any, follow.

    With ``estimate`` also ``n_about``: about how many distinct values the column has in the whole table, null if it is nested.
    """
    kind = kinds(df)
    nested = [f.name for f in df.schema.fields if kind[f.name] == "nested"]
    place = {name: i for i, name in enumerate(nested)}
    slices = [None, *range(parts)]
    rows = [
        F.struct(
            F.lit(k * len(df.columns) + i).alias("ordinal"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("physical_type"),
            F.lit(kind[f.name]).alias("kind"),
            F.col(f"n{k}").alias("n_rows"),
            (F.col(f"p{place[f.name]}_{k}") if f.name in place else F.lit(None).cast("bigint")).alias("n_nested"),
            *([(F.lit(None).cast("bigint") if f.name in place else F.col(f"u{i}")).alias("n_about")] if estimate else []),
        )
        for k in range(len(slices)) for i, f in enumerate(df.schema.fields)
    ]
    held = lambda c, s: c if s is None else F.when(part == s, c)
    counts = [F.count(held(F.lit(1), s)).alias(f"n{k}") for k, s in enumerate(slices)]
    counts += [F.count(held(col(name), s)).alias(f"p{i}_{k}") for name, i in place.items() for k, s in enumerate(slices)]
    if estimate:
        counts += [F.approx_count_distinct(col(f.name)).alias(f"u{i}") for i, f in enumerate(df.schema.fields) if f.name not in place]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def describe(joined: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The rules that turn raw counts into a profile."""
    s = settings
    present, n = F.col("n_present"), F.col("n_rows")
    counts = joined.select(
        "*",
        F.col("n_unique").alias("u"),
    ).select(
        "*",
        ratio(F.col("u"), n).alias("raw_ratio"),
        ratio(F.col("n_number"), present).alias("numeric_parse_rate"),
        ratio(F.col("n_clean"), present).alias("clean_numeric_parse_rate"),
        ratio(F.col("n_date"), present).alias("datetime_parse_rate"),
        ratio(F.col("length"), present).alias("avg_len"),
        name_kind(F.col("column")).alias("name_kind"),
    )
    structural = (
        F.when(F.col("kind") == "nested", "nested")
        .when(present == 0, "categorical")
        .when((F.col("u") <= 2) & F.col("is_boolean"), "boolean")
        .when(F.col("kind") == "boolean", "boolean")
        .when(F.col("kind") == "number", "numeric")
        .when(F.col("kind") == "datetime", "datetime")
        .when(F.col("numeric_parse_rate") >= s.parse_share, "numeric")
        .when(F.col("datetime_parse_rate") >= s.parse_share, "datetime")
        .when(F.col("raw_ratio") >= s.id_ratio, "id")
        .when((F.col("avg_len") > s.text_length) & (F.col("raw_ratio") > 0.5), "text")
        .otherwise("categorical")
    )
    id_like = (F.col("name_kind") == "identifier") & (F.coalesce(F.col("u"), F.lit(0)) >= 2)
    typed = counts.select("*", structural.alias("structural"), id_like.alias("is_id_like")).select(
        "*",
        F.when(F.col("is_id_like"), "id")
        .when(F.col("structural") == "id", "categorical")
        .otherwise(F.col("structural"))
        .alias("dtype_inferred"),
    )
    n_null = n - present
    top = F.greatest(F.coalesce(F.col("top_count"), F.lit(0)), n_null)
    known_top = F.col("top_count").isNotNull() | (present == 0)
    return typed.select(
        "ordinal",
        "column",
        "physical_type",
        "kind",
        "dtype_inferred",
        "name_kind",
        "n_rows",
        n_null.alias("n_null"),
        rounded(F.coalesce(ratio(n_null, n), F.lit(0.0))).alias("null_rate"),
        F.col("u").alias("n_unique"),
        rounded(F.coalesce(F.col("raw_ratio"), F.lit(0.0))).alias("cardinality_ratio"),
        F.when(known_top, top).alias("top_count"),
        F.when(known_top, ratio(top, n)).alias("top_share"),
        "numeric_parse_rate",
        "clean_numeric_parse_rate",
        "datetime_parse_rate",
        "avg_len",
        "sample_values",
        "is_id_like",
        (
            F.col("dtype_inferred").isin("categorical", "text")
            & ((F.col("u") >= s.high_cardinality) | (F.col("raw_ratio") >= s.high_cardinality_ratio))
        ).alias("is_high_cardinality"),
        (F.coalesce(F.col("u"), F.lit(2)) <= 1).alias("is_constant"),
    )


def head_probe(df: DataFrame, columns: list[str], order_by: Column, k: int = 200) -> DataFrame:
    """Parse rates over the first ``k`` present values of each text column, by ``order_by``."""
    wide = df.select(order_by.alias("rank"), *[col(c).alias(str(i)) for i, c in enumerate(columns)])
    long = wide.unpivot(["rank"], [str(i) for i in range(len(columns))], "slot", "value")
    w = Window.partitionBy("slot").orderBy("rank")
    head = (
        long.filter(F.col("value").isNotNull())
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= k)
    )
    names = F.array(*[F.lit(c) for c in columns])
    return head.groupBy("slot").agg(
        F.count(F.lit(1)).alias("probed"),
        ratio(F.count_if(is_number(F.col("value"))), F.count(F.lit(1))).alias("numeric_parse_rate"),
        ratio(F.count(clean_number(F.col("value"))), F.count(F.lit(1))).alias("clean_numeric_parse_rate"),
        ratio(F.count(as_datetime(F.col("value"))), F.count(F.lit(1))).alias("datetime_parse_rate"),
    ).select(F.get(names, F.col("slot").cast("int")).alias("column"), "probed",
             "numeric_parse_rate", "clean_numeric_parse_rate", "datetime_parse_rate")


def type_counts(profiles: DataFrame) -> DataFrame:
    """Per run: how many columns of each family."""
    t = F.col("dtype_inferred")
    return profiles.groupBy("run_id").agg(
        F.count_if(t == "numeric").alias("n_numeric"),
        F.count_if(t.isin("categorical", "text", "boolean")).alias("n_categorical"),
        F.count_if(t == "datetime").alias("n_datetime"),
        F.count_if(F.col("is_id_like")).alias("n_id_like"),
    )


def fingerprint(profiles: DataFrame, findings: DataFrame) -> DataFrame:
    """Per run: a short hash of the column types, finding codes and table shape."""
    types = profiles.groupBy("run_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "column", "dtype_inferred"))), ",").alias("types"),
        F.max("n_rows").alias("rows"),
        F.count(F.lit(1)).alias("cols"),
    )
    codes = findings.groupBy("run_id").agg(
        F.array_join(F.sort_array(F.collect_list("code")), ",").alias("codes")
    )
    text = F.concat_ws("|", "types", F.coalesce("codes", F.lit("")), F.col("rows").cast("string"), F.col("cols").cast("string"))
    return types.join(codes, "run_id", "left").select(
        "run_id", F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint")
    )
