"""Repeated rows and identifiers with contradictory labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ratio
from ..settings import DEFAULTS, Settings
from .columns import col, long_form, missing_as_null, physical_kind, quoted
from .findings import emit, finding, percent


def _flagged(c: Column, dtype: T.DataType) -> Column:
    return F.struct(c.isNull().alias("none"), _hashable(c, dtype).alias("value"))


def _hashable(c: Column, dtype: T.DataType) -> Column:
    """A value whose hash keeps nulls and lengths at every depth; hash functions skip nulls inside nested values."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[_flagged(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(dtype.fields)]) if dtype.fields else F.lit(0)
    if isinstance(dtype, T.ArrayType):
        return F.struct(F.size(c).alias("n"), F.transform(c, lambda x: _flagged(x, dtype.elementType)).alias("all"))
    if isinstance(dtype, T.MapType):  # entries have no order, keys are never null
        pair = lambda k: F.struct(_hashable(k, dtype.keyType).alias("k"), _flagged(F.try_element_at(c, k), dtype.valueType).alias("v"))
        return F.struct(F.size(c).alias("n"), F.transform(F.sort_array(F.map_keys(c)), pair).alias("all"))
    return c


def row_digest(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """128 bits that stand for a whole row, in two hash columns; nulls have their place."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    parts = [p for f in fields for p in (_hashable(F.col(quoted(f.name)), f.dataType), F.col(quoted(f.name)).isNull())]
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *reversed(parts))]


def rows_like(df: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of ``df`` whose digest a row of ``few`` has: all that comparing the two needs. ``few`` is bounded, as a sample is; its digests are broadcast."""
    def digest(rows: DataFrame) -> dict[str, Column]:
        return dict(zip(("__h1", "__h2"), row_digest(rows)))

    wanted = few.select(*[h.alias(name) for name, h in digest(few).items()]).distinct()
    return df.withColumns(digest(df)).join(F.broadcast(wanted), ["__h1", "__h2"], "left_semi").drop("__h1", "__h2")


def duplicate_counts(df: DataFrame) -> DataFrame:
    """``n_rows, dup_count``: rows that repeat an earlier row in every column.

    Only 16 bytes per row are shuffled, and copies are combined before that, so
    neither wide rows nor a group of copies that fills a third of the table hurt.
    """
    first, second = row_digest(missing_as_null(df))
    groups = df.transform(missing_as_null).select(first.alias("h1"), second.alias("h2")).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup_count"),
    )


def label_range(c: Column, dtype: T.DataType) -> tuple[list[Column], Column]:
    """Aggregates and a test for "more than one distinct value", without a distinct count.

    Texts are compared by two independent 64-bit hashes, so the aggregation stays
    a hash aggregation with fixed-size buffers.
    """
    if physical_kind(dtype) == "string":
        a, b = F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)
        sums = [F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1")]
        return sums, (F.col("a0") != F.col("a1")) | (F.col("b0") != F.col("b1"))
    if isinstance(dtype, T.BooleanType):
        c = c.cast("int")
    return [F.min(c).alias("a0"), F.max(c).alias("a1")], F.col("a0") != F.col("a1")


def conflicting_ids(df: DataFrame, id_column: str, target: str) -> DataFrame:
    """The values of ``id_column`` that occur with more than one value of ``target``."""
    sums, differs = label_range(col(target), df.schema[target].dataType)
    return (
        df.filter(col(id_column).isNotNull() & col(target).isNotNull())
        .groupBy(col(id_column).alias(id_column))
        .agg(*sums, F.count(F.lit(1)).alias("n_rows"))
        .filter(differs)
        .select(quoted(id_column), "n_rows")
    )


def id_conflicts(df: DataFrame, id_columns: list[str], target: str) -> DataFrame:
    """``column, conflicting_ids`` for every identifier column: one scan and one grouping for all of them."""
    df = missing_as_null(df)
    if not id_columns:
        return df.sparkSession.createDataFrame([], "column string, conflicting_ids bigint")
    sums, differs = label_range(F.col("label"), df.schema[target].dataType)
    labelled = df.filter(col(target).isNotNull())
    long = long_form(labelled, {c: col(c).cast("string") for c in id_columns}, value="id", keep={"label": col(target)})
    clashes = long.groupBy("column", "id").agg(*sums).filter(differs).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    asked = df.sparkSession.createDataFrame([(c,) for c in id_columns], "column string")
    return asked.join(clashes, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("conflicting_ids"))


# --- findings ---------------------------------------------------------------


def duplicate_findings(counts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``counts``: run_id, n_rows, dup_count."""
    rate = ratio(F.col("dup_count"), F.col("n_rows"))
    severity = F.when(rate >= settings.duplicate_high, "high").when(rate >= settings.duplicate_medium, "medium").otherwise("low")
    return emit(
        counts,
        "duplicates",
        [
            (
                F.col("dup_count") > 0,
                finding(
                    "EXACT_DUPLICATE_ROWS",
                    severity,
                    F.format_string("%d duplicate rows (%s%%)", F.col("dup_count"), percent(rate)),
                    F.format_string("%d of %d rows repeat another row in every column.", F.col("dup_count"), F.col("n_rows")),
                    "Copies make the table look larger than it is and put the same row on both sides of a random split.",
                    "df = df.dropDuplicates()",
                    metrics={"dup_count": F.col("dup_count"), "dup_rate": F.round(rate, 4)},
                ),
            )
        ],
    )


def id_conflict_findings(conflicts: DataFrame) -> DataFrame:
    """``conflicts``: run_id, ordinal, target, column, conflicting_ids."""
    c, t, k = F.col("column"), F.col("target"), F.col("conflicting_ids")
    return emit(
        conflicts,
        "duplicates",
        [
            (
                k > 0,
                finding(
                    "DUPLICATE_ID_LABEL_NOISE",
                    "critical",
                    F.format_string("%d values of '%s' have contradictory '%s' labels", k, c, t),
                    F.format_string("%d identifiers in '%s' occur with more than one value of '%s'.", k, c, t),
                    "One entity with several labels is label noise; it limits how accurate any model can get.",
                    F.format_string('conflicting_ids(df, "%s", "%s").show()', c, t),
                    column=c,
                    metrics={"conflicting_ids": k},
                    block=1,
                    place=F.col("ordinal"),
                ),
            )
        ],
    )
