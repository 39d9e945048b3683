"""Repairs: what a finding suggests, as DataFrame to DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_number, clean_number, ratio
from ..settings import DEFAULTS, Settings
from ..sources.sampling import sample_share, unit_hash
from .columns import col, long_form, missing_as_null, quoted
from .duplicates import conflicting_ids  # noqa: F401  (part of the repair surface)
from .imbalance import class_counts
from .order_stats import count_present, quantiles
from .ranks import cumulative


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def fill_constant(df: DataFrame, columns: list[str], value: str = "Unknown") -> DataFrame:
    """Nulls become ``value``; columns of other types turn into text first."""
    filled = {}
    for c in columns:
        text = col(c) if isinstance(df.schema[c].dataType, T.StringType) else col(c).cast("string")
        filled[c] = F.coalesce(text, F.lit(value))
    return missing_as_null(df).withColumns(filled)


def _with_median(c: Column, dtype: T.DataType, median: float) -> Column:
    """``c`` with its gaps filled; whole-number columns keep every value and widen only where the median needs a half."""
    if isinstance(dtype, T.IntegralType):
        if median == round(median):
            return F.coalesce(c, F.lit(int(median)).cast(dtype))
        return F.coalesce(c.cast("decimal(38, 6)"), F.lit(median).cast("decimal(38, 6)"))
    if isinstance(dtype, T.DecimalType):
        wide = T.DecimalType(38, max(dtype.scale, 6)) if dtype.precision - dtype.scale + max(dtype.scale, 6) <= 38 else dtype
        return F.coalesce(c.cast(wide), F.lit(median).cast(wide))
    return F.coalesce(c.cast("double"), F.lit(median))


def fill_median(df: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Gaps of numeric columns take the column's exact median; values that are present stay as they are."""
    df = missing_as_null(df)
    values = {c: col(c).cast("double") for c in columns}
    medians = quantiles(long_form(df, values), [0.5], count_present(df, values), settings)
    gappy = count_present(df, {c: F.when(v.isNull(), F.lit(1)) for c, v in values.items()}, settings)
    return df.withColumns({c: _with_median(col(c), df.schema[c].dataType, medians[c][0]) for c in columns if c in medians and gappy[c]})


def fill_median_by(df: DataFrame, column: str, group: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Gaps take the exact median of their group (say, a year); groups without values keep them.

    Distinct values are placed in their group's order by ``cumulative``, which cuts large groups into sorted ranges, so
    neither a hot group nor many groups meet in one task, and medians never leave the executors.
    """
    df = missing_as_null(df).withColumn("__group", group.cast("string"))
    value = col(column).cast("double")
    present = df.filter(value.isNotNull() & F.col("__group").isNotNull())
    counts = present.groupBy(F.col("__group").alias("column"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = cumulative(counts, None, settings)
    totals = placed.groupBy("column").agg(F.sum("n").alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    at = lambda rank: F.max(F.when(holds(rank), F.col("value")))
    middle = placed.join(totals, "column").filter(holds(low) | holds(high)).groupBy("column").agg(at(low).alias("a"), at(high).alias("b"))
    medians = middle.select(F.col("column").alias("__of"), (F.col("a") + (F.col("b") - F.col("a")) / 2).alias("__median"))
    kind = "decimal(38, 6)" if isinstance(df.schema[column].dataType, T.IntegralType) else "double"
    filled = F.coalesce(col(column).cast(kind), F.col("__median").cast(kind))
    return df.join(medians, F.col("__group") == F.col("__of"), "left").select(
        *[filled.alias(c) if c == column else F.col(quoted(c)) for c in df.columns if c != "__group"]
    )


def add_missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_missing``: 1 where the value is missing."""
    df = missing_as_null(df)
    return df.withColumns({f"{c}_missing": col(c).isNull().cast("int") for c in columns})


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of every group of equal rows; copies are combined before the shuffle."""
    return missing_as_null(df).dropDuplicates()


def majority_label(df: DataFrame, id_column: str, target: str) -> DataFrame:
    """``id, label, n``: the commonest label of every identifier, the smaller label on ties.

    Labels are counted first, so an identifier with a third of the rows is as
    cheap as any other.
    """
    counts = (
        missing_as_null(df)
        .filter(col(id_column).isNotNull() & col(target).isNotNull())
        .groupBy(col(id_column).alias("id"), col(target).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("back"), F.col("label").alias("label")))
    return counts.groupBy("id").agg(best.alias("best")).select(
        "id", F.col("best.label").alias("label"), (-F.col("best.back")).alias("n")
    )


def stratified_split(
    df: DataFrame, target: str, key: list[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``split``: in every class ``round(test_share * n)`` rows are ``test``, exactly.

    A row's place in its class comes from a hash of its key, so the split does
    not depend on partitioning. ``key`` should identify a row: rows that share a
    key share a side, and the share is then only as exact as that allows. Rows far from the
    cut are decided by their hash alone. Only the narrow band of hashes around
    the cut is ranked, which is about the square root of the class, so no task
    ever sorts a whole class.
    """
    df = missing_as_null(df).withColumn(
        "__draw", unit_hash([c for k in key for c in (col(k), col(k).isNull())], seed)
    )
    classes = df.groupBy(col(target).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n").cast("double")
    width = F.least(F.lit(1.0), 8.0 / F.sqrt(n) + 8.0 / n)
    classes = classes.withColumns(
        {
            "__want": F.round(F.lit(test_share) * n).cast("bigint"),
            "__low": F.greatest(F.lit(0.0), F.lit(test_share) - width),
            "__high": F.least(F.lit(1.0), F.lit(test_share) + width),
        }
    )
    # one row per class: the optimizer broadcasts it while it is small
    placed = df.join(classes, F.col("__class").eqNullSafe(col(target)))
    sure = (
        placed.filter("__draw < __low")
        .groupBy(F.col("__class").alias("__sc"))
        .agg(F.count(F.lit(1)).alias("__sure"))
    )
    w = Window.partitionBy("__class").orderBy("__draw").rowsBetween(Window.unboundedPreceding, 0)
    # keys that share a hash are one entry, so copies of a key cannot fill a task
    ranked = (
        placed.filter("__draw >= __low and __draw < __high")
        .groupBy("__class", "__want", "__draw")
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__upto", F.sum("__c").over(w))
        .join(sure, F.col("__sc").eqNullSafe(F.col("__class")), "left")
        .withColumn("__place", F.coalesce("__sure", F.lit(0)) + F.col("__upto"))
    )
    last = (
        ranked.filter("__place <= __want")
        .groupBy(F.col("__class").alias("__cc"))
        .agg(F.max("__draw").alias("__cut"))
    )
    out = placed.join(last, F.col("__cc").eqNullSafe(F.col("__class")), "left")
    is_test = (F.col("__draw") < F.col("__low")) | F.coalesce(F.col("__draw") <= F.col("__cut"), F.lit(False))
    columns = [quoted(c) for c in df.columns if c != "__draw"]
    return out.select(*columns, F.when(is_test, "test").otherwise("train").alias("split"))


def stratified_sample(df: DataFrame, target: str, share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of every class, for any number of classes: every row is drawn by its own hash, no shuffle."""
    return sample_share(df.filter(col(target).isNotNull()), share, seed)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Adds ``weight``: rows / (classes * rows of the class); null for rows without a class."""
    counts = class_counts(df, target)
    rows, classes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    table = counts.select(
        F.col("class").alias("__class"), ratio(F.lit(rows or 0), F.lit(classes) * F.col("n")).alias("weight")
    )
    return missing_as_null(df).join(table, col(target) == F.col("__class"), "left").drop("__class")


def group_split(df: DataFrame, key: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` so that rows with equal keys share a side. A projection: no shuffle."""
    draw = unit_hash([c for k in key for c in (col(k), col(k).isNull())], seed)
    return df.withColumn("split", F.when(draw < test_share, "test").otherwise("train"))


def log_clip(df: DataFrame, columns: list[str]) -> DataFrame:
    """``log(1 + max(x, 0))``; nulls stay null."""
    df = missing_as_null(df)
    return df.withColumns(
        {c: F.when(col(c).isNotNull(), F.log1p(F.greatest(col(c).cast("double"), F.lit(0.0)))) for c in columns}
    )


def winsorize(
    df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, settings: Settings = DEFAULTS
) -> DataFrame:
    """Values beyond the exact ``low``/``high`` quantiles are pulled in to them."""
    df = missing_as_null(df)
    values = {c: col(c).cast("double") for c in columns}
    q = quantiles(long_form(df, values), [low, high], count_present(df, values), settings)

    def pulled(c: str) -> Column:
        value, (least, most) = col(c), q[c]
        kind = "double"
        if isinstance(df.schema[c].dataType, T.IntegralType):  # whole numbers stay exact
            kind = df.schema[c].dataType if least == round(least) and most == round(most) else "decimal(38, 6)"
        ends = [F.lit(x).cast(kind) for x in (least, most)]
        kept = value.cast(kind)
        return F.when(kept < ends[0], ends[0]).when(kept > ends[1], ends[1]).otherwise(kept)

    return df.withColumns({c: pulled(c) for c in columns if c in q})


def robust_scale(df: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """``(x - median) / IQR``; null where the IQR is zero."""
    df = missing_as_null(df)
    values = {c: col(c).cast("double") for c in columns}
    q = quantiles(long_form(df, values), [0.25, 0.5, 0.75], count_present(df, values), settings)
    return df.withColumns(
        {c: F.try_divide(col(c).cast("double") - F.lit(v[1]), F.lit(v[2] - v[0])) for c, v in q.items()}
    )


def group_rare_levels(df: DataFrame, column: str, keep: int = 20, other: str = "other") -> DataFrame:
    """All but the ``keep`` commonest levels become ``other`` (nulls too); ties go to the smaller level."""
    top = (
        class_counts(df, column)
        .orderBy(F.desc("n"), "class")
        .limit(keep)
        .select(F.col("class").alias("__level"))
    )
    out = df.join(F.broadcast(top), col(column) == F.col("__level"), "left")  # ``keep`` rows
    label = F.coalesce(F.col("__level").cast("string"), F.lit(other))
    return out.select(
        *[label.alias(c) if c == column else F.col(quoted(c)) for c in df.columns]
    )


def merge_rare_classes(df: DataFrame, target: str, minimum: int = 5, other: str = "other") -> DataFrame:
    """Classes with fewer than ``minimum`` rows become ``other``; nulls stay null.

    The rare classes are looked up with a join on plain columns: the optimizer broadcasts them while they are small, and
    splits a frequent class where they are not.
    """
    rare = class_counts(df, target).filter(F.col("n") < minimum).select(F.col("class").alias("__rare"))
    out = df.join(rare, col(target) == F.col("__rare"), "left")
    label = F.when(F.col("__rare").isNotNull(), F.lit(other)).otherwise(col(target).cast("string"))
    return out.select(*[label.alias(c) if c == target else F.col(quoted(c)) for c in df.columns])


def to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that is a number becomes one, anything else null."""
    return df.withColumns({c: as_number(col(c)) for c in columns})


def strip_units(df: DataFrame, columns: list[str]) -> DataFrame:
    """Units, commas and currency signs are removed before the text becomes a number."""
    return df.withColumns({c: clean_number(col(c)) for c in columns})
