"""What the checks need to know about the columns of a frame before scanning it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import as_number


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name (names may hold dots and spaces)."""
    return F.col(quoted(name))


def physical_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "nested"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: physical_kind(f.dataType) for f in df.schema.fields}


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null, so one test finds every missing value."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    if not floats:
        return df
    return df.withColumns({n: F.when(~F.isnan(col(n)), col(n)) for n in floats})


def numeric(name: str, kind: str) -> Column:
    """A column as double; text goes through the number parser."""
    return as_number(col(name)) if kind == "string" else col(name).cast("double")


def long_form(df: DataFrame, values: dict[str, Column], key: str = "column", value: str = "value",
              keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per (input row, named value); nulls are dropped. Runs as an Expand."""
    keep = keep or {}
    held = [f"__keep_{i}" for i in range(len(keep))]
    wide = df.select(
        *[c.alias(h) for h, c in zip(held, keep.values())], *[c.alias(n) for n, c in values.items()]
    )
    # the names are constants of the Expand's projections: no work per row
    out = wide.unpivot([F.col(h) for h in held], [col(n) for n in values], "__name", "__value")
    return out.filter(F.col("__value").isNotNull()).select(
        *[F.col(h).alias(n) for h, n in zip(held, keep)],
        F.col("__name").alias(key),
        F.col("__value").alias(value),
    )


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
