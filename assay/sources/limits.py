"""Guards on what is let in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings


class LimitError(ValueError):
    pass


def input_limits(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row: columns, rows, and which guards they break."""
    n_cols = len(df.columns)
    too_wide = settings.max_columns is not None and n_cols > settings.max_columns
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(n_cols).cast("bigint").alias("n_cols"),
        "n_rows",
        F.lit(n_cols == 0).alias("no_columns"),
        F.lit(too_wide).alias("too_many_columns"),
        (F.col("n_rows") == 0).alias("no_rows"),
    )


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a frame; one row per file is aggregated."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
    total = files.groupBy("p").agg(F.max("s").alias("s")).agg(F.sum("s").alias("total")).first()["total"]
    return total or 0


def check_limits(df: DataFrame, settings: Settings = DEFAULTS, need_rows: bool = False) -> None:
    """Raise ``LimitError`` for a table outside the limits. Only schema is looked at by default."""
    n_cols = len(df.columns)
    if n_cols == 0:
        raise LimitError("The table has no columns.")
    if settings.max_columns is not None and n_cols > settings.max_columns:
        raise LimitError(f"{n_cols} columns, {n_cols - settings.max_columns} more than max_columns allows.")
    if settings.max_file_bytes is not None:
        size = file_bytes(df)
        if size > settings.max_file_bytes:
            raise LimitError(f"{size} bytes of files, max_file_bytes is {settings.max_file_bytes}.")
    if need_rows and df.isEmpty():
        raise LimitError("The table has no rows.")
