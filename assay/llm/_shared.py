"""Helpers of the operators: whole tables, written intermediates, words in Spark expressions."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACES = "[\\x20\\x09-\\x0D]+"  # ASCII white space; everything else belongs to a word


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the writes inside are removed when each ends: nothing reads them again."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often and in whatever lambda the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text, in order; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
