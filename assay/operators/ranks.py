"""Positions of values in their column's sort order, without one task holding a column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from ..settings import DEFAULTS, Settings


def cumulative(values: DataFrame, rows: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``below`` (rows with a smaller value) and ``code`` (smaller distinct values).

    ``values`` holds ``column, value, n`` with one row per distinct value; other
    columns are kept. Up to
    ``exact_in_one_pass`` distinct values are ranked by one window per column.
    Beyond that the values are cut into sorted ranges, each range is ranked by
    itself, and the totals of the ranges before it are added. The ranges are
    written to the checkpoint folder first, so a lost executor cannot move a
    value to another range.
    """
    keys, given = ["column"], values.columns
    if rows is None or rows > settings.exact_in_one_pass:
        checkpoint_folder(values.sparkSession)
        if rows is None:
            values = values.checkpoint()
            rows = values.count()
        if rows > settings.exact_in_one_pass:
            ranges = math.ceil(4 * rows / settings.exact_in_one_pass)
            cut = values.repartitionByRange(ranges, "column", "value")
            values = cut.withColumn("range", F.spark_partition_id()).checkpoint()
            totals = values.groupBy("column", "range").agg(F.sum("n").alias("rn"), F.count(F.lit(1)).alias("rc"))
            before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
            # only a column that goes on from the range before has something ahead of it: one row per range at most, however many columns
            offsets = totals.select("column", "range", F.sum("rn").over(before).alias("n0"), F.sum("rc").over(before).alias("c0")).where("n0 > 0")
            values = values.join(offsets, ["column", "range"], "left")
            keys.append("range")
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum("n").over(w) - F.col("n")
    code = F.count(F.lit(1)).over(w) - 1
    if "range" in keys:
        below, code = below + F.coalesce("n0", F.lit(0)), code + F.coalesce("c0", F.lit(0))
    return values.select(*given, below.alias("below"), code.alias("code"))


def cumulative_counts(values: DataFrame, key: str, counts: list[str], rows: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``below_<c>`` for every count column: its sum over smaller keys. ``values`` has one row per distinct key.

    All counts are summed in one pass. Beyond ``exact_in_one_pass`` keys they are cut into sorted ranges, written to the checkpoint folder,
    summed range by range, and the totals of the ranges ahead, one row each, are added.
    """
    w = Window.orderBy(key)
    if rows > settings.exact_in_one_pass:
        checkpoint_folder(values.sparkSession)
        ranges = math.ceil(4 * rows / settings.exact_in_one_pass)
        values = values.repartitionByRange(ranges, key).withColumn("__range", F.spark_partition_id()).checkpoint()
        ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        totals = values.groupBy("__range").agg(*[F.sum(c).alias(c) for c in counts])
        offsets = totals.select("__range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__ahead_{c}") for c in counts])
        values = values.join(F.broadcast(offsets), "__range")  # one row per range
        w = Window.partitionBy("__range").orderBy(key)
    own = w.rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.col(f"__ahead_{c}") if rows > settings.exact_in_one_pass else F.lit(0)
    added = values.withColumns({f"below_{c}": F.coalesce(F.sum(c).over(own), F.lit(0)) + base(c) for c in counts})
    return added.drop("__range", *[f"__ahead_{c}" for c in counts])


def average_rank():
    """The rank ties share: the mean of the positions they fill."""
    return F.col("below") + (F.col("n") + 1) / 2
