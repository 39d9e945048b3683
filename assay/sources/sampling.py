"""Repeatable row samples."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import col
from ..operators.duplicates import row_digest
from ..session import checkpoint_folder
from ..settings import DEFAULTS


def unit_hash(columns: list[Column], seed: int) -> Column:
    """A number in [0, 1) that depends on the values and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _draw(df: DataFrame, seed: int, key: list[str] | None) -> Column:
    if key:
        return unit_hash([c for k in key for c in (col(k), col(k).isNull())], seed)
    return unit_hash(row_digest(df), seed)


def least_draws(df: DataFrame, n: int, draw: Column) -> DataFrame:
    """``rows`` and ``draws`` of every task: its row count and its ``n`` smallest draws. They add up: the ``n`` smallest of all are among them.

    Written to the checkpoint folder, so the table is read once, whatever is asked of the draws.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, least = 0, np.zeros(0)
        for batch in batches:
            rows += batch.num_rows
            least = np.concatenate([least, batch.column(0).to_numpy()])
            if len(least) > 2 * n:
                least = np.partition(least, n - 1)[:n]
        if len(least) > n:
            least = np.partition(least, n - 1)[:n]
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([least], pa.list_(pa.float64()))], names=["rows", "draws"])

    path = f"{checkpoint_folder(df.sparkSession)}/draws-{uuid.uuid4().hex}"
    df.select(draw.alias("draw")).mapInArrow(run, "rows bigint, draws array<double>").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cap_rows(
    df: DataFrame, n: int | None = None, seed: int = 42, key: list[str] | None = None
) -> tuple[DataFrame, bool, int]:
    """``(frame, sampled, rows before)``: at most ``n`` rows, the same ones for any partitioning.

    Rows are drawn by a hash of their key (by default all columns). One read of the table leaves every task's row count and smallest
    draws; the exact ``n``-th draw is found among those that can be it, and a filter keeps what lies up to it: rows are neither
    sorted nor shuffled. Rows that share the last draw are alike; only where some of them are left out, as many as are wanted are
    taken by a filter of their own. The frame reads the table anew at every use: checkpoint it to use it more than once.
    """
    from ..operators.order_stats import order_statistics

    n = n if n is not None else DEFAULTS.row_cap
    draw = _draw(df, seed, key)
    if n <= 0:
        total = df.count()
        return df.limit(0), total > 0, total
    tasks = least_draws(df, n + 1, draw)  # one more than is wanted: it tells whether rows that share the last draw are left out
    total = tasks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if total <= n:
        return df, False, total
    draws = tasks.select(F.lit("draw").alias("column"), F.explode("draws").alias("value"))
    share = (n + 8 * math.sqrt(n) + 100) / total  # leaves about n of the tasks' draws
    while True:
        near = draws.where(F.col("value") < share)
        found = near.count()
        if share >= 1.0 or found >= n:
            break
        share = min(1.0, share * 2)
    last = order_statistics(near, {"draw": [(n - 1, n - 1)]}, {"draw": found})[("draw", n - 1)]
    ahead, upto = near.agg(F.count_if(F.col("value") < last), F.count_if(F.col("value") <= last)).first()
    drawn = df.withColumn("__draw", draw)
    if upto == n:
        kept = drawn.filter(F.col("__draw") <= last)
    else:
        rest = drawn.filter(F.col("__draw") == last).limit(n - ahead)
        kept = drawn.filter(F.col("__draw") < last).unionByName(rest)
    return kept.drop("__draw"), True, total


def sample_share(df: DataFrame, share: float, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """About ``share`` of the rows by hash: one filter, no shuffle, the same for any partitioning."""
    return df.filter(_draw(df, seed, key) < share)
