"""Aggregates of the usage log, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANONYMOUS = "anonymous"


def known_visitor() -> Column:
    v = F.col("anonymousUserId")
    return F.when((v != ANONYMOUS) & (v != ""), v)


def usage_totals(events: DataFrame) -> DataFrame:
    """One row: unique visitors, unique users (visitors with an analysis), page views, submissions.

    Events are combined per visitor first, so the distinct counts need one
    shuffle and a busy visitor is one row per task.
    """
    per_visitor = events.groupBy(known_visitor().alias("visitor")).agg(
        F.count_if(F.col("event") == "page_view").alias("views"),
        F.count_if(F.col("event") == "analysis_completed").alias("runs"),
    )
    return per_visitor.agg(
        F.count("visitor").alias("uniqueVisitors"),
        F.count_if(F.col("visitor").isNotNull() & (F.col("runs") > 0)).alias("uniqueUsers"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("pageViews"),
        F.coalesce(F.sum("runs"), F.lit(0)).alias("submissions"),
    )


def public_threshold(value: Column, minimum: int) -> Column:
    """Rounded up to the next five, at least ``minimum``."""
    return F.greatest(F.lit(minimum).cast("bigint"), F.ceil(value / 5) * 5)


def public_numbers(totals: DataFrame, min_users: int = 5, min_uses: int = 10) -> DataFrame:
    return totals.select(
        public_threshold(F.col("uniqueUsers"), min_users).alias("trustedUsers"),
        public_threshold(F.col("submissions"), min_uses).alias("totalUses"),
    )


def usage_by_source(events: DataFrame) -> DataFrame:
    """Completed analyses per source."""
    return (
        events.filter("event = 'analysis_completed'")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("analyses"))
    )


def over_limit(attempts: DataFrame, client: Column, time: Column, limit: int = 20, window_seconds: int = 3600) -> DataFrame:
    """``client, second, attempts, trailing, over_limit``: attempts in the trailing window per client.

    Attempts are counted per second before anything else, and every client's time
    line is cut into slices of one window length; a slice also sees the slice
    before it. However busy a client is, a task holds at most two windows of
    seconds of it.
    """
    per_second = attempts.groupBy(client.alias("client"), time.alias("second")).agg(F.count(F.lit(1)).alias("attempts"))
    own = F.floor(F.col("second") / window_seconds)
    seen = per_second.withColumn("own", own).withColumn("slice", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy("client", "slice").orderBy("second").rangeBetween(-window_seconds, 0)
    return (
        seen.withColumn("trailing", F.sum("attempts").over(w))
        .filter("own = slice")
        .select("client", "second", "attempts", "trailing", (F.col("trailing") > limit).alias("over_limit"))
    )
