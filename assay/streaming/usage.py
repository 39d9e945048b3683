"""Aggregates of the usage log while it grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.usage import known_visitor

#: What keyed state with timers and maps needs; set it on the session before a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_event_time(events: DataFrame, time: Column | None = None, delay: str = "10 minutes") -> DataFrame:
    """Adds ``event_time`` and its watermark; late rows beyond ``delay`` are dropped."""
    at = time if time is not None else F.to_timestamp("occurredAt")
    return events.withColumn("event_time", at).withWatermark("event_time", delay)


def streaming_totals(events: DataFrame) -> DataFrame:
    """Running totals for update or complete mode; distinct counts are sketches on a stream."""
    visitor = known_visitor()
    ran = F.col("event") == "analysis_completed"
    return events.groupBy().agg(
        F.approx_count_distinct(visitor, 0.01).alias("uniqueVisitors"),
        F.approx_count_distinct(F.when(ran, visitor), 0.01).alias("uniqueUsers"),
        F.count_if(F.col("event") == "page_view").alias("pageViews"),
        F.count_if(ran).alias("submissions"),
    )


def first_seen_visitors(events: DataFrame) -> DataFrame:
    """Each known visitor once per watermark window. A visitor who returns after the watermark has passed appears again.

    ``events`` must come from ``with_event_time``. State is one key per visitor,
    dropped as the watermark passes; uniques over all time need ``usage_totals`` on the log.
    """
    return (
        events.withColumn("visitor", known_visitor())
        .filter("visitor is not null")
        .dropDuplicatesWithinWatermark(["visitor"])
        .select("visitor", "event_time")
    )


def windowed_activity(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Views and analyses per tumbling window; append mode emits a window once it is final."""
    return (
        events.groupBy(F.window("event_time", window).alias("w"))
        .agg(
            F.count_if(F.col("event") == "page_view").alias("pageViews"),
            F.count_if(F.col("event") == "analysis_completed").alias("submissions"),
            F.approx_count_distinct(known_visitor(), 0.01).alias("visitors"),
        )
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pageViews", "submissions", "visitors")
    )


def streaming_over_limit(events: DataFrame, client: Column, limit: int = 20, window: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Clients over the limit in sliding windows of event time."""
    return (
        events.groupBy(client.alias("client"), F.window("event_time", window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("attempts"))
        .filter(F.col("attempts") > limit)
        .select("client", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "attempts")
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per visitor of a batch, so a busy visitor does not fill one task."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by("visitor").aggregate([("views", "sum"), ("runs", "sum")])
        yield from sums.rename_columns(["visitor", "views", "runs"]).combine_chunks().to_batches()


class _Uniques(StatefulProcessor):
    """Per bucket: every visitor ever seen, and whether there was an analysis."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.visitors = handle.getMapState("visitors", "visitor string", "ran boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = np.zeros(4, np.int64)
        for frame in rows:
            total[2:] += [frame["views"].sum(), frame["runs"].sum()]
            runs = frame[frame["visitor"].notna()].groupby("visitor")["runs"].sum()
            for visitor, ran in (runs > 0).items():
                known = self.visitors.getValue((visitor,)) if self.visitors.containsKey((visitor,)) else None
                if known is None or ran and not known[0]:
                    total += [known is None, ran, 0, 0]
                    self.visitors.updateValue((visitor,), (bool(ran),))
        yield pd.DataFrame([total], columns=["uniqueVisitors", "uniqueUsers", "pageViews", "submissions"])

    def close(self) -> None:
        pass


def streaming_uniques(events: DataFrame, buckets: int = 64) -> DataFrame:
    """What every micro-batch adds to the totals of ``usage_totals``: their sums are exact at any time, for append mode.

    Visitors are kept for good, in hashed buckets on disk; a batch puts out at most one row per bucket. The session needs ``STATE_STORE``.
    """
    rows = events.select(known_visitor().alias("visitor"), (F.col("event") == "page_view").cast("bigint").alias("views"),
                         (F.col("event") == "analysis_completed").cast("bigint").alias("runs"))
    rows = rows.select("visitor", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("runs", F.lit(0)).alias("runs"))
    combined = rows.mapInArrow(_combined, "visitor string, views bigint, runs bigint").withColumn("bucket", F.pmod(F.xxhash64("visitor"), F.lit(buckets)))
    return combined.groupBy("bucket").transformWithStateInPandas(
        _Uniques(), "uniqueVisitors bigint, uniqueUsers bigint, pageViews bigint, submissions bigint", "Append", "None")


class _Trailing(StatefulProcessor):
    """Per bucket of clients: attempts per client and second of the last window. A timer forgets the bucket when the window has passed."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "clients array<string>, seconds array<bigint>, attempts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["client", "second", "attempts"]
        new = pd.concat(list(rows))[names].assign(new=True)
        if self.ring.exists():
            held = pd.DataFrame(dict(zip(names, map(list, self.ring.get()))))
            new = pd.concat([held.assign(new=False), new])
        # clients lie further apart on one line than a window reaches, so one search serves all of them
        second = new["second"].to_numpy(np.int64)
        code = pd.factorize(new["client"], use_na_sentinel=False)[0].astype(np.int64)
        place = code * (second.max() - second.min() + self.window + 1) + second - second.min()
        order = np.argsort(place, kind="stable")
        place, sums = place[order], np.r_[0, np.cumsum(new["attempts"].to_numpy(np.int64)[order])]
        new = new.iloc[order].assign(trailing=sums[1:] - sums[np.searchsorted(place, place - self.window)])
        kept = new[new["second"] > second.max() - self.window - 1]  # later seconds of any client come behind the watermark
        self.ring.update(tuple(kept[c].tolist() for c in names))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(second.max() + self.window + 1) * 1000)
        out = new[new["new"]]
        yield out[[*names, "trailing"]].assign(over_limit=out["trailing"] > self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        return iter(())

    def close(self) -> None:
        pass


def streaming_over_limit_exact(events: DataFrame, client: Column, limit: int = 20, window_seconds: int = 3600, buckets: int = 256) -> DataFrame:
    """``client, second, attempts, trailing, over_limit`` as ``over_limit`` gives them on the whole log, for append mode.

    ``events`` must come from ``with_event_time``. Attempts are counted per client and second first, so a busy client is one row a second;
    a second is put out once the watermark has passed it, in order, with what the client's last window holds. State is one
    window of seconds per client, in hashed buckets that are put out with one call a batch. Clients travel as text. Events later than the watermark's delay are dropped; any other disorder changes nothing. The session
    needs ``STATE_STORE``.
    """
    second = events.groupBy(client.alias("client"), F.window("event_time", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("attempts"))
    rows = second.select("client", F.unix_seconds("w.start").alias("second"), "attempts", F.window_time("w").alias("event_time"))
    kind = rows.schema["client"].dataType.simpleString()
    keyed = rows.withColumns({"bucket": F.pmod(F.xxhash64("client"), F.lit(buckets)), "client": F.col("client").cast("string")})
    found = keyed.groupBy("bucket").transformWithStateInPandas(
        _Trailing(limit, window_seconds), "client string, second bigint, attempts bigint, trailing bigint, over_limit boolean", "Append", "EventTime")
    return found.withColumn("client", F.col("client").cast(kind))
