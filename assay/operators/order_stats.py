"""Exact order statistics (quantiles, medians, MAD) for any number of rows.

Small inputs are ranked directly. Larger ones are narrowed first: approximate
percentiles bracket each wanted rank, one aggregate counts the rows below and
inside every bracket, and only the values inside - grouped, so that copies cost
nothing - are ranked. Brackets that turn out not to hold their rank are widened,
so the answer is exact whatever the sketches say.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .columns import chunks, long_form

ACCURACY = 10_000


@dataclass
class _Want:
    key: str
    first: int  # zero-based positions in the sorted values: this one
    last: int  # and this one, the same or the next
    low: float
    high: float
    below: int = 0
    inside: int = 0
    distinct: float = math.inf  # values in the bracket, where they were counted


def counts_by_key(long: DataFrame) -> dict[str, int]:
    """Rows per key of a long frame ``column, value``; one row per key reaches the driver."""
    return {r["column"]: r["n"] for r in long.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def count_present(df: DataFrame, columns: dict[str, Column], settings: Settings = DEFAULTS) -> dict[str, int]:
    """Present values per column: plain aggregates, one row per task is shuffled."""
    out: dict[str, int] = {}
    for part in chunks(list(columns.items()), settings.pairs_per_aggregate):
        row = df.agg(*[F.count(v).alias(f"n{i}") for i, (_, v) in enumerate(part)]).first()
        out.update({c: row[f"n{i}"] for i, (c, _) in enumerate(part)})
    return out


def order_statistics(
    long: DataFrame,
    wanted: dict[str, list[tuple[int, int]]],
    counts: dict[str, int],
    settings: Settings = DEFAULTS,
    distinct: dict[str, int] | None = None,
) -> dict[tuple[str, int], float]:
    """Values at zero-based ranks, per key of a long frame ``column STRING, value DOUBLE``.

    Ranks are asked for as (rank, same or next rank). ``distinct`` gives known
    bounds on the distinct values of a key: few distinct values are ranked
    directly, however many rows there are.
    """
    wants = [
        _Want(key, first, last, -math.inf, math.inf, 0, counts[key])
        for key, spans in wanted.items()
        for first, last in sorted(set(spans))
    ]
    if not wants:
        return {}
    limit, known = settings.exact_in_one_pass, distinct or {}
    step = 2.0 / ACCURACY
    while wide := [w for w in wants if min(w.inside, w.distinct, known.get(w.key, w.inside)) > limit and w.low < w.high]:
        before = [w.inside for w in wide]
        _narrow(long, wide, step)
        if stuck := [w for w, n in zip(wide, before) if w.inside == n and w.low < w.high]:
            if step >= 0.5:
                break
            _count_distinct(long, stuck)  # few values that many rows share are ranked as they are, instead of asked for again
            step *= 4  # else a sketch missed a rank: ask for a wider bracket
    return _pick(long, wants)


def _narrow(long: DataFrame, wants: list[_Want], step: float) -> None:
    """Shrink every bracket around its rank with percentiles of the values inside it, ``step`` to either side."""
    spark = long.sparkSession
    brackets = sorted({(w.key, w.low, w.high) for w in wants})
    place_of = {b: i for i, b in enumerate(brackets)}
    now = spark.createDataFrame(
        [(k, i, lo, hi) for i, (k, lo, hi) in enumerate(brackets)],
        "column string, bracket int, low double, high double",
    )
    # the bracket tables hold at most one row per wanted rank
    inside = long.join(F.broadcast(now), "column").filter("value >= low and value <= high")
    share = [(w.first - w.below) / max(w.inside - 1, 1) for w in wants]
    asked = sorted({min(1.0, max(0.0, s + d)) for s in share for d in (-step, step)})
    rows = inside.groupBy("bracket").agg(F.percentile_approx("value", asked, ACCURACY).alias("at")).collect()
    found = {r["bracket"]: dict(zip(asked, r["at"])) for r in rows}
    proposals = {}
    for i, w in enumerate(wants):
        at = found[place_of[(w.key, w.low, w.high)]]
        low_at, high_at = max(0.0, share[i] - step), min(1.0, share[i] + step)
        low = w.low if low_at == 0.0 else at[low_at]
        high = w.high if high_at == 1.0 else at[high_at]
        proposals[i] = (max(low, w.low), min(high, w.high))
    tried = spark.createDataFrame(
        [(wants[i].key, i, lo, hi) for i, (lo, hi) in proposals.items()],
        "column string, want int, low double, high double",
    )
    counted = (
        long.join(F.broadcast(tried), "column")
        .groupBy("want")
        .agg(
            F.count_if(F.col("value") < F.col("low")).alias("below"),
            F.count_if(F.col("value").between(F.col("low"), F.col("high"))).alias("inside"),
        )
        .collect()
    )
    for r in counted:
        w = wants[r["want"]]
        lo, hi = proposals[r["want"]]
        if r["below"] <= w.first and w.last < r["below"] + r["inside"]:
            w.low, w.high, w.below, w.inside = lo, hi, r["below"], r["inside"]
        # else: the sketch missed; the old, wider bracket stays


def _count_distinct(long: DataFrame, wants: list[_Want]) -> None:
    """About how many values the brackets hold."""
    brackets = sorted({(w.key, w.low, w.high) for w in wants})
    table = long.sparkSession.createDataFrame(
        [(k, i, lo, hi) for i, (k, lo, hi) in enumerate(brackets)], "column string, bracket int, low double, high double")
    inside = long.join(F.broadcast(table), "column").filter("value >= low and value <= high")
    found = {brackets[r["bracket"]]: r["n"] for r in inside.groupBy("bracket").agg(F.approx_count_distinct("value").alias("n")).collect()}
    for w in wants:
        w.distinct = found[(w.key, w.low, w.high)]


def _pick(long: DataFrame, wants: list[_Want]) -> dict[tuple[str, int], float]:
    """Rank the values inside the brackets; equal brackets of a key are ranked once."""
    out = {(w.key, r): w.low for w in wants if w.low == w.high for r in (w.first, w.last)}
    open_wants = [w for w in wants if w.low < w.high]
    groups: dict[tuple[str, float, float], list[_Want]] = {}
    for w in open_wants:
        groups.setdefault((w.key, w.low, w.high), []).append(w)
    if not groups:
        return out
    spark = long.sparkSession
    heads = list(groups)
    if all(lo == -math.inf and hi == math.inf for _, lo, hi in heads):
        return out | _pick_whole(long, heads, groups)
    table = spark.createDataFrame(
        [(k, i, lo, hi, groups[(k, lo, hi)][0].below,
          sorted({r for w in groups[(k, lo, hi)] for r in (w.first, w.last)}))
         for i, (k, lo, hi) in enumerate(heads)],
        "column string, bracket int, low double, high double, below bigint, ranks array<bigint>",
    )
    values = (
        long.join(F.broadcast(table.select("column", "bracket", "low", "high")), "column")
        .filter("value >= low and value <= high")
        .groupBy("bracket", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("upto", F.sum("n").over(w)).join(
        F.broadcast(table.select("bracket", "below", "ranks")), "bracket"
    )
    first = F.col("below") + F.col("upto") - F.col("n")
    hits = ranked.select(
        "bracket", "value",
        F.explode(F.filter("ranks", lambda r: (r >= first) & (r < F.col("below") + F.col("upto")))).alias("rank"),
    )
    for r in hits.collect():  # one row per wanted rank
        out[(heads[r["bracket"]][0], r["rank"])] = r["value"]
    return out


def _pick_whole(long: DataFrame, heads: list, groups: dict) -> dict[tuple[str, int], float]:
    """The same without brackets: every key's distinct values are ranked."""
    wanted = {k: sorted({r for w in groups[(k, lo, hi)] for r in (w.first, w.last)}) for k, lo, hi in heads}
    table = long.sparkSession.createDataFrame(list(wanted.items()), "column string, ranks array<bigint>")
    w = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(w))
    first = F.col("upto") - F.col("n")
    hits = values.join(F.broadcast(table), "column").select(  # one row per key
        "column", "value", F.explode(F.filter("ranks", lambda r: (r >= first) & (r < F.col("upto")))).alias("rank")
    )
    return {(r["column"], r["rank"]): r["value"] for r in hits.collect()}


def _places(p: float, n: int) -> tuple[int, int, float]:
    h = (n - 1) * p
    k = math.floor(h)
    return k, min(k + 1, n - 1), h - k


def quantiles(
    long: DataFrame,
    probabilities: list[float],
    counts: dict[str, int] | None = None,
    settings: Settings = DEFAULTS,
    distinct: dict[str, int] | None = None,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per key of a long frame ``column, value``."""
    counts = counts if counts is not None else counts_by_key(long)
    counts = {k: n for k, n in counts.items() if n > 0}
    wanted = {k: [_places(p, n)[:2] for p in probabilities] for k, n in counts.items()}
    at = order_statistics(long, wanted, counts, settings, distinct)
    out = {}
    for key, n in counts.items():
        values = []
        for p in probabilities:
            k, k1, f = _places(p, n)
            a, b = at[(key, k)], at[(key, k1)]
            values.append(a if a == b else a + (b - a) * f)
        out[key] = values
    return out


def equal_count_edges(
    long: DataFrame,
    bins: int,
    counts: dict[str, int],
    settings: Settings = DEFAULTS,
    distinct: dict[str, int] | None = None,
) -> dict[str, list[float]]:
    """Inner edges that cut each key's values into bins of about equal counts.

    Edges are values of the data, the ones at positions ``ceil(n*i/bins)``, exactly and at any size.
    """
    counts = {k: n for k, n in counts.items() if n > 0}
    ranks = {k: [(n * i + bins - 1) // bins - 1 for i in range(1, bins)] for k, n in counts.items()}
    at = order_statistics(long, {k: [(r, r) for r in rs] for k, rs in ranks.items()}, counts, settings, distinct)
    return {k: sorted({at[(k, r)] for r in rs}) for k, rs in ranks.items()}


def in_bins(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Replaces columns by their bin: the number of edges below the value, found by binary search."""
    flat = {c: F.when(F.col(c).isNotNull(), F.lit(0.0)) for c, e in edges.items() if not e}
    cut = [c for c, e in edges.items() if e]
    if cut:
        # a bin starts at its split, so the split is the next number after the edge
        splits = [[-math.inf, *[math.nextafter(e, math.inf) for e in edges[c]], math.inf] for c in cut]
        marked = [f"{c}__bin" for c in cut]
        finder = Bucketizer(splitsArray=splits, inputCols=cut, outputCols=marked, handleInvalid="keep")
        df = finder.transform(df).withColumns(dict(zip(cut, map(F.col, marked)))).drop(*marked)
    return df.withColumns(flat) if flat else df


def spread(
    df: DataFrame, columns: dict[str, Column], settings: Settings = DEFAULTS, distinct: dict[str, int] | None = None
) -> dict[str, tuple[int, float, float, float, float]]:
    """``n, q1, median, q3, mad`` per column; ``columns`` maps a name to its value as double."""
    counts = count_present(df, columns, settings)
    asked = {c: v for c, v in columns.items() if counts[c]}
    if not asked:
        return {}
    q = quantiles(long_form(df, asked), [0.25, 0.5, 0.75], counts, settings, distinct)
    gaps = long_form(df, {c: F.abs(v - F.lit(q[c][1])) for c, v in asked.items()})
    mad = quantiles(gaps, [0.5], counts, settings, distinct)
    return {c: (counts[c], *q[c], mad[c][0]) for c in asked}
