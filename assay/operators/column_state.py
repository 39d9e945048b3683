"""Column statistics as a stored state that adds up.

The state of a slice of a table (a day's files, say) is a small frame of rows per column. States of slices merge by adding, and the
merged state is the one of the whole: a table that grows is profiled from its new files alone. All parts are deterministic:

- ``count``: rows, present values, texts that parse as numbers or dates, characters; ``moment``: least, greatest, sum, sum of squares.
- ``value``: the ``k`` distinct values of the smallest hashes, with their exact rows. Smallest of all are smallest of their slice, so
  nothing is lost by keeping ``k`` each time. With fewer than ``k`` the column is known value by value; with more, their mean rows or the
  k-th hash give the distinct count.
- ``cell``: rows per cell of the hashed values. A value that fills much of a column stands out of its cell.
- ``bucket``: rows per logarithmic bucket of a number, so quantiles have a relative error of ``ACCURACY`` at most.

A state takes two scans: plain aggregates, then tallies that every task adds up in Arrow and writes once, a bounded number of rows per column.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import as_datetime, clean_number, is_number, shorten
from ..session import checkpoint_folder
from ..settings import DEFAULTS, Settings
from .columns import chunks, col, kinds, missing_as_null
from .value_counts import boolean_words

SAMPLE = 4096  # distinct values kept per column
CELLS = 256
ACCURACY = 0.01
ROUGH = 0.05  # error of the count that sets the hash bound of the second scan; twice the values asked for leave room for it
HASHES = 1 << 63
COUNTS = ("n_rows", "n_present", "n_number", "n_clean", "n_date", "length")
LEAST, GREATEST, TOTAL, SQUARES = range(4)
_BASE = math.log((1 + ACCURACY) / (1 - ACCURACY))
_SHIFT = 1 << 20  # of bucket numbers, so that their sign is that of the values
SCHEMA = "ordinal int, column string, physical_type string, kind string, part string, key bigint, text string, n bigint, x double"


def _hash(value: Column, floating: bool) -> Column:
    """63 bits of a value; both zeros are one."""
    return F.shiftrightunsigned(F.xxhash64(F.when(value == 0, F.lit(0.0)).otherwise(value.cast("double")) if floating else value), 1)


def _bucket(x: np.ndarray) -> np.ndarray:
    """Bucket numbers of finite numbers."""
    size = np.abs(x)
    level = np.ceil(np.log(np.where(size > 0, size, 1.0)) / _BASE).astype(np.int64) + _SHIFT
    return np.where(size > 0, np.where(x > 0, level, -level), 0)


def _bound(rough: int, k: int) -> int:
    """Greatest hash of a value that is tallied by itself: about 2 k values, all of a column that has fewer."""
    return min(HASHES - 1, int(HASHES * 2 * k / max(rough, 1)))


def _parsed(text: Column, n: Column | None = None) -> dict[str, Column]:
    """Aggregates by name of COUNTS: texts that parse as numbers, as numbers after cleaning and as dates; ``n`` rows each."""
    rules = {"n_number": is_number(text), "n_clean": clean_number(text).isNotNull(), "n_date": as_datetime(text).isNotNull()}
    return {name: F.count_if(rule) if n is None else F.coalesce(F.sum(F.when(rule, n)), F.lit(0)) for name, rule in rules.items()}


def _added(tallies: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tallies).group_by("key").aggregate([("n", "sum"), ("value", "min")])
    return found.select(["key", "n_sum", "value_min"]).rename_columns(["key", "n", "value"])


def _tallies(slots: list[tuple[str, bool]], place: dict[str, int]):
    """Rows per cell, bucket and small-hash value of every column, added up within a task: its output is bounded per column.

    ``slots`` tells which columns are numbers, ``place`` which value column of the output they fill.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {s: np.zeros(CELLS, np.int64) for s, _ in slots}
        held: dict[tuple[str, str], list[pa.Table]] = {}
        for batch in batches:
            columns = iter(batch.columns)
            for s, number in slots:
                h, value = next(columns), next(columns)
                cells[s] += np.bincount(h.drop_null().to_numpy() & (CELLS - 1), minlength=CELLS)
                near = value.is_valid()
                new = {"value": (h.filter(near), value.filter(near))}
                if number:
                    x = next(columns).drop_null().to_numpy()
                    key = _bucket(x[np.isfinite(x)])
                    new["bucket"] = (key, pa.nulls(len(key), pa.null()))
                for part, (key, shown) in new.items():
                    if len(key):
                        parts = held.setdefault((s, part), [])
                        parts.append(_added([pa.table({"key": key, "n": np.ones(len(key), np.int64), "value": shown})]))
                        if len(parts) > 32:
                            held[s, part] = [_added(parts)]
        kinds_of = [None] * (1 + max(place.values()))
        for (s, part), parts in held.items():
            if part == "value":
                kinds_of[place[s]] = parts[0].column("value").type
        kinds_of = [t or pa.null() for t in kinds_of]
        for s, _ in slots:
            seen = np.flatnonzero(cells[s])
            done = {"cell": pa.table({"key": seen, "n": cells[s][seen], "value": pa.nulls(len(seen))})}
            done |= {part: _added(held[s, part]) for part in ("bucket", "value") if (s, part) in held}
            for part, t in done.items():
                shown = [t.column("value") if part == "value" and j == place[s] else pa.nulls(len(t), kind) for j, kind in enumerate(kinds_of)]
                own = [pa.array([x] * len(t), pa.string()) for x in (s, part)]
                rows = pa.table([*own, t.column("key"), t.column("n"), *shown], names=["slot", "part", "key", "n", *[f"v{j}" for j in range(len(shown))]])
                yield from rows.combine_chunks().to_batches()

    return run


def column_state(df: DataFrame, settings: Settings = DEFAULTS, k: int = SAMPLE) -> DataFrame:
    """The state of a frame, as ``SCHEMA``."""
    df = missing_as_null(df)
    spark, kind = df.sparkSession, kinds(df)
    fields = list(enumerate(df.schema.fields))
    rows, rough = [], {}
    for part in chunks(fields, settings.columns_per_aggregate):
        sums: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
        for i, f in part:
            c = col(f.name)
            sums.append(F.count(c).alias(f"n_present{i}"))
            if kind[f.name] == "string":
                sums.append(F.sum(F.length(c).cast("bigint")).alias(f"length{i}"))
            if kind[f.name] == "number":
                x = c.cast("double")
                sums += [F.min(x).alias(f"x{LEAST}_{i}"), F.max(x).alias(f"x{GREATEST}_{i}"), F.sum(x).alias(f"x{TOTAL}_{i}"), F.sum(x * x).alias(f"x{SQUARES}_{i}")]
            if kind[f.name] != "nested":
                sums.append(F.approx_count_distinct(c, ROUGH).alias(f"rough{i}"))
        found = df.agg(*sums).first().asDict()
        # texts of a column with many values are parsed where they stand, others once per value, from the tallies
        many = [(i, f) for i, f in part if kind[f.name] == "string" and _bound(found[f"rough{i}"], k) < HASHES - 1]
        if many:
            found |= df.agg(*[p.alias(f"{name}{i}") for i, f in many for name, p in _parsed(col(f.name)).items()]).first().asDict()
        for i, f in part:
            of = (i, f.name, f.dataType.simpleString(), kind[f.name])
            rough[i] = found.get(f"rough{i}")
            for key, name in enumerate(COUNTS):
                value = found["n_rows"] if not key else found.get(f"{name}{i}")
                if value is not None or key < 2:
                    rows.append((*of, "count", key, None, value or 0, None))
            rows += [(*of, "moment", key, None, None, found[f"x{key}_{i}"]) for key in range(4) if found.get(f"x{key}_{i}") is not None]
    counts = spark.createDataFrame(rows, SCHEMA)
    wide, slots, types = [], [], {}
    for i, f in fields:
        if rough[i] is None:
            continue
        c, floating = col(f.name), f.dataType.typeName() in ("float", "double")
        h = _hash(c, floating)
        bound = _bound(rough[i], k)
        types[str(i)] = "string" if kind[f.name] == "string" else f.dataType.simpleString()
        slots.append((str(i), kind[f.name] == "number"))
        # few and short expressions: texts and buckets are made of what is left, as one long generated method is not compiled
        wide += [F.when(c.isNotNull(), h).alias(f"h{i}"), F.when(h <= bound, c + F.lit(0.0).cast(f.dataType) if floating else c).alias(f"v{i}")]
        wide += [c.cast("double").alias(f"x{i}")] if kind[f.name] == "number" else []
    if not wide:
        return counts
    path = f"{checkpoint_folder(spark)}/tallies-{uuid.uuid4().hex}"
    place = {t: j for j, t in enumerate(sorted(set(types.values())))}
    values = "".join(f", v{j} {t}" for t, j in place.items())
    # the table is read once, whatever is asked of the tallies
    df.select(*wide).mapInArrow(_tallies(slots, {s: place[t] for s, t in types.items()}), f"slot string, part string, key bigint, n bigint{values}").write.parquet(path)
    text = F.coalesce(*[shorten(F.col(f"v{j}").cast("string")) for j in place.values()])
    written = spark.read.parquet(path)
    tallied = written.groupBy("slot", "part", "key").agg(F.min(text).alias("text"), F.sum("n").alias("n"))
    few = [str(i) for i, f in fields if kind[f.name] == "string" and _bound(rough[i], k) == HASHES - 1]
    if few:
        by_value = written.where((F.col("part") == "value") & F.col("slot").isin(few)).groupBy("slot", F.col(f"v{place['string']}").alias("text")).agg(F.sum("n").alias("n"))
        parsed = {r["slot"]: r for r in by_value.groupBy("slot").agg(*[p.alias(name) for name, p in _parsed(F.col("text"), F.col("n")).items()]).collect()}
        rows = [(i, f.name, f.dataType.simpleString(), kind[f.name], "count", key, None, parsed[str(i)][name] if str(i) in parsed else 0, None)
                for i, f in fields if str(i) in few for key, name in enumerate(COUNTS) if name in ("n_number", "n_clean", "n_date")]
        counts = counts.unionByName(spark.createDataFrame(rows, SCHEMA))
    names = spark.createDataFrame([(str(i), i, f.name, f.dataType.simpleString(), kind[f.name]) for i, f in fields], "slot string, ordinal int, column string, physical_type string, kind string")
    found = tallied.join(F.broadcast(names), "slot").select("ordinal", "column", "physical_type", "kind", "part", "key", "text", "n", F.lit(None).cast("double").alias("x"))
    return counts.unionByName(_smallest(found, k))


def _smallest(state: DataFrame, k: int) -> DataFrame:
    """The ``k`` values of the smallest hashes of every column, and all other rows."""
    order = Window.partitionBy("column").orderBy("key")
    values = state.where("part = 'value'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")
    return state.where("part <> 'value'").unionByName(values)


def merged_state(states: DataFrame, k: int = SAMPLE) -> DataFrame:
    """One state out of the rows of many: columns go by name, and one that a slice lacks counts as null there."""
    added = states.groupBy("column", "part", "key").agg(
        F.min("ordinal").alias("ordinal"), F.max("physical_type").alias("physical_type"), F.max("kind").alias("kind"), F.min("text").alias("text"),
        F.sum("n").alias("n"),
        F.when((F.first("part") == "moment") & (F.first("key") == LEAST), F.min("x")).when((F.first("part") == "moment") & (F.first("key") == GREATEST), F.max("x"))
        .otherwise(F.sum("x")).alias("x"))
    return _smallest(added.select("ordinal", "column", "physical_type", "kind", "part", "key", "text", "n", "x"), k)


def save_state(state: DataFrame, path: str, slice_name: str) -> None:
    """Adds the state of one slice to a folder; the slice's own state is replaced if it is there already."""
    state.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/slice={slice_name}")  # bounded per column


def read_state(spark: SparkSession, path: str, k: int = SAMPLE) -> DataFrame:
    """The merged state of all slices of a folder."""
    return merged_state(spark.read.schema(SCHEMA).parquet(f"{path.rstrip('/')}/slice=*"), k)


def summary(state: DataFrame, k: int = SAMPLE) -> DataFrame:
    """One row per column: the counts, ``n_unique``, its standard deviation ``slack`` (0: exact), ``top_count``, ``is_boolean``, ``sample_values``."""
    count = lambda key: F.max(F.when((F.col("part") == "count") & (F.col("key") == key), F.col("n")))
    valued = F.col("part") == "value"
    held = F.when(valued, F.col("n"))
    columns = state.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"), F.max("physical_type").alias("physical_type"), F.max("kind").alias("kind"),
        *[count(key).alias(name) for key, name in enumerate(COUNTS)],
        F.count(held).alias("seen"), F.max(F.when(valued, F.col("key"))).alias("last"), F.avg(held).alias("mean"), F.stddev_pop(held).alias("spread"),
        F.max(held).alias("held"), F.max(F.when(F.col("part") == "cell", F.col("n"))).alias("cell"),
        F.slice(F.sort_array(F.collect_set(F.when(valued, F.col("text")))), 1, 3).alias("sample_values"))
    words = state.where(valued).groupBy(F.col("column").alias("of")).agg(boolean_words(F.lower(F.trim("text"))).alias("words"))
    whole = F.col("seen") < k
    varied = F.col("spread") / F.col("mean")
    by_hash = (k - 1) / (F.col("last") / float(HASHES))
    guess = F.when(varied < 1, F.col("n_present") / F.col("mean")).otherwise(by_hash)
    guess = F.greatest(F.least(F.round(guess).cast("bigint"), "n_present"), "seen")
    top = F.greatest(F.round((CELLS * F.col("cell") - F.col("n_present")) / (CELLS - 1)).cast("bigint"), "held")
    table_rows = F.max("n_rows").over(Window.partitionBy(F.lit(1)))  # one row per column
    flat = F.col("kind") != "nested"
    return columns.join(words, F.col("column") == F.col("of"), "left").select(
        "ordinal", "column", "physical_type", "kind", table_rows.alias("n_rows"), *COUNTS[1:],
        F.when(flat, F.when(whole, F.col("seen")).otherwise(guess)).alias("n_unique"),
        F.when(whole | ~flat, 0.0).otherwise(F.least(varied, F.lit(1.0)) / math.sqrt(k) * guess).alias("slack"),
        F.when(flat & (F.col("seen") > 0), F.when(whole, F.col("held")).otherwise(top)).alias("top_count"),
        (whole & F.coalesce("words", F.lit(False))).alias("is_boolean"), F.when(F.size("sample_values") > 0, F.col("sample_values")).alias("sample_values"))


def moments(state: DataFrame) -> DataFrame:
    """``column, n, least, greatest, mean, deviation`` of the number columns."""
    x = lambda key: F.max(F.when((F.col("part") == "moment") & (F.col("key") == key), F.col("x")))
    n = F.max(F.when((F.col("part") == "count") & (F.col("key") == 1), F.col("n")))
    sums = state.where("kind = 'number'").groupBy("column").agg(n.alias("n"), *[x(key).alias(name) for key, name in enumerate(("least", "greatest", "total", "squares"))])
    spread = F.greatest(F.col("squares") - F.col("total") * F.col("total") / F.col("n"), F.lit(0.0))
    return sums.select("column", "n", "least", "greatest", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"),
                       F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("deviation"))


def quantiles(state: DataFrame, shares: list[float]) -> DataFrame:
    """``column, share, value`` of the number columns: the value of rank ``floor(share * (n - 1))`` to ``ACCURACY``."""
    buckets = state.where("part = 'bucket'")
    order = Window.partitionBy("column").orderBy("key")
    known = buckets.select("column", "key", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("column")).alias("n"))
    level = F.abs("key") - _SHIFT
    value = F.when(F.col("key") == 0, 0.0).otherwise(F.signum("key") * F.exp(level * _BASE) * (1 - ACCURACY))
    asked = known.select("column", "upto", value.alias("value"), "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    return asked.where(F.col("upto") > F.floor(F.col("share") * (F.col("n") - 1))).groupBy("column", "share").agg(F.min_by("value", "upto").alias("value"))
