"""Records of large quoted text files, cut by many tasks at once.

A quoted value may hold line breaks, so where a line stands is known only after everything before it. A line's effect is small,
though: it maps "begins outside a quoted value" and "begins inside one" to where it ends. Every split of a file works out that map for
itself, from both starts; combining the maps of a file's splits in order, one row a split, gives the true start of each. Then every
split cuts its own records, and the few that cross a split are put together from their fragments.

A quote opens a value only as its first character, two quotes inside are one, and a quote before anything else but the separator
or the line's end leaves the value unquoted from there, as the CSV parser has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, SEPARATOR = '"', ","
OPENS, LITERAL, INSIDE, CLOSING = range(4)  # what the next quote does: opens a value, is text, ends the value or escapes, escapes
STAYS, OUT, IN = 2, 0, 3  # effects of a line as two bits: does it end inside, from outside (bit 0) and from inside (bit 1)
WHOLE, HEAD, TAIL, MIDDLE = range(4)
SPLITS = {"spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"}


@contextmanager
def steady_splits(spark: SparkSession, tasks: int | None = None):
    """Files are cut alike by all scans inside, whatever executors come and go; with ``tasks``, into about that many splits at least."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}
    parts = tasks or int(before["spark.sql.files.minPartitionNum"] or spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.files.minPartitionNum", parts)
    if tasks:
        spark.conf.set("spark.sql.files.openCostInBytes", 1 << 12)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def physical_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file``, ``split`` (its first byte) and ``line`` (text up to a line feed), in order within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _bytewise(line: Column) -> Column:
    """A character per byte: the encoding is not known yet, and functions on characters would step over bytes of a broken one."""
    return F.decode(line.cast("binary"), "ISO-8859-1")


def effect(line: Column) -> Column:
    """Where a line ends from either start, as two bits. The text between quotes is folded, so the cost follows the quotes."""
    table = []
    for outside in range(4):
        for inside in range(4):
            for kind in range(3):  # the text ends with the separator, is empty, or neither
                after = [INSIDE if s in (OPENS, CLOSING) else (OPENS, LITERAL if s == LITERAL else CLOSING, LITERAL)[kind] for s in (outside, inside)]
                table.append(4 * after[0] + after[1])
    moves = F.array(*[F.lit(x) for x in table])
    kind = lambda text: F.when(text.endswith(SEPARATOR), 0).when(text == "", 1).otherwise(2)
    parts = F.split(_bytewise(line), QUOTE)
    first = F.when(kind(parts[0]) == 2, 4 * LITERAL + INSIDE).otherwise(4 * OPENS + INSIDE)
    end = F.aggregate(F.slice(parts, 2, 1 << 30), first, lambda at, text: F.get(moves, 3 * at + kind(text)))
    bits = F.when(end >= 4 * CLOSING, 0).when(end >= 4 * INSIDE, 1).otherwise(0) + F.when(end % 4 == INSIDE, 2).otherwise(0)
    return F.when(line.contains(QUOTE), bits).otherwise(STAYS).cast("tinyint")


def combined(effects: np.ndarray) -> int:
    """The effect of lines one after another: the last that forgets its start, then one turn per swap behind it."""
    fixed = np.flatnonzero((effects == OUT) | (effects == IN))
    turns = int((effects[fixed[-1] + 1 if len(fixed) else 0:] == 1).sum()) & 1
    return (IN - int(effects[fixed[-1]]) if turns else int(effects[fixed[-1]])) if len(fixed) else (1 if turns else STAYS)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Rows of one split within a batch: its key and the rows' bounds."""
    file, split = (batch.column(k).to_numpy() for k in (0, 1))
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
        if b > a:
            yield (int(file[a]), int(split[a])), a, b


def split_effects(lines: DataFrame) -> DataFrame:
    """One row per split: ``effect``, ``lines``, ``valid`` (all of it is UTF-8) and ``returns`` (some line holds a carriage return before its end)."""
    narrow = lines.select("file", "split", effect(F.col("line")).alias("effect"), F.is_valid_utf8("line").alias("valid"),
                          F.when(F.col("line").contains("\r"), F.rtrim(_bytewise(F.col("line")), F.lit("\r")).contains("\r")).otherwise(False).alias("returns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            effects, valid, returns = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
            for key, a, b in _runs(batch):
                own = found.setdefault(key, [STAYS, 0, True, False])
                own[0] = combined(np.r_[own[0], effects[a:b]])
                own[1] += b - a
                own[2] = own[2] and bool(valid[a:b].all())
                own[3] = own[3] or bool(returns[a:b].any())
        rows = [[*key, *own] for key, own in found.items()]
        kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "split", "effect", "lines", "valid", "returns"])

    return narrow.mapInArrow(run, "file long, split long, effect tinyint, lines long, valid boolean, returns boolean")


def split_starts(effects: DataFrame) -> DataFrame:
    """``file``, ``split``, ``inside``: where every split really starts. One row per split; a file starts outside."""
    order = Window.partitionBy("file").orderBy("split")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.count_if(F.col("effect") == 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fixed = F.when(F.col("effect").isin(OUT, IN), F.struct((F.col("effect") == IN).cast("int").alias("end"), F.col("turns").alias("turns")))
    seen = effects.withColumn("turns", turns).select("file", "split", F.last(fixed, ignorenulls=True).over(ahead).alias("fixed"), F.lag("turns", 1, 0).over(order).alias("turns"))
    since = F.col("turns") - F.coalesce("fixed.turns", F.lit(0))
    return seen.select("file", "split", ((F.coalesce("fixed.end", F.lit(0)) + since) % 2 == 1).alias("inside"))


def cut(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``file``, ``split``, ``kind``, ``first`` and ``record`` (bytes, without the last line feed): the records inside each split, and
    fragments of those that cross its ends. ``first`` marks a file's first record.

    ``starts`` is broadcast: some 20 bytes for each split of a scan, that is for 128 MB of input.
    """
    known = lines.join(F.broadcast(starts), ["file", "split"], "left")
    rows = known.select("file", "split", F.col("line").cast("binary").alias("line"), effect(F.col("line")).alias("effect"), "inside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], list] = {}  # of the split at hand: inside, open fragment, its kind, records seen
        for batch in batches:
            column, effects = batch.column(2), batch.column(3).to_numpy()
            out: list[tuple] = []
            for key, a, b in _runs(batch):
                if key not in state:
                    yield from _ended(state)
                    inside = batch.column(4)[a].as_py()
                    if inside is None:
                        raise RuntimeError("the scan was split in another way than before; read again")
                    state[key] = [inside, [], MIDDLE if inside else WHOLE, 0]
                own = state[key]
                starts_at = ends_inside(effects[a:b], own[0])
                before = np.r_[own[0], starts_at[:-1]]
                own[0] = bool(starts_at[-1])
                begin = np.flatnonzero(~before.astype(bool)) + a  # lines that begin a record
                pieces = column.slice(a, b - a).to_pylist()
                bounds = [*(begin - a).tolist(), b - a]
                if bounds[0] > 0:  # the rest of what is open
                    own[1] += pieces[:bounds[0]]
                for p, q in zip(bounds, bounds[1:]):
                    if own[1]:
                        out.append((*key, HEAD if own[2] == MIDDLE else WHOLE, key[1] == 0 and own[3] == 0 and own[2] == WHOLE, b"\n".join(own[1])))
                        own[3] += own[2] == WHOLE
                        own[1] = []
                    own[1], own[2] = pieces[p:q], WHOLE
            yield _batch(out)
        yield from _ended(state)

    def _ended(state: dict) -> Iterator[pa.RecordBatch]:
        for key, (inside, open_lines, kind, seen) in state.items():
            if open_lines:
                own = (MIDDLE if inside else HEAD) if kind == MIDDLE else TAIL if inside else WHOLE
                yield _batch([(*key, own, key[1] == 0 and seen == 0 and own in (WHOLE, TAIL), b"\n".join(open_lines))])
        state.clear()

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int8(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["file", "split", "kind", "first", "record"])

    return rows.mapInArrow(run, "file long, split long, kind tinyint, first boolean, record binary")


def ends_inside(effects: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each of successive lines ends inside a quoted value."""
    turns = np.cumsum(effects == 1)
    fixed = np.maximum.accumulate(np.where((effects == OUT) | (effects == IN), np.arange(len(effects)), -1))
    base = np.where(fixed >= 0, effects[fixed] == IN, inside)
    since = turns - np.where(fixed >= 0, turns[fixed], 0)
    return base ^ (since % 2 == 1)


def crossing(fragments: DataFrame) -> DataFrame:
    """``first`` and ``record`` of the records that cross splits: a tail, what follows of it, and its head, in the order of the file."""
    order = Window.partitionBy("file").orderBy("split", (F.col("kind") == TAIL).cast("int"))  # a head stands before its split's tail
    group = F.count_if(F.col("kind") == TAIL).over(order)
    part = F.struct("split", (F.col("kind") == TAIL).cast("int").alias("last"), F.hex("record").alias("text"))
    joined = fragments.withColumn("group", group).groupBy("file", "group").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(part))["text"].alias("parts"))
    return joined.select("first", F.unhex(F.array_join("parts", "0A")).alias("record"))
