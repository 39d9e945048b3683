"""How often every distinct value of every column occurs.

Every column is scanned and grouped by itself, as values of one type. The
shuffle carries one row per distinct value and task, so a value that fills a
third of the table costs nothing. Texts longer than ``KEY_LENGTH`` bytes travel
as a digest of the whole text, with what the profile needs to know about them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import KEY_LENGTH, as_datetime, clean_number, is_number
from ..settings import DEFAULTS, Settings
from .columns import chunks, col, physical_kind


# The yes/no vocabularies.
BOOLEAN_WORDS = (("true", "false"), ("0", "1"), ("yes", "no"), ("y", "n"), ("t", "f"))


def _value_class(dtype: T.DataType) -> str | None:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    kind = physical_kind(dtype)
    if kind == "nested":
        return None
    return "string" if kind == "string" else dtype.simpleString()


def _flag(condition: Column) -> Column:
    return F.when(condition, "1").otherwise("0")


def text_key(text: Column) -> Column:
    """``(head, tail)``: a short text is its head; a long one adds flags, digest and length."""
    tail = F.concat(
        _flag(is_number(text)),
        _flag(clean_number(text).isNotNull()),
        _flag(as_datetime(text).isNotNull()),
        F.md5(text),
        F.length(text).cast("string"),
    )
    short = F.octet_length(text) <= KEY_LENGTH
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(short, text).otherwise(F.substring(text, 1, KEY_LENGTH)).alias("head"),
            F.when(~short, tail).alias("tail"),
        ),
    )


def boolean_words(word: Column) -> Column:
    """Aggregate: do all distinct values belong to one yes/no vocabulary?"""
    strays = [
        F.count_if(F.coalesce(~word.isin(*pair), F.lit(True))) == 0 for pair in BOOLEAN_WORDS
    ]
    return reduce(Column.__or__, strays)


def counted(
    df: DataFrame, columns: list[str] | None = None, settings: Settings = DEFAULTS, part: Column | None = None, parts: int = 0,
    about: dict[str, int] | None = None,
) -> dict[str, DataFrame]:
    """Per value class a frame ``slot, value, n``; ``slot`` is the column position as text.

    A column is scanned and grouped by itself, so its values have a map of their own and a column of many values does not push the
    others' out; ``columns_per_grouping`` lets several share a scan, for frames that are dear to make. With ``part`` (0 to ``parts`` - 1
    per row) the same grouping also counts every part of the table: part k has the slots ``(k + 1) * width`` and up.

    ``about`` tells roughly how many distinct values a column has. Columns that have at most ``values_per_grouping`` together then share
    a scan whatever their class, under the class ``several``: their values are structs with a field for every class, of which one is set.
    """
    width = len(df.columns)
    classes: dict[str, list[tuple[int, str]]] = {}
    for i, field in enumerate(df.schema.fields):
        found = _value_class(field.dataType)
        if found and (columns is None or field.name in columns):
            classes.setdefault(found, []).append((i, field.name))
    total = sum(map(len, classes.values()))
    size = max(settings.columns_per_grouping, -(-total // settings.columns_per_aggregate))
    keep = [] if part is None else [part.alias("part")]
    sums = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("part") == k).alias(f"n{k}") for k in range(parts)]]
    typed = {name: text_key(col(name)) if found == "string" else col(name).cast(found) for found, members in classes.items() for _, name in members}
    shared = _sharing(classes, about, settings) if about else []
    together = {member for group in shared for member in group}
    scans = {found: chunks([m for m in members if m not in together], size) for found, members in classes.items()}
    if shared:
        scans["several"] = shared
        typed |= _in_own_field(classes, typed, together)
    out = {}
    for found, groups in scans.items():
        frames = []
        for group in groups:
            values = [typed[name].alias(str(i)) for i, name in group]
            if len(group) == 1:
                slot = F.lit(str(group[0][0]))
                counts = df.select(values[0].alias("value"), *keep).filter("value is not null").groupBy("value").agg(*sums).withColumn("slot", slot)
            else:
                long = df.select(*keep, *values).unpivot(["part"] if keep else [], [str(i) for i, _ in group], "slot", "value")
                # the test on slot is what later joins infer; stating it keeps the plans of all
                # users of these counts equal, so the shuffle is made once and reused
                counts = long.filter(F.col("value").isNotNull() & F.col("slot").cast("int").isNotNull()).groupBy("slot", "value").agg(*sums)
            if parts:
                at = [F.struct((F.col("slot").cast("int") + (k + 1) * width).cast("string").alias("slot"), F.col(f"n{k}").alias("n")) for k in range(parts)]
                counts = counts.select("value", F.inline(F.array(F.struct("slot", "n"), *at))).filter("n > 0")
            frames.append(counts.select("slot", "value", "n"))
        if frames:
            out[found] = reduce(DataFrame.unionByName, frames)
    return out


def _sharing(classes: dict[str, list[tuple[int, str]]], about: dict[str, int], settings: Settings) -> list[list[tuple[int, str]]]:
    """Groups of columns, those of the fewest values first, that have few enough distinct values for one map."""
    groups: list[list[tuple[int, str]]] = []
    room = 0
    for member in sorted((m for members in classes.values() for m in members), key=lambda m: (about[m[1]], m[0])):
        values = about[member[1]]
        if groups and values <= room and len(groups[-1]) < settings.columns_per_aggregate:
            groups[-1].append(member)
        else:
            groups.append([member])
            room = settings.values_per_grouping
        room -= values
    return [group for group in groups if len(group) > 1]


def _in_own_field(classes: dict[str, list[tuple[int, str]]], typed: dict[str, Column], together: set[tuple[int, str]]) -> dict[str, Column]:
    """Values of several classes as one type: a struct with a field for each class, ``text`` for texts; null for a null."""
    class_of = {name: found for found, members in classes.items() for i, name in members if (i, name) in together}
    fields = {found: "text" if found == "string" else f"v{k}" for k, found in enumerate(sorted(set(class_of.values())))}
    none = {found: F.lit(None).cast("struct<head: string, tail: string>" if found == "string" else found) for found in fields}
    return {
        name: F.when(col(name).isNotNull(), F.struct(*[(typed[name] if found == own else none[found]).alias(field) for found, field in fields.items()]))
        for name, own in class_of.items()
    }


def distinct_summary(counts: dict[str, DataFrame], spark) -> DataFrame:
    """One row per column with values: counts, commonest count, boolean test, parse counts."""
    parts = []
    for found, values in counts.items():
        value, n = F.col("value"), F.col("n")
        none = F.lit(None).cast("bigint")
        fields = [f.name for f in values.schema["value"].dataType.fields] if found == "several" else []
        if found == "string" or "text" in fields:
            text = "value.text" if fields else "value"
            head, tail = F.col(f"{text}.head"), F.col(f"{text}.tail")

            def parsed(place: int, rule: Column, head: Column = head, tail: Column = tail) -> Column:
                flag = F.when(tail.isNotNull(), F.substring(tail, place, 1) == "1").otherwise(rule)
                if fields:  # null for a column without texts
                    return F.sum(F.when(head.isNotNull(), F.when(flag, F.col("n")).otherwise(0)))
                return F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))

            length = F.when(
                tail.isNotNull(), F.substring(tail, 36, 20).cast("bigint")
            ).otherwise(F.length(head).cast("bigint"))
            extra = [
                parsed(1, is_number(head)).alias("n_number"),
                parsed(2, clean_number(head).isNotNull()).alias("n_clean"),
                parsed(3, as_datetime(head).isNotNull()).alias("n_date"),
                F.sum(length * n).alias("length"),
            ]
            word = F.when(tail.isNull(), F.lower(F.trim(head)))
        else:
            extra = [F.max(none).alias(c) for c in ("n_number", "n_clean", "n_date", "length")]
            word = value.cast("string")
        if fields:
            others = [F.col(f"value.{f}").cast("string") for f in fields if f != "text"]
            word = F.coalesce(*([word] if "text" in fields else []), *others)
        parts.append(
            values.groupBy("slot").agg(
                F.sum("n").alias("n_present"),
                F.count(F.lit(1)).alias("n_unique"),
                F.max("n").alias("top_count"),
                boolean_words(word).alias("is_boolean"),
                *extra,
            )
        )
    if not parts:
        return spark.createDataFrame(
            [],
            "ordinal int, n_present bigint, n_unique bigint, top_count bigint, is_boolean boolean,"
            " n_number bigint, n_clean bigint, n_date bigint, length bigint",
        )
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("slot").cast("int").alias("ordinal"), *[c for c in out.columns if c != "slot"])


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n`` with whole values as text. Long texts are grouped by their digest and shown by one of the group."""
    names = F.array(*[F.lit(c) for c in df.columns])
    asked = [(i, f) for i, f in enumerate(df.schema.fields) if _value_class(f.dataType) and (columns is None or f.name in columns)]
    texts = [(i, f.name) for i, f in asked if _value_class(f.dataType) == "string"]
    parts = [
        values.select("slot", F.col("value").cast("string").alias("value"), "n")
        for values in counted(df, [f.name for _, f in asked if _value_class(f.dataType) != "string"]).values()
    ]
    if texts:
        wide = df.select(*[F.struct(text_key(col(c)).alias("key"), col(c).alias("text")).alias(str(i)) for i, c in texts])
        long = wide.unpivot([], [str(i) for i, _ in texts], "slot", "value").filter(F.col("value.text").isNotNull())
        found = long.groupBy("slot", F.col("value.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.any_value("value.text").alias("value"))
        parts.append(found.select("slot", "value", "n"))
    return reduce(DataFrame.unionByName, parts).select(F.get(names, F.col("slot").cast("int")).alias("column"), "value", "n")


def _shown(found: str) -> Column:
    """Display text of a grouped value, cut at 40 characters."""
    if found != "string":
        return F.col("value").cast("string")
    head, tail = F.col("value.head"), F.col("value.tail")
    length = F.coalesce(F.substring(tail, 36, 20).cast("int"), F.length(head))
    return F.when(length > 40, F.concat(F.substring(head, 1, 37), F.lit("..."))).otherwise(head)


def smallest_values(counts: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """``ordinal, position, value``: the ``k`` smallest distinct values of every column.

    Each task keeps only its own ``k`` best per column before the shuffle.
    """
    w = Window.partitionBy("slot").orderBy("value")
    parts = [
        values.filter(F.col("n") > 0)
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= k)
        .select("slot", "position", _shown(found).alias("value"))
        for found, values in counts.items()
    ]
    return reduce(DataFrame.unionByName, parts).select(
        F.col("slot").cast("int").alias("ordinal"), "position", "value"
    )


def sample_values(df: DataFrame, k: int = 3, order_by: Column | None = None) -> DataFrame:
    """``column, position, value``: the first ``k`` distinct values of every column.

    First means earliest by ``order_by``; without an order, smallest.
    """
    names = F.array(*[F.lit(c) for c in df.columns])
    if order_by is None:
        return smallest_values(counted(df), k).select(
            F.get(names, F.col("ordinal")).alias("column"), "position", "value"
        )
    fields = [(i, f.name) for i, f in enumerate(df.schema.fields) if _value_class(f.dataType)]
    wide = df.select(
        order_by.alias("rank"), *[text_key(col(c).cast("string")).alias(str(i)) for i, c in fields]
    )
    first_seen = (
        wide.unpivot(["rank"], [str(i) for i, _ in fields], "slot", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("slot", "value")
        .agg(F.min("rank").alias("rank"))
    )
    w = Window.partitionBy("slot").orderBy("rank", "value")
    return (
        first_seen.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= k)
        .select(
            F.get(names, F.col("slot").cast("int")).alias("column"),
            "position",
            _shown("string").alias("value"),
        )
    )
