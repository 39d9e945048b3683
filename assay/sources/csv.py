"""CSV tables with the conventions of data-frame users: NA words and an encoding fallback."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NUMBER
from ..operators.columns import chunks, col
from ..session import checkpoint_folder
from ..settings import DEFAULTS, Settings
from . import records
from .limits import LimitError, check_limits

UPLOAD_COLUMNS = 200  # fixed value: columns an uploaded file may have

# Texts that mean "missing" in a CSV file.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_FALSE = ("True", "TRUE", "true", "False", "FALSE", "false")
INTEGER = r"^\s*[+-]?\d+\s*$"


def csv_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """``UTF-8`` if every line is valid UTF-8, else ``ISO-8859-1``.

    Lines are tested as raw bytes on the executors, split by split.
    """
    lines = spark.read.text(path)
    bad = lines.filter(~F.is_valid_utf8(F.col("value")))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def _reader(spark: SparkSession, encoding: str, multiline: bool):
    options = {"header": True, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": multiline, "nullValue": ""}
    return spark.read.options(**options)


def _text(record, encoding: str):
    """A record as text, without the carriage return of its line end."""
    text = record.cast("string") if encoding == "UTF-8" else F.decode(record, encoding)
    return F.regexp_replace(text, r"\r\z", "")


def _cut_records(spark: SparkSession, path: str | list[str], encoding: str | None, tasks: int | None) -> DataFrame:
    """All values as text, records cut split by split, and written as columns: what follows reads only the columns it needs."""
    folder = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    with records.steady_splits(spark, tasks):
        lines = records.physical_lines(spark, path)
        records.split_effects(lines).write.parquet(f"{folder}/splits")
        splits = spark.read.parquet(f"{folder}/splits")
        looks = splits.agg(F.bool_and("valid").alias("valid"), F.bool_or("returns").alias("returns"), F.max("lines").alias("lines")).first()
        encoding = encoding or ("UTF-8" if looks["valid"] is not False else "ISO-8859-1")
        header = _reader(spark, encoding, True).csv(path)
        if looks["returns"] and looks["lines"] == 1 or encoding.upper() not in ("UTF-8", "ISO-8859-1"):
            return header  # lines end in bare carriage returns, or line feeds are more than one byte: one task a file
        if not header.columns:
            return header
        names = [f"c{k}" for k in range(len(header.columns))]
        options = {"quote": '"', "escape": '"', "multiLine": "true", "nullValue": "", "lineSep": "\n"}
        values = lambda text: F.from_csv(text, ", ".join(f"{n} string" for n in names), options)
        found = records.cut(lines, records.split_starts(splits)).withColumn("text", F.when(F.col("kind") == records.WHOLE, _text(F.col("record"), encoding)))
        rows = found.where("text is null or (not first and text <> '')").select(
            "file", "split", "kind", "first", F.when(F.col("kind") != records.WHOLE, F.col("record")).alias("record"), values(F.col("text")).alias("v"))
        rows.select("file", "split", "kind", "first", "record", "v.*").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    whole = rows.where(F.col("kind") == records.WHOLE).select(*names)
    parts = records.crossing(rows.where(F.col("kind") != records.WHOLE)).where("not first").select(_text(F.col("record"), encoding).alias("text"))
    crossed = parts.select(values(F.col("text")).alias("v")).select("v.*")
    return whole.unionByName(crossed).toDF(*header.columns)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    encoding: str | None = None,
    schema: str | None = None,
    multiline: bool = True,
    settings: Settings = DEFAULTS,
    tasks: int | None = None,
) -> DataFrame:
    """A CSV table with header; NA words become null and types are inferred afterwards.

    A quoted value may hold line breaks; files are read by many tasks all the same (``records``), in two scans: one for quotes and
    the encoding together, one that cuts the records and writes them as columns to the checkpoint folder. ``tasks`` asks for that many
    splits at least. Only files whose lines end in bare carriage returns, or of an encoding given as neither UTF-8 nor ISO-8859-1, are
    read by one task each. ``multiline=False`` skips the cut, and is only right for files without line breaks in values.
    Blank lines are no rows. Give a ``schema`` for big data: inference is one more pass.
    """
    if multiline:
        check_limits(_reader(spark, encoding or "UTF-8", True).csv(path), settings) if settings.max_file_bytes is not None else None
        raw = _cut_records(spark, path, encoding, tasks)
    else:
        raw = _reader(spark, encoding or csv_encoding(spark, path), False).csv(path)
    if not raw.columns:
        raise LimitError("The file is empty.")
    check_limits(raw, settings if not multiline else replace(settings, max_file_bytes=None))
    raw = raw.withColumns({c: F.when(~col(c).isin(*NA_WORDS), col(c)) for c in raw.columns})
    if schema is not None:
        wanted = spark.createDataFrame([], schema).schema
        return raw.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    types = infer_types(raw, settings)
    return raw.select(
        *[(col(c) if types[c] == "string" else col(c).try_cast(types[c])).alias(c) for c in raw.columns]
    )


def infer_types(raw: DataFrame, settings: Settings = DEFAULTS) -> dict[str, str]:
    """The narrowest type all present texts of a column fit; one aggregate per chunk of columns."""
    types: dict[str, str] = {}
    for part in chunks(raw.columns, settings.columns_per_aggregate):
        sums = []
        for i, c in enumerate(part):
            v = col(c)
            whole = v.rlike(INTEGER) & v.try_cast("bigint").isNotNull()
            number = (v.rlike(NUMBER) | v.rlike(r"^\s*[+-]?(?i)inf(inity)?\s*$")) & v.try_cast("double").isNotNull()
            sums += [
                F.count(v).alias(f"n{i}"),
                F.count_if(whole).alias(f"i{i}"),
                F.count_if(number).alias(f"d{i}"),
                F.count_if(v.isin(*TRUE_FALSE)).alias(f"b{i}"),
            ]
        row = raw.agg(*sums).first()
        for i, c in enumerate(part):
            n = row[f"n{i}"]
            if n == 0 or row[f"d{i}"] == n:
                types[c] = "bigint" if n and row[f"i{i}"] == n else "double"
            elif row[f"b{i}"] == n:
                types[c] = "boolean"
            else:
                types[c] = "string"
    return types


def analyze_csv(spark: SparkSession, path: str, name: str | None = None, target: str | None = None,
                settings: Settings = DEFAULTS):
    """Guards, reading and analysis in one call."""
    from ..plans.analyze import analyze

    guarded = settings if settings.max_columns is not None else replace(settings, max_columns=UPLOAD_COLUMNS)
    df = read_csv(spark, path, settings=guarded)
    check_limits(df, replace(guarded, max_file_bytes=None), need_rows=True)  # the file's size was looked at before reading
    return analyze(df, name or path.rstrip("/").rsplit("/", 1)[-1], target, settings=settings)
