"""Column expressions over text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number or a date when it is stored as text.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY = r"^\s*[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$"
NOT_NUMERIC_CHARS = r"[^0-9.\-]+"
ISO_DATETIME = (
    r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}"
    r"([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?\s*$"
)
US_DATE = r"^\s*\d{1,2}/\d{1,2}/\d{4}\s*$"
DAY_MONTH_NAME = r"^\s*\d{1,2} [A-Za-z]{3} \d{4}\s*$"
MONTH_NAME_DAY = r"^\s*[A-Za-z]{3} \d{1,2}, \d{4}\s*$"

# Longest text kept as it is when values are grouped; longer ones travel as a digest.
KEY_LENGTH = 64


def as_number(value: Column) -> Column:
    """Text as a double, null where it is not a plain number."""
    return F.when(value.rlike(NUMBER) | value.rlike(INFINITY), value.try_cast("double"))


def is_number(value: Column) -> Column:
    return value.rlike(NUMBER) | value.rlike(INFINITY)


def clean_number(value: Column) -> Column:
    """Text as a double after units, commas and currency signs are taken out."""
    return F.when(value.rlike("[0-9]"), as_number(F.regexp_replace(value, NOT_NUMERIC_CHARS, "")))


def as_datetime(value: Column) -> Column:
    """Text as a timestamp under a fixed list of formats, null where none fits."""
    return (
        F.when(
            value.rlike(ISO_DATETIME),
            F.regexp_replace(F.trim(value), "/", "-").try_cast("timestamp"),
        )
        .when(value.rlike(US_DATE), F.try_to_timestamp(F.trim(value), F.lit("M/d/yyyy")))
        .when(value.rlike(DAY_MONTH_NAME), F.try_to_timestamp(F.trim(value), F.lit("d MMM yyyy")))
        .when(value.rlike(MONTH_NAME_DAY), F.try_to_timestamp(F.trim(value), F.lit("MMM d, yyyy")))
    )


def shorten(value: Column, limit: int = 40) -> Column:
    """Cut display text to ``limit`` characters, the last three being dots."""
    return F.when(
        F.length(value) > limit, F.concat(F.substring(value, 1, limit - 3), F.lit("..."))
    ).otherwise(value)
