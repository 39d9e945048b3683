"""Column expressions over column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S


def matches(name: Column, pattern: str) -> Column:
    return name.rlike("(?i)" + pattern)


def normalized_name(name: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def name_kind(name: Column) -> Column:
    """``measurement`` wins over ``identifier``; everything else is ``unknown``."""
    plain = normalized_name(name)
    return (
        F.when(matches(plain, S.MEASUREMENT_NAME), "measurement")
        .when(matches(plain, S.IDENTIFIER_NAME), "identifier")
        .otherwise("unknown")
    )


def has_evidence(feature: Column, target: Column) -> Column:
    """Do the names alone suggest that ``feature`` is recorded after ``target``?"""
    return matches(feature, S.LEAKAGE_EVIDENCE) | (
        matches(target, S.LEAKAGE_EVIDENCE) & matches(feature, S.LEAKAGE_NAME)
    )
