from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_data import CLASH, EDGE, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
