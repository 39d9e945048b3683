"""Stored column states: adding up, and what is read off them."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import column_state, profile
from assay.settings import Settings


def rows_of(state) -> dict:
    return {(r["column"], r["part"], r["key"]): (r["n"], r["x"], r["text"]) for r in state.collect()}


def close(a, b) -> bool:
    return a == b or a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9)


@pytest.fixture(scope="module")
def mixed(spark):
    draw = random.Random(4)
    rows = []
    for k in range(12000):
        rows.append((
            k, draw.choice([None, 0.0, -0.0, float("nan"), draw.gauss(0, 1000), float("inf")]), draw.choice(["yes", "no", None]),
            f"{draw.randrange(10 ** 9)} kg" if k % 3 else "12.5", "common" if draw.random() < 0.995 else f"v{k}", [k], k % 2 == 0, "ü" * draw.randrange(90)))
    return spark.createDataFrame(rows, "id long, x double, flag string, weight string, mostly string, list array<int>, even boolean, long_text string")


def test_halves_add_up_to_the_whole(spark, mixed, tmp_path):
    whole = rows_of(column_state.column_state(mixed, k=256))
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for k in range(3):
        column_state.save_state(column_state.column_state(mixed.where(part == k), k=256), str(tmp_path / "state"), str(k))
    added = rows_of(column_state.read_state(spark, str(tmp_path / "state"), k=256))
    assert added.keys() == whole.keys()
    for key, (n, x, text) in whole.items():
        assert added[key][0] == n and close(added[key][1], x) and added[key][2] == text, key
    # the same slice again replaces itself
    column_state.save_state(column_state.column_state(mixed.where(part == 0), k=256), str(tmp_path / "state"), "0")
    assert rows_of(column_state.read_state(spark, str(tmp_path / "state"), k=256)).keys() == whole.keys()


def test_profile_of_a_state_is_the_exact_one(spark, mixed):
    shown = ["column", "n_null", "dtype_inferred", "is_id_like", "is_high_cardinality", "is_constant", "numeric_parse_rate", "clean_numeric_parse_rate", "avg_len"]
    exact = {r["column"]: r for r in profile.profile(mixed, settings=Settings(sample_values=0)).collect()}
    rough = {r["column"]: r for r in profile.profile_of_state(column_state.column_state(mixed)).collect()}
    assert exact.keys() == rough.keys()
    for c, r in rough.items():
        assert {k: r[k] for k in shown} == {k: exact[c][k] for k in shown}
        assert r["n_unique"] is None or abs(r["n_unique"] - exact[c]["n_unique"]) <= 0.07 * exact[c]["n_unique"]
        assert r["top_share"] is None or exact[c]["top_share"] < 0.05 or abs(r["top_share"] - exact[c]["top_share"]) < 0.002
    assert rough["id"]["n_unique"] == exact["id"]["n_unique"]  # each value once: the mean rows say it exactly


def test_quantiles_and_moments(spark):
    draw = random.Random(8)
    values = [draw.choice([-1, 1]) * draw.lognormvariate(0, 4) for _ in range(5000)] + [0.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    state = column_state.column_state(df)
    shares = [0.0, 0.1, 0.3, 0.5, 0.52, 0.77, 0.999, 1.0]
    found = {r["share"]: r["value"] for r in column_state.quantiles(state, shares).collect()}
    values.sort()
    for share in shares:
        exact = values[int(share * (len(values) - 1))]
        assert abs(found[share] - exact) <= column_state.ACCURACY * 1.001 * abs(exact)
    m = column_state.moments(state).first()
    assert m["n"] == 5500 and m["least"] == values[0] and m["greatest"] == values[-1] and math.isclose(m["mean"], sum(values) / 5500, rel_tol=1e-9)


def test_columns_that_come_and_go(spark):
    a = column_state.column_state(spark.createDataFrame([(1, "x")], "id int, old string"))
    b = column_state.column_state(spark.createDataFrame([(2, 5.0)], "id long, new double"))
    rows = {r["column"]: r for r in column_state.summary(column_state.merged_state(a.unionByName(b))).collect()}
    assert {c: (r["n_rows"], r["n_present"], r["n_unique"]) for c, r in rows.items()} == {"id": (2, 2, 2), "old": (2, 1, 1), "new": (2, 1, 1)}


def test_empty_table(spark):
    state = column_state.column_state(spark.createDataFrame([], "a string, b double"))
    assert [(r["n_rows"], r["n_unique"]) for r in column_state.summary(state).orderBy("ordinal").collect()] == [(0, 0), (0, 0)]
    assert column_state.quantiles(state, [0.5]).count() == 0
