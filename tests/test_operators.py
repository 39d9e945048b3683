"""Operators against brute force, including the plans meant for data too large for one pass."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import association, correlation, duplicates, missingness, order_stats, ranks, repair, value_counts
from assay.operators.columns import missing_as_null
from assay.operators.profile import profile
from assay.plans import usage
from assay.settings import DEFAULTS, Settings
from assay.sources import limits, sampling

TIGHT = dataclasses.replace(DEFAULTS, exact_in_one_pass=50)


def skewed(n: int = 3000) -> np.ndarray:
    """A third of the rows is one value, the rest has a heavy tail and ties."""
    g = np.random.default_rng(5)
    x = np.concatenate([np.full(n // 3, 7.0), g.lognormal(2, 1.5, n // 3), g.integers(0, 20, n - 2 * (n // 3)).astype(float)])
    g.shuffle(x)
    return x


def long_of(spark, **columns):
    rows = [(k, float(v)) for k, vs in columns.items() for v in vs]
    return spark.createDataFrame(rows, "column string, value double").repartition(5)


@pytest.mark.parametrize("settings", [DEFAULTS, TIGHT], ids=["one pass", "narrowed"])
def test_quantiles_are_exact(spark, settings):
    a, b = skewed(), np.random.default_rng(1).normal(size=2000)
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = order_stats.quantiles(long_of(spark, a=a, b=b), ps, None, settings)
    for name, x in (("a", a), ("b", b)):
        assert np.allclose(got[name], np.quantile(x, ps), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("settings", [DEFAULTS, TIGHT], ids=["one pass", "narrowed"])
def test_spread(spark, settings):
    a = skewed()
    df = spark.createDataFrame(pd.DataFrame({"a": a})).repartition(5)
    n, q1, median, q3, mad = order_stats.spread(df, {"a": F.col("a")}, settings)["a"]
    med = np.median(a)
    assert (n, median) == (len(a), med)
    assert np.allclose((q1, q3, mad), (*np.quantile(a, [0.25, 0.75]), np.median(np.abs(a - med))))


def test_ranks_by_ranges_equal_ranks_in_one_window(spark):
    a, b = skewed(), np.arange(500.0)
    counts = long_of(spark, a=a, b=b).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    key = ["column", "value", "n", "below", "code"]
    one = sorted(tuple(r) for r in ranks.cumulative(counts, 1).select(*key).collect())
    many = sorted(tuple(r) for r in ranks.cumulative(counts, None, TIGHT).select(*key).collect())
    assert one == many
    x = pd.Series(a)
    lookup = {(c, v): (n, below) for c, v, n, below, _ in one}
    for v in x.unique():
        assert lookup[("a", v)] == ((x == v).sum(), (x < v).sum())


def _measured(df, spark, target, settings):
    rows = profile(df, "t", dataclasses.replace(settings, sample_values=0)).collect()
    tested, aim = association.describe_columns(rows, target, settings)
    return association.encode(df, tested, aim, settings), tested, aim


@pytest.mark.parametrize("settings", [DEFAULTS, TIGHT], ids=["one pass", "ranges"])
def test_spearman_matches_pandas(spark, settings):
    g = np.random.default_rng(8)
    n = 600
    x = g.normal(size=n)
    pdf = pd.DataFrame({"x": x, "gappy": np.where(g.random(n) < 0.3, np.nan, x**3), "tied": np.round(x), "y": np.exp(x) + g.normal(0, 0.5, n)})
    df = spark.createDataFrame(pdf).repartition(4)
    encoded, tested, _ = _measured(df, spark, "y", settings)
    got = {r["column"]: r["rho"] for r in association.spearman(encoded, tested, settings).collect()}
    for c in ("x", "gappy", "tied"):
        both = pdf[[c, "y"]].dropna()
        assert math.isclose(got[c], both[c].rank().corr(both["y"].rank()), abs_tol=1e-9)


def test_exact_copy_by_labels_and_by_numbers(spark):
    pdf = pd.DataFrame({"y": [i % 3 for i in range(60)]})
    pdf["renamed"] = ["zxa"[v] for v in pdf["y"]]
    pdf["other"] = ["p" if i % 2 else "q" for i in range(60)]
    pdf["same"] = pdf["y"]
    df = spark.createDataFrame(pdf)
    rows = profile(df, "t").collect()
    tested, aim = association.describe_columns(rows, "y")
    got = {r["column"]: r["exact"] for r in association.target_association(df, tested, aim).collect()}
    assert got == {"renamed": True, "other": False, "same": True}


def test_many_classes_are_joined(spark):
    g = np.random.default_rng(3)
    y = g.integers(0, 60, 900)
    pdf = pd.DataFrame({"y": [f"k{v:02d}" for v in y], "x": y + g.normal(0, 0.1, 900)})
    encoded, tested, aim = _measured(spark.createDataFrame(pdf), spark, "y", DEFAULTS)
    assert aim.classes and aim.n_unique > DEFAULTS.class_values
    r = association.pearson(encoded, tested).first()["r"]
    assert math.isclose(r, np.corrcoef(pd.Series(pdf["y"]).rank(method="dense"), pdf["x"])[0, 1], abs_tol=1e-9)


@pytest.mark.parametrize("limit", [200, 0], ids=["aggregate", "products"])
def test_pairwise_complete_correlation(spark, limit):
    g = np.random.default_rng(4)
    n = 500
    pdf = pd.DataFrame(g.normal(1e6, 1, (n, 4)), columns=list("abcd"))
    pdf["b"] = pdf["a"] * -2 + g.normal(0, 0.1, n)
    pdf.loc[g.random(n) < 0.4, "b"] = np.nan
    pdf.loc[g.random(n) < 0.2, "c"] = np.nan
    pdf["flat"] = 3.0
    settings = dataclasses.replace(DEFAULTS, pairs_by_aggregate=limit)
    df = spark.createDataFrame(pdf).repartition(4)
    got = correlation.pair_correlations(df, {c: F.col(c) for c in pdf.columns}, None, settings)
    for r in got.collect():
        want = pdf[r["column"]].corr(pdf[r["column2"]]) if "flat" not in (r["column"], r["column2"]) else None
        assert (r["r"] is None) if want is None else math.isclose(r["r"], want, abs_tol=1e-6)


def test_mask_correlation_and_cluster(spark):
    g = np.random.default_rng(6)
    n = 400
    gap = g.random(n) < 0.3
    pdf = pd.DataFrame({c: g.normal(size=n) for c in "abcde"})
    for c in "abc":
        pdf.loc[gap, c] = np.nan
    pdf.loc[g.random(n) < 0.5, "d"] = np.nan
    df = missing_as_null(spark.createDataFrame(pdf))
    pairs = missingness.mask_correlation(df, list("abcd")).collect()
    want = pdf[list("abcd")].isna().astype(int).corr()
    for r in pairs:
        assert math.isclose(r["corr"], want.loc[r["column"], r["column2"]], abs_tol=1e-9)
    frame = spark.createDataFrame(pairs)
    assert missingness.missing_cluster(frame).first()["columns"] == ["a", "b", "c"]


def test_duplicates_see_where_nulls_are(spark):
    rows = [(None, "a"), ("a", None), ("a", None), ("", "a"), (None, "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert tuple(duplicates.duplicate_counts(df).first()) == (5, 2)


def test_duplicates_with_nested_columns(spark):
    df = spark.sql("SELECT map('k', 1) AS m, array(1, 2) AS a, 0.0D AS z UNION ALL SELECT map('k', 1), array(1, 2), -0.0D UNION ALL SELECT map('k', 2), array(1, 2), 0.0D")
    assert tuple(duplicates.duplicate_counts(df).first()) == (3, 1)


def test_long_texts_count_as_wholes(spark):
    stem = "x" * 500
    df = spark.createDataFrame([(stem + "1",), (stem + "2",), (stem + "1",), ("9" * 80,)], "t string")
    r = profile(df, "t").first()
    assert (r["n_unique"], r["top_count"], r["avg_len"]) == (3, 2, (501 * 3 + 80) / 4)
    assert r["numeric_parse_rate"] == 0.25
    assert r["sample_values"][0] == "9" * 37 + "..."


def test_profile_edge_types(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('1', ' Yes ', 1.5D, true, DATE'2020-01-01', array(1)), ('0', 'no', double('NaN'), false, null, array(2)) "
        "AS t(a, b, c, d, e, f)"
    )
    rows = {r["column"]: r for r in profile(df, "t").collect()}
    assert [rows[c]["dtype_inferred"] for c in "abcdef"] == ["boolean", "boolean", "numeric", "boolean", "datetime", "nested"]
    assert rows["c"]["n_null"] == 1 and rows["f"]["n_unique"] is None and rows["e"]["null_rate"] == 0.5


def test_text_numbers(spark):
    from assay.functions import as_datetime, as_number

    given = ["1", " 2.5 ", "1e3", ".5", "1f", "1_000", "0x1", "nan", "inf", "-Infinity", "1,5", "", "+7."]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(as_number(F.col("v"))).collect()]
    assert got == [1, 2.5, 1000, 0.5, None, None, None, None, math.inf, -math.inf, None, None, 7.0]
    dates = ["2020-01-31", "2020/1/3", "2020-13-01", "1/31/2020", "3 Jan 2020", "Jan 3, 2020", "2020-01-01T10:11:12.5Z", "12", "x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(dates)], "i int, v string")
    got = [r[0] is not None for r in df.orderBy("i").select(as_datetime(F.col("v"))).collect()]
    assert got == [True, True, False, True, True, True, True, False, False]


def test_capped_rows_with_a_hot_row(spark):
    rows = [(1, "hot")] * 400 + [(i, f"v{i}") for i in range(2, 802)]
    df = spark.createDataFrame(rows, "a int, b string")
    drawn = []
    for parts in (1, 7):
        out, sampled, total = sampling.cap_rows(df.repartition(parts), 300, seed=3)
        drawn.append(sorted(tuple(r) for r in out.collect()))
        assert sampled and total == 1200 and len(drawn[-1]) == 300
    assert drawn[0] == drawn[1]
    assert sampling.cap_rows(df, 5000)[1] is False


def test_hash_sample_is_repeatable(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    a, b = (sampling.sample_share(df.repartition(n), 0.3).count() for n in (1, 6))
    assert a == b and abs(a / df.count() - 0.3) < 0.03


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise("b").alias("k"))
    sides = []
    for parts in (1, 6):
        out = repair.stratified_split(df.repartition(parts), "k", ["id"], 0.25)
        sides.append({r["id"]: r["split"] for r in out.collect()})
        for r in out.groupBy("k").agg(F.count_if(F.col("split") == "test").alias("t"), F.count(F.lit(1)).alias("n")).collect():
            assert r["t"] == round(0.25 * r["n"] + 1e-9)
    assert sides[0] == sides[1] and len(sides[0]) == 5000


def test_group_split_and_sample(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("g"), "id")
    out = repair.group_split(df, ["g"], 0.3)
    assert out.groupBy("g").agg(F.count_distinct("split").alias("s")).filter("s > 1").count() == 0
    picked = repair.stratified_sample(df.withColumn("k", F.col("g") % 2), "k", 0.5).count()
    assert 800 < picked < 1200


@pytest.mark.parametrize("settings", [DEFAULTS, TIGHT], ids=["direct", "hot groups"])
def test_median_by_group(spark, settings):
    g = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": g.choice([1990, 1991, 1992], 300, p=[0.8, 0.1, 0.1]), "v": g.normal(size=300)})
    pdf.loc[g.random(300) < 0.3, "v"] = np.nan
    pdf["i"] = range(300)
    out = repair.fill_median_by(spark.createDataFrame(pdf), "v", F.col("k"), settings).toPandas().sort_values("i")
    want = pdf["v"].fillna(pdf.groupby("k")["v"].transform("median"))
    assert np.allclose(out["v"].to_numpy(), want.to_numpy())


def test_repairs_keep_nulls(spark):
    df = spark.createDataFrame([(1, -1.0, "12 kg"), (2, None, "x"), (3, math.e - 1, None)], "i int, v double, t string")
    logged = [r["v"] for r in repair.log_clip(df, ["v"]).orderBy("i").collect()]
    assert logged[0] == 0.0 and logged[1] is None and math.isclose(logged[2], 1.0)
    assert [r["t"] for r in repair.strip_units(df, ["t"]).orderBy("i").collect()] == [12.0, None, None]
    assert [r["v_missing"] for r in repair.add_missing_flags(df, ["v"]).orderBy("i").collect()] == [0, 1, 0]
    assert [r["t"] for r in repair.fill_constant(df, ["t"]).orderBy("i").collect()] == ["12 kg", "x", "Unknown"]


def test_rare_levels(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbccd"] + [(None,)], "c string")
    assert sorted(r[0] for r in repair.group_rare_levels(df, "c", 2).collect()) == sorted("aaabb") + ["other"] * 4
    merged = [r[0] for r in repair.merge_rare_classes(df, "c", 2).collect()]
    assert merged.count("other") == 1 and merged.count(None) == 1


def test_limits(spark):
    wide = spark.range(1).select(*[F.lit(1).alias(f"c{i}") for i in range(4)])
    with pytest.raises(limits.LimitError):
        limits.check_limits(wide, Settings(max_columns=3))
    with pytest.raises(limits.LimitError):
        limits.check_limits(wide.filter("false"), need_rows=True)
    with pytest.raises(limits.LimitError):
        limits.check_limits(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), Settings(max_file_bytes=100))


def test_over_limit_by_brute_force(spark):
    g = np.random.default_rng(2)
    pdf = pd.DataFrame({"c": np.where(g.random(400) < 0.4, 1, g.integers(2, 6, 400)), "s": g.integers(0, 9000, 400)})
    pdf.loc[:20, "s"] = 3600
    out = usage.over_limit(spark.createDataFrame(pdf), F.col("c"), F.col("s"), 5)
    for r in out.collect():
        near = pdf[(pdf["c"] == r["client"]) & (pdf["s"] >= r["second"] - 3600) & (pdf["s"] <= r["second"])]
        assert r["trailing"] == len(near) and r["over_limit"] == (len(near) > 5)


def test_first_seen_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "c"), (2, "b"), (4, "c")], "i int, v string")
    got = value_counts.sample_values(df.select("i", "v"), 2, F.col("i")).filter("column = 'v'").orderBy("position").collect()
    assert [r["value"] for r in got] == ["c", "b"]


def test_mask_correlation_of_many_columns_missing_at_random(spark):
    rng = np.random.default_rng(12)
    gaps = rng.random((300, 60)) < 0.5
    gaps[:, 7] = gaps[:, 3]
    names = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame(pd.DataFrame(np.where(gaps, None, 1.0), columns=names).astype(object), ", ".join(f"{n} double" for n in names)).repartition(5)
    found = {(r["place"], r["place2"]): r["corr"] for r in missingness.mask_correlation(df, names).collect()}
    exact = np.corrcoef(gaps.T.astype(float))
    assert len(found) == 60 * 59 // 2
    assert max(abs(found[i, j] - exact[i, j]) for i, j in found) < 1e-6 and found[3, 7] == 1.0


def test_median_by_group_of_many_groups(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 10_000).alias("g"), F.when(F.col("id") < 20_000, F.col("id")).alias("v"))
    out = repair.fill_median_by(df, "v", F.col("g"), Settings(exact_in_one_pass=1000))
    wrong = out.filter((F.col("id") >= 20_000) & (F.col("v") != F.col("g") + 5000))
    assert out.count() == 30_000 and wrong.count() == 0 and out.filter("v IS NULL").count() == 0


def test_spearman_with_a_hot_target_value(spark):
    """A third of the rows share one target value, and no rank table is broadcast."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=900).round(2), skewed(900)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "gap": np.where(rng.random(900) < 0.2, np.nan, x + y)}))
    features = [association.Feature("x", "number", True, False), association.Feature("gap", "number", True, True)]
    tight = dataclasses.replace(DEFAULTS, broadcast_rows=0)
    encoded = association.encode(missing_as_null(df), features, association.Target("y", "number", False, len(set(y))), tight)
    found = {r["column"]: r["rho"] for r in association.spearman(encoded, features, tight).collect()}
    frame = df.toPandas()
    for c in ("x", "gap"):
        both = frame[[c, "y"]].dropna().rank()
        assert abs(found[c] - both[c].corr(both["y"])) < 1e-9


def test_row_cap_reads_the_table_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(4000, numPartitions=7).mapInArrow(counted, "id long")
    out, sampled, total = sampling.cap_rows(df, 300)
    assert (sampled, total, seen.value) == (True, 4000, 4000)
    ids = {r["id"] for r in out.collect()}
    assert len(ids) == 300 and ids == {r["id"] for r in sampling.cap_rows(spark.range(4000, numPartitions=2), 300)[0].collect()}
    assert sampling.cap_rows(df, 0)[0].count() == 0 and sampling.cap_rows(df.limit(0), 5)[1:] == (False, 0)


def test_median_of_many_groups(spark):
    """Groups that share a range and groups that span several; nothing is sent out by group."""
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 9000).cast("string"))).alias("g"),
        F.when(F.col("id") % 7 > 0, (F.xxhash64("id") % 10000).cast("double")).alias("v"))
    own = df.groupBy("g").agg(F.median("v").alias("m"))
    want = df.join(own, "g").select("g", F.coalesce("v", "m").alias("v"))
    got = repair.fill_median_by(df, "v", F.col("g"), Settings(exact_in_one_pass=1000))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("settings", [Settings(), Settings(exact_in_one_pass=50, broadcast_rows=20)])
def test_spearman_with_gaps_and_a_hot_target(spark, settings):
    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(7)
    n = 3000
    y = np.where(draw.random(n) < 0.4, 5.0, draw.normal(size=n).round(2))
    pdf = pd.DataFrame({"y": y, "a": np.where(draw.random(n) < 0.33, np.nan, y + draw.normal(size=n)), "b": np.where(draw.random(n) < 0.5, np.nan, draw.integers(0, 9, n)), "c": draw.normal(size=n)})
    pdf["d"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    encoded = association.Encoded(df.select("y", *[F.col(c).alias(f"x_{c}") for c in "abcd"]), {c: f"x_{c}" for c in "abcd"})
    features = [association.Feature(c, "number", True, c != "c") for c in "abcd"]
    got = {r["column"]: r["rho"] for r in association.spearman(encoded, features, settings).collect()}
    for c in "abc":
        assert got[c] == pytest.approx(pdf[[c, "y"]].dropna().rank().corr().iloc[0, 1], abs=1e-9)
    assert got.get("d") is None


def test_out_of_fold_judges_unseen_groups(spark):
    from assay.plans.classifier import column_descriptors, out_of_fold

    rows = [(g, k, "big" if k >= 50 else "small") for g in "abcdef" for k in range(0, 100, 4)]
    df = spark.createDataFrame(rows, "g string, k int, size string")
    judged = out_of_fold(df, "size", "g", folds=3, trees=5)
    assert judged.count() == len(rows) and judged.where("predicted <> size").count() <= 12
    assert {r[0] for r in judged.groupBy("g").agg(F.count_distinct("fold")).select("count(DISTINCT fold)").collect()} == {1}
    # the label of a held-out group is never looked at: with labels turned round there, predictions stay
    turned = df.withColumn("size", F.when(F.col("g") == "a", F.when(F.col("size") == "big", "small").otherwise("big")).otherwise(F.col("size")))
    of = lambda d: sorted(tuple(r) for r in out_of_fold(d, "size", "g", folds=6, trees=5).where("g = 'a'").select("k", "predicted").collect())
    assert of(df) == of(turned)
    names = column_descriptors(profile(df)).columns
    assert not {"column_role", "is_id_like", "name_kind", "dtype_inferred"} & set(names)


def test_tables_at_a_time_give_the_same_reports(spark, small):
    from assay import analyze, analyze_tables

    tables = {n: spark.read.parquet(f"{small}/{n}.parquet") for n in ("nation", "customer", "part")}
    targets = {"customer": "c_mktsegment"} if "c_mktsegment" in tables["customer"].columns else {}
    shown = ("code", "severity", "column", "engine")
    found = lambda report: sorted(tuple(str(r[c]) for c in shown if c in r) for r in map(lambda r: r.asDict(), report.findings.collect()))
    together = analyze_tables(tables, targets, parallel=3)
    assert list(together) == list(tables)
    for name, df in tables.items():
        alone = analyze(df, name, targets.get(name))
        assert found(together[name]) == found(alone)
        assert together[name].scores.first()["overall_score"] == alone.scores.first()["overall_score"]
    assert analyze_tables({}) == {}
    with pytest.raises(Exception):
        analyze_tables({"none": spark.createDataFrame([], "a int").drop("a")})


def test_matrix_has_its_diagonal(spark):
    df = spark.createDataFrame([(float(k), -float(k), 1.0) for k in range(20)], "a double, b double, c double")
    pairs = correlation.pair_correlations(df, {c: F.col(c) for c in "abc"}, set("abc"))
    cells = {(r["column"], r["column2"]): r["r"] for r in correlation.correlation_matrix(pairs, list("abc"), {"c"}).collect()}
    assert cells == {(x, y): {"aa": 1.0, "bb": 1.0, "ab": -1.0, "ba": -1.0}.get(x + y, 0.0) for x in "abc" for y in "abc"}


def test_row_cap_takes_a_filter_of_its_own_only_for_rows_left_out(spark):
    """One filter where every row that shares the last draw is wanted; two where some are left out."""
    scans = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    single = spark.range(4000, numPartitions=5)
    rows, sampled, total = sampling.cap_rows(single, 300)
    assert (sampled, total, rows.count(), scans(rows)) == (True, 4000, 300, 1)
    twice = single.select((F.col("id") % 2000).alias("id"))  # every row has a copy
    even, odd = sampling.cap_rows(twice, 300)[0], sampling.cap_rows(twice, 301)[0]
    assert (even.count(), scans(even)) == (300, 1) and (odd.count(), scans(odd)) == (301, 2)
    assert even.exceptAll(odd).count() == 0 and even.groupBy("id").count().where("count <> 2").count() == 0
    one = single.select(F.lit(None).cast("int").alias("nothing"))  # all alike and null, in a task or in several
    assert [sampling.cap_rows(one.coalesce(k), 300)[0].count() for k in (1, 5)] == [300, 300]


def test_rows_like_keeps_what_a_comparison_needs(spark):
    """Copies, nulls, NaN and both zeros are told as ``exceptAll`` tells them; rows that only one side has make no difference."""
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 0.0D), (1, 'a', -0.0D), (2, null, double('NaN')), (2, null, null), (null, null, null), (3, 'b', 1.0D) AS t(a, b, c)")
    few = spark.sql("SELECT * FROM VALUES (1, 'a', -0.0D), (1, 'a', 0.0D), (1, 'a', 0.0D), (2, null, double('NaN')), (null, null, null), (4, 'b', 1.0D) AS t(a, b, c)")
    near = duplicates.rows_like(df, few)
    assert near.columns == df.columns and near.count() == 4
    left = lambda a, b: sorted(str(tuple(r)) for r in a.exceptAll(b).collect())
    assert left(few, near) == left(few, df) and len(left(few, df)) == 2
    assert near.exceptAll(df).count() == 0 and duplicates.rows_like(df, few.limit(0)).count() == 0


def test_capped_rows_are_drawn_from_the_table_once(spark, small):
    """Scans of the result's plan: the table for the comparison, the rows dealt anew; the kept rows come from the checkpoint."""
    from __spark_entry__ import queries

    plan = queries()["capped_rows"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") >= 3 and "LeftSemi" in plan
    assert plan.count("Relation [") in (4, 6), plan.count("Relation [")  # 14 when every use drew them again
