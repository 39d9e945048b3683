"""What queries on growing tables must keep: the whole job, and steps whose size is bounded."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.catalog import registry
from assay.operators import association, column_state, order_stats, profile as P, value_counts
from assay.operators.columns import missing_as_null
from assay.settings import Settings

from __spark_entry__ import oracle_sql, queries


def test_heatmap_shows_every_column(spark, small):
    shown = {(r["column"], r["column2"]) for r in queries()["heatmap_view"](spark, small).collect()}
    names = {a for a, _ in shown}
    assert len(names) == 6 and shown == {(a, b) for a in names for b in names}
    assert oracle_sql()["heatmap_view"] == oracle_sql()["correlation_matrix"]


def test_state_is_made_of_tallies_instead_of_exploded_rows(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("word"), F.concat(F.lit("1,"), "id").alias("price"))
    state = column_state.column_state(df, k=1024)
    plan = state._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan
    found = {(r["column"], r["part"], r["key"]): r["n"] for r in state.where("part = 'count'").collect()}
    key = {name: i for i, name in enumerate(column_state.COUNTS)}
    assert found["word", "count", key["n_number"]] == 5000 and found["price", "count", key["n_number"]] == 0
    assert found["price", "count", key["n_clean"]] == 5000
    assert {r["text"]: r["n"] for r in state.where("column = 'word' and part = 'value'").collect()} == {str(w): 5000 // 7 + (w < 5000 % 7) for w in range(7)}


def test_few_values_that_many_rows_share_are_not_narrowed_again(spark, monkeypatch):
    """A bracket of two neighbouring values holds more rows than are ranked at once, however often it is narrowed."""
    steps, narrow = [], order_stats._narrow
    monkeypatch.setattr(order_stats, "_narrow", lambda *a: steps.append(a[2]) or narrow(*a))
    long = spark.range(20000).select(F.lit("q").alias("column"), (F.col("id") % 50).cast("double").alias("value"))
    at = order_stats.order_statistics(long, {"q": [(9999, 10000)]}, {"q": 20000}, Settings(exact_in_one_pass=500))
    assert at == {("q", 9999): 24.0, ("q", 10000): 25.0}
    assert len(steps) == 2, len(steps)


def test_dealt_anew_into_tasks_of_bounded_size(spark, small, monkeypatch):
    seen, cap_rows = [], registry.sampling.cap_rows
    monkeypatch.setattr(registry.sampling, "cap_rows", lambda df, n: seen.append(df) or cap_rows(df, n))
    queries()["capped_rows"](spark, small)
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "Repartition " not in plan  # no fixed number of tasks
    assert seen[1].count() == seen[0].count()


def test_a_step_of_the_disordered_stream_is_one_batch(spark, small):
    stream, later = registry._disordered_stream(spark, small)
    assert stream.isStreaming and len(later) == 4  # three more steps and the end, each read by a run of its own
    options = stream._jdf.queryExecution().analyzed().toString()
    assert "maxFilesPerTrigger" not in options


def test_rows_of_a_hot_target_value_are_not_exchanged(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double") + 0.5).alias("y"), "id")
    ranks = df.groupBy("y").agg((F.count(F.lit(1)) * 2.0).alias("r_n"))
    wide = association._join_by_value(df, ranks, spark.createDataFrame([(7.0,)], "y double"), 5)
    assert sorted(wide.collect()) == sorted(df.join(ranks, "y").select("y", "id", "r_n").collect())
    hot, cold = wide._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")
    assert "broadcast" in hot and "LeftAnti" not in hot
    cold = association._join_by_value(df, ranks, spark.createDataFrame([], "y double"), 5)
    assert cold.count() == 4000 and cold._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert "ENSURE_REQUIREMENTS" not in cold._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1].split("HashAggregate")[0]


def test_every_column_has_a_grouping_of_its_own(spark, small):
    df = registry.frame(spark, small, "lineitem")
    counts = value_counts.counted(df)
    assert all("Expand" not in c._jdf.queryExecution().optimizedPlan().toString() for c in counts.values())
    shared = value_counts.counted(df, settings=Settings(columns_per_grouping=3))
    assert any("Expand" in c._jdf.queryExecution().optimizedPlan().toString() for c in shared.values())
    assert all(sorted(map(str, c.collect())) == sorted(map(str, shared[k].collect())) for k, c in counts.items())


def test_parts_of_a_table_from_one_grouping(spark, small):
    plain = Settings(sample_values=0)
    for name in ("customer", "embeddings", "labelled"):
        df = registry.frame(spark, small, name)
        part = F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(2))
        found = P.profile_parts(df, part, 2, name, plain)
        for k, rows in enumerate([df, df.where(part == 0), df.where(part == 1)]):
            expected = sorted(map(str, P.profile(rows, name, plain).collect()))
            assert sorted(map(str, found.where(F.col("slice") == k).drop("slice").collect())) == expected


def test_fingerprints_profile_the_tables_once(spark, small, monkeypatch):
    calls, profiles_of = [], registry.profiles_of
    monkeypatch.setattr(registry, "profiles_of", lambda *given: calls.append(given) or profiles_of(*given))
    assert queries()["fingerprints"](spark, small).count() == len(registry._LEDGER_RUNS) and len(calls) == 1


def _edges_below(x, at, bins):
    """The distinct values at places ``ceil(n*i/bins)`` of ``x`` that are below each of ``at``."""
    ordered = np.sort(x[~np.isnan(x)])
    edges = {ordered[-(-len(ordered) * i // bins) - 1] for i in range(1, bins)}
    return np.array([sum(e < v for e in edges) for v in at])


@pytest.mark.parametrize("classes, settings", [
    (True, Settings()), (True, Settings(exact_in_one_pass=50, columns_per_aggregate=2)), (False, Settings())], ids=["one pass", "ranges", "quantity"])
def test_association_with_few_classes_groups_the_table_once(spark, monkeypatch, classes, settings):
    """No row is multiplied by features or bracketed by bins: ranks, bins and medians follow from the counts of each value by class."""
    g, n = np.random.default_rng(6), 1999
    y = g.integers(0, 3, n)
    x = pd.DataFrame({
        "spread": y + g.normal(size=n), "tied": np.where(g.random(n) < 0.4, 5.0, g.integers(-4, 5, n)), "flat": np.full(n, 2.0),
        "gap": np.where(g.random(n) < 0.3, np.nan, g.normal(size=n).round(1) * y), "halves": np.where(g.random(n) < 0.5, np.nan, g.integers(0, 2, n)), "void": np.full(n, np.nan)})
    word = np.where(g.random(n) < 0.2, None, np.array(["b", "a", "c"])[(y + (g.random(n) < 0.1)) % 3])
    goal = np.array(["lo", "mid", "no"])[y] if classes else y + g.normal(size=n).round(2)
    df = missing_as_null(spark.createDataFrame(x.assign(word=word, goal=goal))).repartition(4)
    features = [association.Feature(c, "number", True, bool(x[c].isna().any()), n) for c in x] + [association.Feature("word", "string", False, True, 3)]
    target = association.Target("goal", "string" if classes else "number", classes, 3 if classes else n)
    if classes:
        monkeypatch.setattr(order_stats, "_narrow", lambda *a: pytest.fail("values were bracketed"))
        monkeypatch.setattr(association, "long_form", lambda *a, **k: pytest.fail("rows were multiplied by features"))
        monkeypatch.setattr(association, "level_codes", lambda df, names, *a: spark.createDataFrame(
            [(c, v, i) for c in names for i, v in enumerate({"word": "abc", "goal": ["lo", "mid", "no"]}[c])], "column string, level string, code long"))
    groupings, value_classes = [], association.value_classes
    monkeypatch.setattr(association, "value_classes", lambda *a: groupings.append(a) or value_classes(*a))
    encoded = association.encode(df, features, target, settings)
    found = {r["column"]: r for r in association.target_association(df, features, target, settings).collect()}
    assert len(groupings) == 1
    bins = association.bin_count(n, target)
    ranked = pd.Series(y if classes else goal)
    cell = y if classes else _edges_below(goal, goal, bins)
    code = np.array([-1 if w is None else "abc".index(w) for w in word])
    information = {r["column"]: r["mi_norm"] for r in association.mutual_information(encoded, features, target, settings).collect()}
    entropy = lambda *keys: -sum(p * np.log(p) for p in pd.DataFrame(dict(enumerate(keys))).value_counts(normalize=True))
    for c in [*x, "word"]:
        v = code if c == "word" else x[c].to_numpy()
        if c == "word":
            own = code
        elif c == "void":
            own = np.zeros(n)
        else:
            own = _edges_below(v, np.where(np.isnan(v), np.nanmedian(v), v), bins)
        mi = max(0.0, entropy(own) + entropy(cell) - entropy(own, cell)) / entropy(cell)
        assert found[c]["mi"] == pytest.approx(mi, abs=1e-9) and information[c] == pytest.approx(mi, abs=1e-9), c
        rho = pd.Series(v).rank().corr(ranked.where(~pd.isna(pd.Series(v))).rank())
        assert found[c]["spearman"] == pytest.approx(0.0 if np.isnan(rho) else abs(rho), abs=1e-9), c
        assert found[c]["n_pairs"] == int((~pd.isna(pd.Series(v))).sum())


def test_ranks_of_features_are_taken_from_one_grouping(spark):
    """A target of many values: the counts by value are written once, not made again for the totals."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(3000, numPartitions=3).mapInArrow(counted, "id long").select((F.col("id") % 701).cast("double").alias("y"), (F.col("id") % 13).cast("double").alias("x0"))
    features = [association.Feature("a", "number", True, False, 13)]
    rho = association.spearman(association.Encoded(df, {"a": "x0"}), features).first()["rho"]
    i = pd.Series(range(3000))
    assert rho == pytest.approx((i % 701).rank().corr((i % 13).rank()), abs=1e-9)
    assert seen.value == 6000  # once for the target's counts, once for the features'


def _odd_columns(spark):
    """Every class of value, with nulls, NaN, both zeros, words for yes and no, long texts, a nested and an empty column; rows come twice."""
    long = "x" * 70
    rows = spark.range(60).selectExpr(
        "id % 30 AS many", "CAST(id % 3 AS TINYINT) AS tiny", "id % 2 = 0 AS flag", "IF(id % 4 = 0, null, IF(id % 4 = 1, 'Yes', ' no')) AS word",
        f"IF(id % 5 = 0, null, concat('{long}', id % 4)) AS essay", "CASE id % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN 0.0D WHEN 2 THEN -0.0D WHEN 3 THEN 1.0D END AS zero",
        "CAST(id % 7 AS DECIMAL(12, 2)) AS price", "date_add(DATE'2020-01-01', CAST(id % 6 AS INT)) AS day", "timestamp_seconds(id % 9 * 3600) AS at",
        "array(id) AS nested", "CAST(null AS STRING) AS nothing", "IF(id % 2 = 0, concat('1,', id % 3), '2020-01-31') AS `odd name.x`")
    return rows.unionAll(rows)


def test_columns_of_few_values_share_a_scan(spark):
    df = _odd_columns(spark)
    part = F.pmod(F.xxhash64("many", "word"), F.lit(2))
    alone, shared = (P.profile_parts(df, part, 2, "t", Settings(sample_values=0, values_per_grouping=n)) for n in (0, 50_000))
    assert sorted(map(str, alone.collect())) == sorted(map(str, shared.collect())) and shared.count() == 3 * len(df.columns)
    kinds = {(r["column"], r["slice"]): (r["dtype_inferred"], r["n_unique"]) for r in shared.collect()}
    assert kinds["word", 0] == ("boolean", 2) and kinds["zero", 0] == ("numeric", 2) and kinds["nested", 0] == ("nested", None)
    about = {c: 5 for c in df.columns if c != "nested"} | {"many": 30}
    sets = value_counts.counted(missing_as_null(df), settings=Settings(values_per_grouping=20), part=part, parts=2, about=about)
    # eleven columns, at most four of them in a map of 20 values; the widest has a map of its own
    assert set(sets) == {"several", "bigint"} and sets["bigint"].select("slot").distinct().count() == 3
    assert sets["several"]._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 6  # three groups over two ranges


def test_parts_of_a_table_are_read_in_few_scans(spark, small):
    df = registry.frame(spark, small, "lineitem")
    part = F.pmod(F.xxhash64(*df.columns), F.lit(2))
    scans = P.profile_parts(df, part, 2, "lineitem")._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans == 1, scans  # one for each of eleven columns and one for the rows before
    assert P.profile_parts(df.limit(0), part, 2, "lineitem").where("n_rows = 0 and n_unique = 0").count() == 33


def test_texts_are_indexed_and_groups_dealt_once(spark, monkeypatch):
    from assay.plans import classifier

    rows = [(g, k, "xy"[k % 2], f"w{k % 3}", "big" if k >= 50 else "small") for g in "abcdef" for k in range(0, 100, 4)] + [(None, 1, "x", None, "small")]
    df = spark.createDataFrame(rows, "g string, k int, a string, b string, size string")
    model = classifier.train_classifier(df.drop("g"), "size", trees=5)
    assert [type(s).__name__ for s in model.stages] == ["StringIndexerModel", "StringIndexerModel", "OneHotEncoderModel", "VectorAssembler", "RandomForestClassificationModel"]
    seen, train = [], classifier.train_classifier
    monkeypatch.setattr(classifier, "train_classifier", lambda d, *a, **k: seen.append(d) or train(d, *a, **k))
    judged = classifier.out_of_fold(df, "size", "g", folds=3, trees=5)
    assert judged.count() == len(rows) - 1  # a row without a group has no fold, as before
    assert len(seen) == 3 and all("Window" not in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)
