"""CSV, usage log, streams and report sinks."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import assay
from assay.plans import usage
from assay.session import held
from assay.sources import csv, records, sinks, usage_log
from assay.sources.limits import LimitError
from assay.streaming import usage as live


def test_csv_types_and_missing_words(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,amount,flag,word,empty,big\n1,2.5,True,"say ""hi"", you",,9999999999999999999\nNA,n/a,False,null,NaN,1\n3,4,True,x,None,2\n')
    df = csv.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean", "word": "string", "empty": "double", "big": "double"}
    rows = df.orderBy(F.col("amount").asc_nulls_first()).collect()
    assert rows[0]["id"] is None and rows[0]["word"] is None
    assert rows[1]["word"] == 'say "hi", you'


def test_csv_encoding_fallback(spark, tmp_path):
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    old.write_bytes("name,n\ncafé,1\n".encode("latin-1"))
    new.write_bytes("name,n\ncafé,1\n".encode())
    for path, encoding in ((old, "ISO-8859-1"), (new, "UTF-8")):
        assert csv.csv_encoding(spark, str(path)) == encoding
        assert csv.read_csv(spark, str(path)).first()["name"] == "café"


VALUES = ["a", "b,c", 'x "q" y', "line\nbreak", "two\r\nlines", '"', '""', "\n", "  lead", "", ",", "é", 'end"', '5" pipe', '"start', 'a"b"c', "\r"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_csv_records_over_many_splits(spark, tmp_path, end, encoding):
    """Every value comes back however the file is split, also one that covers several splits."""
    import csv as python_csv
    import random

    draw = random.Random(5)
    rows = [[str(k), *draw.choices(VALUES, k=3)] for k in range(1500)]
    rows[700][2] = "long\n" * 20000 + '"tail"'
    path = tmp_path / "quoted.csv"
    with open(path, "w", newline="", encoding=encoding) as file:
        python_csv.writer(file, lineterminator=end).writerows([["id", "a", "b", "c"], *rows])
    want = {int(r[0]): tuple(x or None for x in r[1:]) for r in rows}
    for tasks in (1, 16):
        got = csv.read_csv(spark, str(path), schema="id long, a string, b string, c string", tasks=tasks)
        assert {r.id: (r.a, r.b, r.c) for r in got.collect()} == want
    with records.steady_splits(spark, 16):
        lines = records.physical_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() >= 8
        starts = records.split_starts(records.split_effects(lines)).collect()
        assert len(starts) >= 8 and any(r.inside for r in starts)


def test_csv_quotes_inside_plain_values(spark, tmp_path):
    """A quote that does not open a value is text, and what follows a closing quote leaves the value unquoted."""
    import pandas

    path = tmp_path / "stray.csv"
    rows = [f'{k},5" pipe,"q""{k}",x' if k % 3 else f'{k},"two\nlines {k}",y"z",w"' for k in range(1000)]
    path.write_text("id,a,b,c\n" + "\n".join(rows) + "\n\n")
    got = csv.read_csv(spark, str(path), tasks=16)
    want = pandas.read_csv(path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False)))


@pytest.mark.parametrize("text, rows", [("a,b\n", 0), ("a,b\n1,x", 1), ('a,b\n1,"open\nto the end', 1), ('a\n"x\ny"\n\nz\n', 2), ("a,b\r1,x\r2,y\r", 2), ("\ufeffa,b\n1,2\n", 1)])
def test_csv_odd_files(spark, tmp_path, text, rows):
    path = tmp_path / "odd.csv"
    path.write_bytes(text.encode())
    got = csv.read_csv(spark, str(path), tasks=4)
    assert got.columns == text.lstrip("\ufeff").replace("\r", "\n").split("\n")[0].split(",") and got.count() == rows


def test_line_effects(spark):
    """Both starts at once, against a walk character by character."""
    import random

    def walk(line, inside):
        state = "in" if inside else "start"
        for c in line:
            if state == "in":
                state = "quote" if c == '"' else "in"
            elif state == "quote":
                state = "in" if c == '"' else "start" if c == "," else "plain"
            elif state == "start" and c == '"':
                state = "in"
            else:
                state = "start" if c == "," else "plain"
        return state == "in"

    draw = random.Random(2)
    lines = ["".join(draw.choices('",a', k=draw.randrange(14))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", records.effect(F.col("line")).alias("e")).collect()
    assert all(r.e == walk(r.line, False) + 2 * walk(r.line, True) for r in rows)


def test_csv_guards(spark, tmp_path):
    path = tmp_path / "empty.csv"
    path.write_text("a,b\n")
    with pytest.raises(LimitError):
        csv.analyze_csv(spark, str(path))


def events(spark, n=200):
    return spark.range(n).select(
        F.when(F.col("id") % 4 == 0, "analysis_completed").otherwise("page_view").alias("event"),
        F.col("id").cast("string").alias("eventId"),
        F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("id") * 60), "yyyy-MM-dd'T'HH:mm:ss").alias("occurredAt"),
        F.when(F.col("id") % 10 == 0, "anonymous").otherwise(F.concat(F.lit("v"), (F.col("id") % 37).cast("string"))).alias("anonymousUserId"),
        F.lit("upload").alias("source"),
    )


def test_usage_log_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    usage_log.write_usage(events(spark), path)
    (tmp_path / "log" / "extra.json").write_text('\n{"event": "page_view", "anonymousUserId": "z"}\n{not json\n\n')
    got = usage_log.read_usage(spark, path)
    assert got.count() == 201
    totals = usage.usage_totals(got).first()
    assert totals["submissions"] == 50 and totals["pageViews"] == 151
    assert totals["uniqueVisitors"] == 38


def test_anonymized_fields(spark):
    df = spark.createDataFrame([("  ", None, " 1.2.3.4 , 9.9.9.9", "", "p" * 300, "x/My.File.CSV"), ("v", "s", None, "ua", "", "noext")],
                               "visitor string, session string, ip string, user_agent string, path string, file_name string")
    a, b = usage_log.anonymize(df).collect()
    assert a["anonymousUserId"] == "anonymous" and len(a["path"]) == 240 and a["fileExtension"] == "csv"
    assert len(a["ipHash"]) == 24 and a["userAgentHash"] is None
    assert b["path"] == "/" and b["ipHash"] is None and b["fileExtension"] == "unknown"


def run_stream(query):
    q = query.start()
    q.processAllAvailable()
    q.stop()


def test_streaming_equals_batch(spark, tmp_path):
    path, check = str(tmp_path / "log"), str(tmp_path / "check")
    usage_log.write_usage(events(spark).repartition(4), path)
    stream = usage_log.read_usage_stream(spark, path, 2)
    run_stream(live.streaming_totals(stream).writeStream.outputMode("complete").format("memory").queryName("live_totals").option("checkpointLocation", check))
    got = spark.table("live_totals").first()
    want = usage.usage_totals(usage_log.read_usage(spark, path)).first()
    assert (got["pageViews"], got["submissions"]) == (want["pageViews"], want["submissions"])
    assert abs(got["uniqueVisitors"] - want["uniqueVisitors"]) <= 1


def test_streaming_windows_visitors_and_limits(spark, tmp_path):
    path = str(tmp_path / "log")
    usage_log.write_usage(events(spark).coalesce(1), path)
    stream = live.with_event_time(usage_log.read_usage_stream(spark, path), delay="1 day")
    run_stream(live.first_seen_visitors(stream).writeStream.outputMode("append").format("memory").queryName("live_visitors").option("checkpointLocation", str(tmp_path / "c1")))
    want = usage.usage_totals(usage_log.read_usage(spark, path)).first()["uniqueVisitors"]
    assert spark.table("live_visitors").count() == want
    run_stream(live.windowed_activity(stream).writeStream.outputMode("update").format("memory").queryName("live_windows").option("checkpointLocation", str(tmp_path / "c2")))
    assert spark.table("live_windows").agg(F.sum("pageViews"), F.sum("submissions")).first()[:] == (150, 50)
    run_stream(live.streaming_over_limit(stream, F.col("source"), 40).writeStream.outputMode("update").format("memory").queryName("live_limits").option("checkpointLocation", str(tmp_path / "c3")))
    assert spark.table("live_limits").agg(F.max("attempts")).first()[0] == 60


@pytest.fixture
def keyed(spark):
    with held(spark, *live.STATE_STORE):
        yield spark


def test_streaming_uniques_are_exact(keyed, tmp_path):
    """After every micro-batch the sums are those of the log so far; visitors return, some run an analysis only later."""
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    log = events(keyed, 300).withColumn("event", F.when(F.col("eventId").cast("int") < 100, "page_view").otherwise(F.col("event")))
    (tmp_path / "log").mkdir()
    stream = live.streaming_uniques(usage_log.read_usage_stream(keyed, path), buckets=7)
    for k in range(3):
        usage_log.write_usage(log.where(F.floor(F.col("eventId").cast("int") / 100) == k), path)
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        want = usage.usage_totals(usage_log.read_usage(keyed, path)).first()
        got = keyed.read.parquet(out).agg(*[F.sum(c).alias(c) for c in want.asDict()]).first()
        assert got == want


def test_streaming_trailing_hour_is_exact(keyed, tmp_path):
    """Row by row the batch result: disorder within the delay, hour ends, ties, a busy client, and clients forgotten in between."""
    import random

    draw = random.Random(6)
    base = 1_700_000_000
    rows = [("busy", base + draw.randrange(30000)) for _ in range(1500)] + [(f"c{draw.randrange(9)}", base + draw.randrange(30000)) for _ in range(300)]
    rows += [("edge", base + k) for k in (0, 0, 3600, 3601, 7201, 20000, 23600)]
    rows.sort(key=lambda r: r[1] + draw.randrange(600))
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "client string, second bigint"
    (tmp_path / "log").mkdir()
    stream = keyed.readStream.schema("client string, at timestamp").parquet(path)
    timed = live.with_event_time(stream, F.col("at"), "10 minutes")
    exact = live.streaming_over_limit_exact(timed, F.col("client"), limit=20)
    steps = [rows[k:k + 500] for k in range(0, len(rows), 500)] + [[("end", base + 10 ** 6)], [("end", base + 10 ** 6 + 10)]]
    for step in steps:
        keyed.createDataFrame(step, schema).select("client", F.timestamp_seconds("second").alias("at")).coalesce(1).write.mode("append").parquet(path)
        run = exact.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state"))
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = usage.over_limit(keyed.createDataFrame(rows, schema), F.col("client"), F.col("second"), limit=20)
    got = keyed.read.parquet(out)
    assert sorted(map(tuple, got.where("client <> 'end'").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("client = 'busy' and over_limit").count() > 0


def test_streaming_sink(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    usage_log.write_usage(events(spark), path)
    run_stream(usage_log.write_usage_stream(usage_log.read_usage_stream(spark, path), out, str(tmp_path / "c")))
    assert usage_log.read_usage(spark, out).count() == 200


def test_report_files(spark, small, tmp_path):
    report = assay.analyze(spark.read.parquet(f"{small}/nation.parquet"), "nation", settings=assay.Settings(max_rows=20))
    scores = report.scores.first()
    assert scores["sampled"] and scores["n_rows"] == 25 and scores["n_rows_analyzed"] == 20
    for fmt in ("json", "markdown", "parquet"):
        sinks.write_report(report, str(tmp_path / fmt), fmt)
    doc = json.loads(spark.read.text(str(tmp_path / "json")).first()[0])
    assert doc["dataset_name"] == "nation" and len(doc["columns"]) == 3 and doc["findings"]
    assert "_Analyzed a sample of 20 rows._" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "markdown")).collect())
    assert spark.read.parquet(str(tmp_path / "parquet" / "findings")).count() == len(doc["findings"])


def test_classifier(spark):
    from assay.plans.classifier import predict, train_classifier

    df = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("t"), (F.col("id") % 5).alias("x"),
        F.when(F.col("id") % 3 == 0, "yes").otherwise("no").alias("role"),
    )
    model = train_classifier(df, "role", trees=10)
    assert predict(model, df, "role").filter("role = predicted").count() == 200
    assert train_classifier(df.limit(10), "role") is None
