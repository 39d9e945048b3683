"""The usage log: JSON lines of page views and completed analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a usage event.
USAGE_SCHEMA = (
    "event string, eventId string, product string, occurredAt string, path string, "
    "anonymousUserId string, sessionId string, ipHash string, userAgentHash string, source string, "
    "fileExtension string, demoId string, targetProvided boolean, rowCount bigint, columnCount bigint, "
    "rowsAnalyzed bigint, sampled boolean, healthScore double, grade string, integrityScore double, "
    "readinessScore double, findingCount bigint, modelingWarningCount bigint, "
    "severityCounts map<string,bigint>, aiAvailable boolean"
)


def read_usage(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All well-formed events; blank and malformed lines are skipped."""
    return spark.read.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def read_usage_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(USAGE_SCHEMA).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def write_usage(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def write_usage_stream(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events as JSON lines; the file sink commits each batch once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def short_hash(value: Column) -> Column:
    """24 hex digits of the SHA-256 of the trimmed text; null when blank."""
    return F.substring(F.sha2(F.nullif(F.trim(value), F.lit("")), 256), 1, 24)


def clean_id(value: Column, fallback: str | None = None) -> Column:
    """Trimmed and cut to 128 characters; ``fallback`` when blank."""
    kept = F.substring(F.nullif(F.trim(value), F.lit("")), 1, 128)
    return kept if fallback is None else F.coalesce(kept, F.lit(fallback))


def file_extension(name: Column) -> Column:
    """Lower-case suffix of the last path part, ``unknown`` if it has none."""
    base = F.element_at(F.split(name, "/"), -1)
    found = F.regexp_extract(base, r"^.+\.([^.]+)$", 1)
    return F.when(found != "", F.lower(found)).otherwise("unknown")


def first_address(forwarded: Column) -> Column:
    """The client's address in a list of forwarding addresses."""
    return F.trim(F.get(F.split(forwarded, ","), F.lit(0)))


def anonymize(events: DataFrame) -> DataFrame:
    """Raw events (visitor, session, ip, user_agent, path, file_name) as privacy-light ones."""
    return events.select(
        *[c for c in events.columns if c not in ("visitor", "session", "ip", "user_agent", "path", "file_name")],
        F.substring(F.coalesce(F.nullif(F.col("path"), F.lit("")), F.lit("/")), 1, 240).alias("path"),
        clean_id(F.col("visitor"), "anonymous").alias("anonymousUserId"),
        clean_id(F.col("session")).alias("sessionId"),
        short_hash(first_address(F.col("ip"))).alias("ipHash"),
        short_hash(F.col("user_agent")).alias("userAgentHash"),
        file_extension(F.col("file_name")).alias("fileExtension"),
    )
