"""Audit events: one table of all kinds, its sinks and its reports.

``details`` holds the fields of a kind as JSON text. The fields that reports read are columns as
well, so a report scans only those, and only the days it asks for (``event_date`` is the
partition column).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: event kinds, their components and detail fields.
VERSION = "0.1.0"
EVENT_KINDS = {
    "detection": ("detector", ["text_length", "entities_detected", "risk_score", "processing_time_ms"]),
    "masking": ("masker", ["entities_masked", "processing_time_ms", "masking_methods"]),
    "sanitization": (
        "policy_engine",
        ["action_taken", "policy_name", "user_role", "entities_detected", "risk_score",
         "processing_time_ms", "blocked_reason"],
    ),
    "proxy": (
        "proxy",
        ["target_url", "service", "entities_detected", "sanitization_applied", "action",
         "status_code", "processing_time_ms"],
    ),
    "request": ("api", ["method", "path", "user_agent"]),
    "response": ("api", ["status_code", "processing_time_ms"]),
    "error": (
        "error_handler",
        ["error_type", "error_message", "context", "processing_time_ms", "request_path"],
    ),
    "admin": ("admin", ["action"]),
}
EVENT_TYPES = [*EVENT_KINDS, "policy_update"]
DEFAULT_REPORT_DAYS = 7
# --- end of fixed values

IDENTITY = ["session_id", "user_id", "client_ip", "request_id"]
REPORTED = {
    "action_taken": "string",
    "user_role": "string",
    "risk_score": "double",
    "entities_detected": "int",
    "blocked_reason": "string",
}


def _or_null(df: DataFrame, name: str, kind: str | None = None) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None).cast(kind or "string")
    return (value.cast(kind) if kind else value).alias(name)


def audit_events(df: DataFrame, kind: str, ts: str = "ts", extra_details: list[str] | None = None) -> DataFrame:
    """Audit rows of one kind from a table that has the kind's fields (missing ones are null).

    The event id is a hash of the event, so a repeated write can be recognized and dropped.
    ``extra_details`` names further columns for the details of admin events.
    """
    component, fields = EVENT_KINDS[kind]
    details = F.to_json(
        F.struct(*[_or_null(df, f) for f in [*fields, *(extra_details or [])]]), {"ignoreNullFields": "false"}
    )
    rows = df.select(
        F.col(ts).cast("timestamp").alias("timestamp"),
        F.lit(kind).alias("event_type"),
        *[_or_null(df, c, "string") for c in IDENTITY],
        details.alias("details"),
        F.struct(F.lit(component).alias("component"), F.lit(VERSION).alias("version")).alias("metadata"),
        *[_or_null(df, c, t) if c in fields else F.lit(None).cast(t).alias(c) for c, t in REPORTED.items()],
    )
    identity = [F.coalesce(c, F.lit("")) for c in ("event_type", *IDENTITY, "details")]
    return rows.withColumn(
        "event_id", F.md5(F.concat_ws("|", F.unix_micros("timestamp").cast("string"), *identity))
    ).withColumn("event_date", F.to_date("timestamp"))


def union_events(*parts: DataFrame) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def json_rows(events: DataFrame) -> DataFrame:
    """Rows as they appear in the JSON lines files: details as an object, not as text."""
    return events.select(
        "timestamp", "event_type", "event_id", *IDENTITY,
        F.parse_json("details").alias("details"), "metadata", "event_date",
    )


def write_audit(events: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per UTC day.

    A day's rows are gathered into few files per task by Spark's partitioned writer, without a
    shuffle that would put a busy day into one task.
    """
    json_rows(events).write.partitionBy("event_date").mode("append").option(
        "ignoreNullFields", "false"
    ).json(path)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch's events, by day and then by batch, so that reports list only the days they need."""
    numbered = batch.withColumn("batch_id", F.lit(batch_id))
    writer = numbered.write.partitionBy("event_date", "batch_id").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def bulk_audit_sink(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer into a partitioned parquet audit table.

    Each micro-batch replaces its own folders, so a batch that is run again after a failure does
    not write its events twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return write


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Folders of the committed manifests, oldest first."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/*/_SUCCESS")
    states = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found) or []
    return sorted(s.getPath().getParent().toString() for s in states)


def _manifest(spark: SparkSession, path: str) -> tuple[int, str | None, int]:
    """(version, folder of the compacted events, last batch in it) that readers follow now."""
    committed = _manifests(spark, path)
    if not committed:
        return 0, None, -1
    row = spark.read.schema("version int, folder string, last_batch bigint").json(committed[-1]).first()
    return row["version"], row["folder"], row["last_batch"]


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The events of an audit table: those its manifest lists as compacted, and later batches."""
    _, folder, last = _manifest(spark, path)
    if folder is None:
        return spark.read.option("basePath", path).parquet(path)
    compacted = spark.read.parquet(folder)
    schema = compacted.withColumn("batch_id", F.lit(0)).schema
    later = spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("batch_id") > last)
    return compacted.withColumn("batch_id", F.lit(None).cast("int")).unionByName(later)


def compact_audit(spark: SparkSession, path: str, last_batch: int) -> int:
    """Gather all events of batches up to ``last_batch`` in few files a day; the manifest's version.

    A stream may still run a batch again until it has begun the next, so ``last_batch`` is to be one
    that its checkpoint has committed. Compacted events go to a folder of their own; readers follow
    the manifest, which is committed last and names the folder and the batches it stands for: they
    see the old files or the new, never both or neither, and a compaction that fails changes nothing.
    Of two at the same time one fails to commit. Files are sized by Spark's rebalancing, so a busy
    day is several. Nothing to compact: the version stays.
    """
    version, folder, done = _manifest(spark, path)
    if last_batch <= done:
        return version
    events = read_audit(spark, path).filter(F.col("batch_id").isNull() | (F.col("batch_id") <= last_batch)).drop("batch_id")
    target = f"{path}/_compacted/{uuid.uuid4().hex}"
    events.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(target)
    row = spark.range(1).select(F.lit(version + 1).alias("version"), F.lit(target).alias("folder"), F.lit(last_batch).cast("bigint").alias("last_batch"))
    row.write.mode("error").json(f"{path}/_manifest/{version + 1:012d}")
    return version + 1


def _in_range(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    ts = F.col("timestamp")
    return events.filter(
        F.col("event_date").between(F.lit(start.date()), F.lit(end.date()))
        & ts.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )


def default_range(now: datetime) -> tuple[datetime, datetime]:
    return now - timedelta(days=DEFAULT_REPORT_DAYS), now


def detection_report(events: DataFrame, start: datetime, end: datetime, size: int | None = None) -> DataFrame:
    """(metric, bucket, value): totals, average risk and the frequencies of entity counts.

    Both range ends count. ``size`` asks for the most frequent counts only; of equal frequencies the
    smaller count comes first.
    """
    found = _in_range(events.filter(F.col("event_type") == "detection"), start, end)
    buckets = found.groupBy("entities_detected").agg(
        F.count("*").alias("n"), F.count("event_id").alias("ids"), F.count("risk_score").alias("scored"),
        F.sum("risk_score").alias("risk"),
    )
    totals = buckets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"),
        (F.sum("risk") / F.sum("scored")).alias("risk"),
    )

    def line(metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(None).cast("int").alias("bucket"),
            value.cast("double").alias("value"),
        )

    lines = totals.select(
        F.inline(
            F.array(
                line("total_detections", F.col("ids")),
                line("average_risk_score", F.col("risk")),
                line("total_documents", F.col("documents")),
            )
        )
    )
    known = buckets.filter(F.col("entities_detected").isNotNull())
    if size is not None:
        known = known.orderBy(F.desc("n"), "entities_detected").limit(size)
    top = known.select(
        F.lit("entities_distribution").alias("metric"),
        F.col("entities_detected").alias("bucket"),
        F.col("n").cast("double").alias("value"),
    )
    return lines.unionByName(top)


def blocked_report(
    events: DataFrame, start: datetime, end: datetime, size: int | None = None
) -> DataFrame:
    """Blocked sanitization events by time: all, or the first ``size``."""
    blocked = events.filter((F.col("event_type") == "sanitization") & (F.col("action_taken") == "block"))
    rows = (
        _in_range(blocked, start, end)
        .select(
            "timestamp", F.col("blocked_reason").alias("reason"), "user_role", "risk_score",
            "entities_detected", "event_id",
        )
        .orderBy("timestamp", "event_id")
    )
    return rows if size is None else rows.limit(size)
