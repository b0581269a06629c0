"""Registered queries that run a stream to its end and give what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.plans import oracle as o
from maskwright.plans import table_queries as batch_queries
from maskwright.plans.catalog import query
from maskwright.plans.corpus import table
from maskwright.sources import audit
from maskwright.sources.folders import new_folder
from maskwright.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return jobs.read_stream(spark, f"{sf_dir}/{name}.parquet*", table(spark, sf_dir, name).schema)


def _events(spark, sf_dir) -> DataFrame:
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_detect",
    f"with {o.detection_ctes(o.DOCUMENTS_SRC)} select id as doc_id, n as total_entities, risk as risk_score, high as has_high_risk_pii from doc",
)
def stream_detect(spark, sf_dir):
    out = new_folder(spark, "stream")
    texts = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    jobs.start_detect(texts, f"{out}/found", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/found").select(
        "doc_id", F.size("entities").alias("total_entities"), "risk_score", "has_high_risk_pii"
    )


@query(
    "stream_sanitize",
    f"with {o.sanitize_ctes(o.DOCUMENTS_SRC)} select id::varchar as request_id, action as action_taken, sanitized as sanitized_text, 'sanitization' as event_type, risk as risk_score, blocked_reason from out",
)
def stream_sanitize(spark, sf_dir):
    """Sanitized texts next to the audit event written for each."""
    out = new_folder(spark, "stream")
    texts = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text")
    jobs.start_sanitize(texts, f"{out}/texts", f"{out}/audit", f"{out}/checkpoint").awaitTermination()
    logged = spark.read.parquet(f"{out}/audit").select("request_id", "event_type", "risk_score", "blocked_reason")
    return spark.read.parquet(f"{out}/texts").select("request_id", "action_taken", "sanitized_text").join(logged, "request_id")


@query(
    "stream_counters",
    "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as at, event_type, count(*) as value from events group by 1, 2",
)
def stream_counters(spark, sf_dir):
    out = new_folder(spark, "stream")
    counts = jobs.windowed_counter(_events(spark, sf_dir), ["event_type"])
    jobs.start_changes(counts, f"{out}/counts", f"{out}/checkpoint").awaitTermination()
    now = jobs.latest(spark.read.parquet(f"{out}/counts"), ["window_start", "event_type"])
    return now.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "value")


@query(
    "stream_blocked_alerts",
    "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as at, count(*) as blocked from events where event_type = 'error' group by 1 having count(*) > 4",
)
def stream_blocked_alerts(spark, sf_dir):
    out = new_folder(spark, "stream")
    alerts = jobs.blocked_alert_stream(_events(spark, sf_dir), F.col("event_type") == "error", threshold=4)
    jobs.start_changes(alerts, f"{out}/alerts", f"{out}/checkpoint").awaitTermination()
    now = jobs.latest(spark.read.parquet(f"{out}/alerts"), ["window_start"])
    return now.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"), "blocked")


@query(
    "stream_alerts",
    f"with {batch_queries._RATES_SQL} select rule, severity, strftime(w, '%Y-%m-%d %H:%M:%S') as at, round(value, 9) as value, case when hit then 'active' else 'resolved' end as status from moved where hit <> was",
)
def stream_alerts(spark, sf_dir):
    """Alert changes of all windows: those still open at the end of the events are judged by a second
    run from the checkpoint, once the events are said to be complete."""
    out = new_folder(spark, "stream")
    newest = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp")).first()[0]
    for last in (False, True):
        if last and newest is not None:
            jobs.complete_until(spark, out, F.lit(newest) + F.expr("interval 3 hours"))
        jobs.start_alerts(
            _events(spark, sf_dir), out, f"{out}/checkpoint", F.col("event_type") == "error", F.col("value") / 50
        ).awaitTermination()
    return spark.read.parquet(f"{out}/changes").select(
        "rule", "severity", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.round("value", 9).alias("value"), "status",
    )


@query(
    "stream_reuse",
    f"{batch_queries._REUSE_SQL.format(ttl=1800 * 1000000)} select key, requests::bigint as requests, misses::bigint as misses, (requests - misses)::bigint as hits from fin",
)
def stream_reuse(spark, sf_dir):
    out = new_folder(spark, "stream")
    requests = _events(spark, sf_dir).select(F.col("event_type").alias("key"), "ts")
    jobs.start_reuse(requests, out, f"{out}/checkpoint", "key").awaitTermination()
    counts = spark.read.parquet(f"{out}/counts")
    return counts.groupBy("key").agg(
        F.sum("requests").alias("requests"), F.sum("misses").alias("misses"), F.sum("hits").alias("hits")
    )


@query("stream_ema", batch_queries._EMA_SQL)
def stream_ema(spark, sf_dir):
    """Averages of a stream of four files, in which rows come up to half a day out of order."""
    out = new_folder(spark, "stream")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    known = events.agg(F.min(F.unix_seconds("ts")).alias("a"), F.max(F.unix_seconds("ts")).alias("b")).first()
    if known["a"] is None:
        known = {"a": 0, "b": 0}
    came = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(43_200))
    file = F.least(F.lit(3), F.floor((came - known["a"]) * 4 / F.lit(known["b"] - known["a"] + 43_200)))
    for i in range(4):
        events.filter(file == i).repartition(8).write.parquet(f"{out}/in/{i}")  # one micro-batch
    rows = jobs.read_stream(spark, f"{out}/in/*", events.schema, per_trigger=8).withColumnRenamed("event_type", "key")
    jobs.start_ema(rows, out, f"{out}/checkpoint", "key", ["ts", "event_id"], "value", stretch="6 hours", watermark="1 day").awaitTermination()
    now = jobs.current_ema(spark.read.parquet(f"{out}/runs"))
    return now.select("key", "n", F.round("ema", 6).alias("ema"))


_DAY_SQL = (
    "select strftime(ts, '%Y-%m-%d') as event_day, count(*) as events, "
    "sum(user_id % 7)::bigint as entities from events group by 1"
)


def _audit_stream(spark, sf_dir) -> DataFrame:
    rows = _events(spark, sf_dir).selectExpr(*batch_queries._request_columns("detection"))
    return audit.audit_events(rows, "detection")


@query("stream_audit_lines", _DAY_SQL)
def stream_audit_lines(spark, sf_dir):
    """Events streamed to JSON lines per day and read back."""
    out = new_folder(spark, "stream")
    jobs.start_audit_lines(_audit_stream(spark, sf_dir), f"{out}/lines", f"{out}/checkpoint").awaitTermination()
    back = spark.read.schema("details struct<entities_detected:int>, event_date date").json(f"{out}/lines")
    return back.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_day")).agg(
        F.count("*").alias("events"), F.sum("details.entities_detected").alias("entities")
    )


@query("stream_bulk_audit", _DAY_SQL)
def stream_bulk_audit(spark, sf_dir):
    """Events streamed to the audit table and read back."""
    out = new_folder(spark, "stream")
    jobs.start_bulk_audit(_audit_stream(spark, sf_dir), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    back = audit.read_audit(spark, f"{out}/table")
    return back.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_day")).agg(
        F.count("*").alias("events"), F.sum("entities_detected").alias("entities")
    )


@query("audit_compaction", _DAY_SQL)
def audit_compaction(spark, sf_dir):
    """Events written in many batches, one of them twice, compacted in two steps and read back."""
    out = new_folder(spark, "audit")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    for i in range(8):
        batch = numbered.filter(F.col("part") == i).selectExpr(*batch_queries._request_columns("detection"))
        audit.write_batch(audit.audit_events(batch, "detection"), out, i)
        if i in (4, 6):
            audit.compact_audit(spark, out, i - 1)
            audit.write_batch(audit.audit_events(batch, "detection"), out, i)  # a batch that is run again
    back = audit.read_audit(spark, out)
    return back.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_day")).agg(
        F.count("*").alias("events"), F.sum("entities_detected").alias("entities")
    )
