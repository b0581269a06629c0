"""The table operators on streams.

Stateless operators run on a streaming DataFrame as they are. Counters use event-time windows with
a watermark; rows later than the watermark are dropped, as Spark does by default. Sinks write each
micro-batch to a folder of its own, so a batch that is run again after a failure replaces its
first output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions.policy import Policy
from maskwright.operators import batch, metrics
from maskwright.operators.detect import detect
from maskwright.operators.sanitize import sanitize
from maskwright.sources.audit import audit_events, bulk_audit_sink, json_rows, write_batch
from maskwright.streaming.state import Runs, Verdicts, use_rocks_store

WATERMARK = "1 hour"


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``path`` may hold wild cards and name files or folders."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def _start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def start_detect(df: DataFrame, path: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Detected texts appended to a parquet folder as they arrive."""
    found = detect(df, text_col)
    return _start(
        found, checkpoint, lambda rows, n: rows.write.mode("overwrite").parquet(batch_folder(path, n))
    )


def start_sanitize(
    df: DataFrame,
    path: str,
    audit_path: str,
    checkpoint: str,
    ts: Column | None = None,
    policy: Policy | None = None,
    role: str = "user",
    request_id: str = "request_id",
) -> StreamingQuery:
    """Sanitized texts to one folder, and one audit event per text to another.

    Without ``ts`` events carry the time of the micro-batch.
    """
    out = sanitize(df, policy, role).select(
        F.col(request_id).cast("string").alias("request_id"),
        "action_taken", "sanitized_text", "risk_score", "blocked_reason",
        F.size("entities").alias("entities_detected"),
        F.lit("default").alias("policy_name"),
        F.lit(role).alias("user_role"),
        (F.current_timestamp() if ts is None else ts).alias("ts"),
    )

    def write(rows: DataFrame, batch_id: int) -> None:
        # The texts are searched once; the audit rows are made from what was written.
        target = batch_folder(path, batch_id)
        rows.write.mode("overwrite").parquet(target)
        written = rows.sparkSession.read.schema(rows.schema).parquet(target)
        events = audit_events(written, "sanitization")
        write_batch(events, audit_path, batch_id)

    return _start(out, checkpoint, write)


def start_audit_lines(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit events appended as JSON lines, one folder per UTC day.

    The file sink records what each micro-batch wrote, so a re-run adds nothing twice.
    """
    return (
        json_rows(events)
        .writeStream.format("json")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .option("ignoreNullFields", "false")
        .trigger(availableNow=True)
        .start()
    )


def start_bulk_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit events appended to the partitioned parquet audit table."""
    return _start(events, checkpoint, bulk_audit_sink(path))


def windowed_counter(
    df: DataFrame, labels: list[str], ts: str = "ts", every: str = "1 hour", watermark: str = WATERMARK
) -> DataFrame:
    """Counts per time window and labels; on a stream, with a watermark."""
    source = df.withWatermark(ts, watermark) if df.isStreaming else df
    return (
        source.groupBy(F.window(ts, every).alias("window"), *labels)
        .agg(F.count("*").alias("value"))
        .select(F.col("window.start").alias("window_start"), *labels, "value")
    )


def start_changes(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of an aggregated stream, batch by batch (``update`` mode)."""
    return _start(
        df,
        checkpoint,
        lambda rows, n: rows.write.mode("overwrite").parquet(batch_folder(path, n)),
        mode="update",
    )


def latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows from written changes: of each key, the one of the last batch."""
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return changes.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def blocked_alert_stream(
    df: DataFrame, is_blocked: Column, threshold: int = metrics.BLOCKED_ALERT_THRESHOLD, watermark: str = WATERMARK
) -> DataFrame:
    """Hours with too many blocked requests, as soon as they have them (``update`` mode)."""
    return metrics.blocked_alerts(df.withWatermark("ts", watermark), is_blocked, threshold)


def _ticks(spark: SparkSession, path: str) -> DataFrame:
    """The stream of times up to which the events are known to be complete."""
    folder = f"{path}/ticks"
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(folder)
    return spark.readStream.schema("ts timestamp").parquet(folder)


def complete_until(spark: SparkSession, path: str, ts: Column) -> None:
    """Say that no more events from before ``ts`` will come: the next run of the job with this
    ``path`` judges what had to wait for the watermark. ``ts`` is an expression without columns."""
    spark.range(1).select(ts.cast("timestamp").alias("ts")).write.mode("append").parquet(f"{path}/ticks")


def start_alerts(
    df: DataFrame,
    path: str,
    checkpoint: str,
    is_error: Column,
    duration: Column,
    rules: list[metrics.AlertRule] | None = None,
    every: str = "1 hour",
    watermark: str = WATERMARK,
) -> StreamingQuery:
    """Alert changes from closed time windows, in ``path``/changes; which alerts are active carries over.

    A window is judged once, when the watermark has passed its end: by later events, or by a time
    given to ``complete_until``. Verdicts are compared in the order of windows by timers on keyed state,
    one key a rule; what reaches them is one row a window and rule, not events. ``every`` is in
    seconds, minutes, hours or days.
    """
    spark = df.sparkSession
    use_rocks_store(spark)
    window_ms = int(spark.range(1).select(F.expr(f"cast(interval {every} as interval day to second)").alias("i")).first()["i"].total_seconds() * 1000)
    events = df.select(
        F.col("ts"), F.coalesce(is_error, F.lit(False)).alias("failed"), duration.cast("double").alias("took"), F.lit(False).alias("tick")
    )
    ticks = _ticks(spark, path).withColumns({"failed": F.lit(False), "took": F.lit(None).cast("double"), "tick": F.lit(True)})
    counted = (
        events.unionByName(ticks)
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", every).alias("window"))
        .agg(F.count_if(~F.col("tick")).alias("requests"), F.count_if("failed").alias("failed"), F.avg("took").alias("avg_response_time"))
        .filter("requests > 0")
    )
    rates = counted.select(
        F.window_time("window").alias("ts"), F.col("window.start").alias("window_start"), "requests",
        (F.col("failed") / F.col("requests")).alias("error_rate"), "avg_response_time",
    )
    states = metrics.rule_states(rates, rules, keep=["ts"])
    changes = (
        states.select("rule", "severity", "value", "triggered", F.unix_millis("window_start").alias("at"), "ts")
        .groupBy("rule")
        .transformWithStateInPandas(Verdicts(window_ms), Verdicts.output, outputMode="Append", timeMode="EventTime")
    )
    return _start(changes, checkpoint, lambda rows, n: rows.write.mode("overwrite").parquet(batch_folder(f"{path}/changes", n)))


def _previous(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """State left by the batch before; none before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(batch_folder(f"{path}/state", batch_id - 1))


def start_reuse(
    df: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    ttl_seconds: int = batch.DETECTION_TTL_SECONDS,
    max_times: int = batch.MAX_TIMES_PER_KEY,
) -> StreamingQuery:
    """Hits and misses per key and batch; the time of each key's last miss carries over.

    ``df`` is (key, ts). Requests older than the carried miss count as hits. Keys whose result has
    run out by the newest request leave the state.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        key_type = rows.schema[key].dataType.simpleString()
        before = _previous(spark, path, batch_id, f"`{key}` {key_type}, since timestamp")
        stats = batch.reuse_from(rows, before, key, ttl_seconds=ttl_seconds, max_times=max_times)
        target = batch_folder(f"{path}/counts", batch_id)
        stats.write.mode("overwrite").parquet(target)
        written = spark.read.schema(stats.schema).parquet(target)
        moved = written.select(key, F.col("last_miss").alias("since")).filter("since is not null")
        merged = before.unionByName(moved).groupBy(key).agg(F.max("since").alias("since"))
        newest = rows.agg(F.max("ts")).scalar()
        live = merged.filter(
            F.coalesce(F.unix_micros("since") + F.lit(ttl_seconds * 1_000_000) > F.unix_micros(newest), F.lit(True))
        )
        live.write.mode("overwrite").parquet(batch_folder(f"{path}/state", batch_id))

    return _start(df, checkpoint, write)


def start_ema(
    df: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    order: list[str],
    value: str,
    alpha: float = batch.EMA_ALPHA,
    stretch: str = "1 hour",
    watermark: str = WATERMARK,
) -> StreamingQuery:
    """Running averages per key, as one map for each key and stretch of event time in ``path``/runs;
    ``current_ema`` applies them in turn.

    ``order`` starts with the event time. A row may come late, by ``watermark``, and takes its place in
    the order; older ones are dropped. A key with most of the rows is many stretches, each with its own
    state; choose them so that the rows of one fit a task. Rows with null values, times or keys are left out.
    """
    use_rocks_store(df.sparkSession)
    seconds = df.sparkSession.range(1).select(F.expr(f"cast(interval {stretch} as interval day to second)").alias("i")).first()["i"].total_seconds()
    stretch_ms = int(seconds * 1000)
    at = F.unix_millis(order[0])
    rows = df.select(
        F.col(key).alias("key"), (at - F.pmod(at, F.lit(stretch_ms))).alias("stretch"), F.col(order[0]).alias("__ts"),
        F.unix_micros(order[0]).alias("o0"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order[1:], 1)], F.col(value).cast("double").alias("value"),
    ).filter("key is not null and stretch is not null and value is not null").withWatermark("__ts", watermark)
    names = [f"o{i}" for i in range(len(order))]
    types = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    kind = rows.schema["key"].dataType.simpleString()
    runs = rows.groupBy("key", "stretch").transformWithStateInPandas(
        Runs(names, types, alpha, stretch_ms), f"key {kind}, stretch bigint, n bigint, shift double, first double",
        outputMode="Update", timeMode="EventTime",
    )
    return start_changes(runs, f"{path}/runs", checkpoint)


def current_ema(runs: DataFrame, alpha: float = batch.EMA_ALPHA) -> DataFrame:
    """(key, n, ema) from the written maps of ``start_ema``: the last of each stretch, in turn."""
    now = latest(runs, ["key", "stretch"])
    in_turn = F.array_sort(F.collect_list(F.struct("stretch", "n", "shift", "first")))  # one entry a stretch
    keyed = now.groupBy("key").agg(F.sum("n").alias("n"), in_turn.alias("runs"))
    step = F.aggregate("runs", F.col("runs")[0]["first"], lambda x, r: x * F.pow(F.lit(1.0 - alpha), r["n"]) + r["shift"])
    return keyed.select("key", "n", step.alias("ema"))
