"""Grouped operators against brute force, with one key holding much of the data."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from maskwright.operators import batch, metrics
from maskwright.operators.skew import frequent, hot_keys, join_unique
from maskwright.sources import audit
from maskwright.streaming import jobs

START = datetime(2024, 1, 1)


def misses_of(times, ttl):
    since, misses = None, 0
    for t in sorted(times):
        if since is None or t >= since + ttl:
            since, misses = t, misses + 1
    return misses


def skewed_requests(seed, n=900):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", START + timedelta(seconds=rng.randint(0, 40_000)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("max_times", [1_000_000, 60, 0])
def test_reuse_accounting(spark, max_times):
    rows = skewed_requests(1)
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    ttl = timedelta(seconds=600)
    got = {r["key"]: r for r in batch.reuse_accounting(df, "key", ttl_seconds=600, max_times=max_times).collect()}
    for key in {k for k, _ in rows}:
        times = [t for k, t in rows if k == key]
        assert got[key]["misses"] == misses_of(times, ttl), key
        assert got[key]["hits"] == len(times) - got[key]["misses"]


def test_ema_and_continuation(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, START + timedelta(hours=rng.randint(0, 200)), rng.random() * 100) for i in range(600)]
    rows.sort(key=lambda r: (r[2], r[1]))

    def brute(part):
        state = {}
        for k, _, _, v in part:
            state[k] = v if k not in state else 0.1 * v + 0.9 * state[k]
        return state

    schema = "key string, id int, ts timestamp, v double"
    df = spark.createDataFrame(rows, schema)
    got = {r["key"]: r["ema"] for r in batch.ema(df, "key", ["ts", "id"], "v").collect()}
    assert got == pytest.approx(brute(rows))
    first = batch.ema(spark.createDataFrame(rows[:250], schema), "key", ["ts", "id"], "v")
    both = batch.ema(spark.createDataFrame(rows[250:], schema), "key", ["ts", "id"], "v", before=first)
    assert {r["key"]: r["ema"] for r in both.collect()} == pytest.approx(brute(rows))
    assert sum(r["n"] for r in both.collect()) == 600


def test_join_unique_splits_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(50)).cast("string"))).alias("key"))
    rows = rows.withColumn("key", F.when(F.col("id") % 100 == 7, F.lit(None)).otherwise(F.col("key")))
    lookup = rows.filter("key is not null and key != 'k5'").select("key").distinct().withColumn("v", F.upper("key"))
    joined = join_unique(rows, lookup, "key", [F.col("id")], rows_per_slice=50)
    assert joined.count() == 3000
    assert joined.filter("key is not null and key != 'k5' and v is distinct from upper(key)").count() == 0
    assert joined.filter("(key is null or key = 'k5') and v is not null").count() == 0


def test_join_unique_splits_any_number_of_hot_keys(spark):
    rows = spark.range(60_000).select("id", F.pmod("id", F.lit(1500)).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    assert hot_keys(counts, "key", 20).filter("__slices = 2").count() == 1500
    joined = join_unique(rows, counts, "key", [F.col("id")], rows_per_slice=20)
    assert joined.count() == 60_000 and joined.filter("n <> 40").count() == 0


def test_detect_distinct_with_one_text_in_a_third_of_rows(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.lit("mail a@b.co")).when(F.col("id") % 3 == 1, F.concat(F.lit("n "), F.col("id").cast("string"))).alias("text"))
    rows = batch.detect_distinct(df, ["id"]).collect()
    assert len(rows) == 300
    assert sum(len(r["entities"] or []) for r in rows) == 100


def test_batch_summary_with_failures(spark):
    texts = ["mail a@b.co", None, "ssn 123-45-6789"] * 7
    df = spark.createDataFrame([("r1", texts), ("r2", [])], "request_id string, texts array<string>")
    exploded = batch.explode_requests(df)
    assert [r["position"] for r in exploded.sort("position").collect()] == list(range(21))
    row = batch.batch_summary(exploded).first()
    assert (row["total_texts_processed"], row["batches_processed"], row["average_batch_size"]) == (21, 3, 7.0)
    assert (row["total_entities_detected"], row["high_risk_texts"], row["failed_texts"]) == (14, 7, 7)


def test_histogram_and_alerts(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("a", 99.0), ("b", None)], "l string, x double")
    rows = {(r["l"], r["le"]): r["bucket_count"] for r in metrics.histogram(df, ["l"], "x", [0.1, 0.25, 0.5]).collect()}
    assert [rows[("a", le)] for le in ("0.1", "0.25", "0.5", "+Inf")] == [1, 1, 2, 3] and rows[("b", "+Inf")] == 0
    rates = spark.createDataFrame([(START + timedelta(hours=h), 1, e, 0.0) for h, e in enumerate([0.0, 0.1, 0.2, 0.0, 0.3])], "window_start timestamp, requests long, error_rate double, avg_response_time double")
    changes = metrics.alert_transitions(rates).sort("window_start").collect()
    assert [(r["window_start"].hour, r["status"], r["severity"]) for r in changes] == [(1, "active", "critical"), (3, "resolved", "critical"), (4, "active", "critical")]


def request_rows(spark, n=50):
    return spark.range(n).selectExpr(
        "cast(id as string) as request_id", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int)) as ts",
        "case when id % 2 = 0 then 'block' else 'allow' end as action_taken", "'default' as policy_name", "'user' as user_role",
        "cast(id % 3 as int) as entities_detected", "id / 100 as risk_score", "1.5 as processing_time_ms", "cast(null as string) as blocked_reason",
    )


def test_audit_events_sinks_and_reports(spark, tmp_path):
    events = audit.audit_events(request_rows(spark), "sanitization").cache()
    assert events.select("event_id").distinct().count() == 50
    assert events.count() == audit.audit_events(request_rows(spark), "sanitization").join(events, "event_id").count()
    audit.write_audit(events, str(tmp_path / "lines"))
    line = spark.read.text(str(tmp_path / "lines")).first()[0]
    assert '"details":{' in line and '"session_id":null' in line and '"blocked_reason":null' in line
    sink = audit.bulk_audit_sink(str(tmp_path / "table"))
    sink(events, 0)
    sink(events, 0)  # the same batch again
    back = audit.read_audit(spark, str(tmp_path / "table"))
    assert back.count() == 50
    start, end = START + timedelta(hours=10), START + timedelta(hours=30)
    blocked = audit.blocked_report(back, start, end)
    assert blocked.count() == 11 and blocked.first()["timestamp"] == start
    plan = blocked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    found = audit.detection_report(audit.audit_events(request_rows(spark), "detection"), start, end).collect()
    values = {(r["metric"], r["bucket"]): r["value"] for r in found}
    assert values[("total_detections", None)] == 21 and values[("average_risk_score", None)] == pytest.approx(0.2)
    assert values[("entities_distribution", 0)] == 7
    empty = audit.detection_report(events, start, end).collect()
    assert {(r["metric"], r["value"]) for r in empty} == {("total_detections", 0.0), ("total_documents", 0.0), ("average_risk_score", None)}


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    """The event table in five files, in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    for i, name in enumerate(sorted(glob.glob(f"{folder}/in/part-*.parquet"))):
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))  # streams take the oldest file first
    return f"{folder}/in", df


def same_averages(found, want):
    rows = found.collect()
    assert {r["key"]: r["n"] for r in rows} == {k: n for k, (n, _) in want.items()}
    assert {r["key"]: r["ema"] for r in rows} == pytest.approx({k: x for k, (_, x) in want.items()})


def test_streams_in_several_batches_equal_batch_results(spark, event_files, tmp_path):
    folder, df = event_files
    stream = jobs.read_stream(spark, f"{folder}/*.parquet", df.schema, per_trigger=1)

    counts = jobs.windowed_counter(stream, ["event_type"])
    jobs.start_changes(counts, f"{tmp_path}/c", f"{tmp_path}/c_cp").awaitTermination()
    now = jobs.latest(spark.read.parquet(f"{tmp_path}/c"), ["window_start", "event_type"])
    assert sorted(map(tuple, now.collect())) == sorted(map(tuple, jobs.windowed_counter(df, ["event_type"]).collect()))

    requests = stream.select(F.col("event_type").alias("key"), "ts")
    jobs.start_reuse(requests, f"{tmp_path}/r", f"{tmp_path}/r_cp", "key", ttl_seconds=7200).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/r/counts").groupBy("key").agg(F.sum("requests"), F.sum("misses"))
    want = batch.reuse_accounting(df.withColumnRenamed("event_type", "key"), "key", ttl_seconds=7200).select("key", "requests", "misses")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    keyed = stream.withColumnRenamed("event_type", "key")
    jobs.start_ema(keyed, f"{tmp_path}/e", f"{tmp_path}/e_cp", "key", ["ts", "event_id"], "value").awaitTermination()
    ema_now = jobs.current_ema(spark.read.parquet(f"{tmp_path}/e/runs"))
    ema_want = batch.ema(df.withColumnRenamed("event_type", "key"), "key", ["ts", "event_id"], "value")
    same_averages(ema_now, {r["key"]: (r["n"], r["ema"]) for r in ema_want.collect()})
    assert not os.path.exists(f"{tmp_path}/e/state")


def test_alerts_go_on_from_the_checkpoint_and_judge_the_last_windows(spark, event_files, tmp_path):
    is_error, duration = F.col("event_type") == "error", F.col("value") / 50
    every = metrics.alert_transitions(metrics.windowed_rates(event_files[1], is_error, duration))
    # The events end in a window that brings a change.
    df = event_files[1].filter(F.col("ts") < F.lit(every.agg(F.max("window_start")).first()[0] + timedelta(hours=1)))
    df.repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/files")
    files = sorted(glob.glob(f"{tmp_path}/files/part-*.parquet"))
    os.makedirs(f"{tmp_path}/in")
    for i, name in enumerate(files):
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    want = metrics.alert_transitions(metrics.windowed_rates(df, is_error, duration)).select("rule", "window_start", "status", F.round("value", 9))
    want = sorted(map(tuple, want.collect()))

    def run():
        stream = jobs.read_stream(spark, f"{tmp_path}/in/*.parquet", df.schema, per_trigger=1)
        jobs.start_alerts(stream, f"{tmp_path}/a", f"{tmp_path}/cp", is_error, duration).awaitTermination()
        found = spark.read.parquet(f"{tmp_path}/a/changes").select("rule", "window_start", "status", F.round("value", 9))
        return sorted(map(tuple, found.collect()))

    for part in (files[:3], files[3:]):  # the second run goes on where the first has ended
        for name in part:
            os.link(name, f"{tmp_path}/in/{os.path.basename(name)}")
        found = run()
        newest = spark.read.parquet(f"{tmp_path}/in").agg(F.max("ts")).first()[0]
        assert found == [r for r in want if r[1] + timedelta(hours=1) <= newest - timedelta(hours=1)]
    jobs.complete_until(spark, f"{tmp_path}/a", F.lit(newest + timedelta(hours=3)))
    assert run() == want and len(want) > len(found)
    assert run() == want  # nothing new: nothing changes
    assert not os.path.exists(f"{tmp_path}/a/state")


def test_streamed_averages_place_late_rows_in_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), i, START + timedelta(minutes=20 * i), rng.random()) for i in range(90)]
    rows += [("a", 500, rows[7][2], 0.5), ("a", 500, rows[7][2], 0.5), (None, 501, START, 1.0), ("b", 502, START, None)]  # ties, nulls
    come = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.randint(0, 170)))
    late = ("a", 503, START, 9.0)  # after all others: beyond the watermark
    schema = "key string, id int, ts timestamp, v double"
    for n, part in enumerate((come[:40], come[40:41], come[41:80], [*come[80:], late])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = jobs.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, per_trigger=1)
        jobs.start_ema(stream, f"{tmp_path}/e", f"{tmp_path}/cp", "key", ["ts", "id"], "v", stretch="2 hours", watermark="3 hours").awaitTermination()
    state = {}
    for k, _, _, v in sorted((r for r in rows if r[0] and r[3] is not None), key=lambda r: (r[2], r[1])):
        n, x = state.get(k, (0, v))
        state[k] = n + 1, 0.1 * v + 0.9 * x
    found = jobs.current_ema(spark.read.parquet(f"{tmp_path}/e/runs"))
    same_averages(found, state)


def test_stream_queries_read_files_and_folders(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/folder/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/one")
    os.makedirs(f"{tmp_path}/file")
    os.rename(glob.glob(f"{tmp_path}/one/part-*.parquet")[0], f"{tmp_path}/file/events.parquet")
    for kind in ("folder", "file"):
        found = spark_entry.queries()["stream_counters"](spark, f"{tmp_path}/{kind}")
        assert found.agg(F.sum("value")).first()[0] == events.count()


def test_stream_state_operators_keep_late_requests_as_hits(spark):
    before = spark.createDataFrame([("a", START)], "key string, since timestamp")
    rows = [("a", START - timedelta(minutes=5)), ("a", START + timedelta(minutes=1)), ("a", START + timedelta(minutes=40)), ("b", START)]
    got = {r["key"]: r for r in batch.reuse_from(spark.createDataFrame(rows, "key string, ts timestamp"), before, "key").collect()}
    assert (got["a"]["requests"], got["a"]["misses"], got["a"]["hits"]) == (3, 1, 2)
    assert (got["b"]["misses"], got["b"]["last_miss"]) == (1, START)


def test_frequent_keys_are_counted_exactly(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit("warm")).when(F.col("id") % 7 == 1, None).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 60_000, 1, 16).select(key.alias("key"))
    found = {r["__h"]: r["n"] for r in frequent(rows, F.col("key")).collect()}
    exact = {r["h"]: r["n"] for r in rows.filter("key is not null").groupBy(F.xxhash64("key").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert all(exact[h] == n for h, n in found.items()) and len(found) <= 1024
    assert {h for h, n in exact.items() if n > 60} <= set(found)  # a thousandth
    assert frequent(rows.limit(0), F.col("key")).count() == 0
