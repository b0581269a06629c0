"""Compaction of the audit table: the same rows before, during and after, whatever fails."""

import glob
import os
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from maskwright.operators import batch
from maskwright.sources import audit

START = datetime(2024, 3, 1)


def batch_of(spark, i):
    rows = [(i * 100 + j, START + timedelta(hours=5 * j + i), "u", "s", 1, 0.5) for j in range(30)]
    df = spark.createDataFrame(rows, "request_id bigint, ts timestamp, user_id string, session_id string, entities_detected int, risk_score double")
    return audit.audit_events(df, "detection")


def ids(spark, path):
    return sorted(r["event_id"] for r in audit.read_audit(spark, path).select("event_id").collect())


def test_readers_follow_the_manifest(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(6):
        audit.write_batch(batch_of(spark, i), path, i)
    before = ids(spark, path)
    assert len(before) == 180 and audit.compact_audit(spark, path, -1) == 0
    assert audit.compact_audit(spark, path, 3) == 1 and ids(spark, path) == before
    assert audit.compact_audit(spark, path, 3) == 1  # nothing new
    audit.write_batch(batch_of(spark, 5), path, 5)  # the last batch again
    audit.write_batch(batch_of(spark, 6), path, 6)
    after = sorted(before + [r["event_id"] for r in batch_of(spark, 6).collect()])
    assert ids(spark, path) == after
    # A compaction that stops before its commit leaves a folder that no reader sees.
    batch_of(spark, 9).write.partitionBy("event_date").parquet(f"{path}/_compacted/left-over")
    os.makedirs(f"{path}/_manifest/000000000009")
    assert ids(spark, path) == after
    assert audit.compact_audit(spark, path, 5) == 2 and ids(spark, path) == after
    folder = audit._manifest(spark, path)[1]
    days = glob.glob(f"{folder.removeprefix('file:')}/event_date=*")
    assert len(days) >= 6 and all(len(glob.glob(f"{d}/*.parquet")) == 1 for d in days)


def test_one_of_two_compactions_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    for i in range(3):
        audit.write_batch(batch_of(spark, i), path, i)
    before = ids(spark, path)
    assert audit.compact_audit(spark, path, 1) == 1
    monkeypatch.setattr(audit, "_manifest", lambda *_: (0, None, -1))  # what the other one has read
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        audit.compact_audit(spark, path, 2)
    monkeypatch.undo()
    assert ids(spark, path) == before


def test_reports_prune_days_of_compacted_events(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(2):
        audit.write_batch(batch_of(spark, i), path, i)
    audit.compact_audit(spark, path, 0)
    found = audit.read_audit(spark, path).filter(F.col("event_date") == F.lit(START.date()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)", plan)
    assert len(filters) == 2 and all("event_date" in f for f in filters) and found.count() == 10


def test_failed_texts_have_results_of_their_own(spark):
    df = spark.createDataFrame([("r", 0, "mail a@b.co"), ("r", 1, None), ("r", 2, ""), ("q", 0, None)], "request_id string, position int, text string")
    got = {(r["request_id"], r["position"]): (len(r["entities"]), r["risk_score"], r["has_high_risk_pii"], r["error"]) for r in batch.batch_results(df).collect()}
    assert got[("r", 0)][0] == 1 and got[("r", 0)][3] is None and got[("r", 2)] == (0, 0.0, False, None)
    assert got[("r", 1)] == got[("q", 0)] == (0, 0.0, False, batch.NO_TEXT)
