"""Counters, histograms and alerts as aggregations.

All counts are partial sums per task before they are shuffled, so a label that holds most of the
rows costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import registry, scoring

# --- Fixed values: histogram bounds and alert rules.
REQUEST_DURATION_BUCKETS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
DETECTION_DURATION_BUCKETS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0]
CONFIDENCE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
MASKING_DURATION_BUCKETS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5]
BLOCKED_ALERT_THRESHOLD = 10
# --- end of fixed values


def counter(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("value"))


def histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (labels, le, bucket_count) with the sum and count of the series.

    The last bucket, ``+Inf``, counts every observation.
    """
    x = F.col(value)
    sums = [F.count_if(x <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)]
    series = df.groupBy(*labels).agg(*sums, F.count(x).alias("series_count"), F.sum(x).alias("series_sum"))
    buckets = F.array(
        *[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("series_count").alias("bucket_count")),
    )
    return series.select(*labels, F.inline(buckets), "series_sum", "series_count")


def entity_rows(df: DataFrame) -> DataFrame:
    """One row per detected span, with its type, confidence and level."""
    others = [c for c in df.columns if c not in ("entities", "detection_metadata")]
    return (
        df.select(*others, F.explode("entities").alias("__e"))
        .withColumn("entity_type", F.col("__e.entity_type"))
        .withColumn("confidence", F.col("__e.confidence"))
        .withColumn("confidence_level", scoring.confidence_level(F.col("__e.confidence")))
        .drop("__e")
    )


def request_counter(df: DataFrame) -> DataFrame:
    return counter(df.withColumn("status_code", F.col("status_code").cast("string")), ["method", "endpoint", "status_code"])


def request_duration(df: DataFrame) -> DataFrame:
    return histogram(df, ["method", "endpoint"], "duration", REQUEST_DURATION_BUCKETS)


def detection_counter(detected: DataFrame) -> DataFrame:
    return counter(entity_rows(detected), ["entity_type", "confidence_level"])


def detection_duration(df: DataFrame) -> DataFrame:
    return histogram(df, ["detection_method"], "duration", DETECTION_DURATION_BUCKETS)


def confidence_histogram(detected: DataFrame) -> DataFrame:
    return histogram(entity_rows(detected), ["entity_type"], "confidence", CONFIDENCE_BUCKETS)


def masking_counter(masked: DataFrame) -> DataFrame:
    """Masking operations by strategy and type, from a table with entities and masking_methods."""
    rows = masked.select("masking_methods", F.explode("entities").alias("__e")).select(
        F.try_element_at("masking_methods", F.col("__e.entity_type")).alias("mask_type"),
        F.col("__e.entity_type").alias("entity_type"),
    )
    return counter(rows, ["mask_type", "entity_type"])


def masking_duration(df: DataFrame) -> DataFrame:
    return histogram(df, ["mask_type"], "duration", MASKING_DURATION_BUCKETS)


def decision_counter(df: DataFrame) -> DataFrame:
    return counter(df, ["action", "policy_name", "user_role"])


def blocked_counter(df: DataFrame) -> DataFrame:
    blocked = df.filter(F.col("action") == "block").withColumn("block_reason", F.lit("policy_violation"))
    return counter(blocked, ["block_reason", "user_role"])


def cache_counter(df: DataFrame) -> DataFrame:
    return counter(df, ["operation", "cache_type", "result"])


def cache_hit_rate(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Last reported rate per cache type; of rates reported at one time, the highest."""
    return df.groupBy("cache_type").agg(F.max_by("hit_rate", F.struct(ts, "hit_rate")).alias("hit_rate"))


def error_counter(df: DataFrame) -> DataFrame:
    return counter(df, ["error_type", "component"])


def high_risk_counter(detected: DataFrame, source: str = "source") -> DataFrame:
    rows = entity_rows(detected).filter(F.col("entity_type").isin(registry.HIGH_RISK_TYPES))
    return counter(rows.withColumnRenamed(source, "source"), ["entity_type", "source"])


@dataclass(frozen=True)
class AlertRule:
    """``measure`` is a column of the windowed rates; the rule holds while it exceeds the threshold."""

    name: str
    measure: str
    threshold: float
    severity: str = "warning"
    description: str = ""
    enabled: bool = True


# --- Fixed values.
DEFAULT_RULES = [
    AlertRule("high_error_rate", "error_rate", 0.05, "critical", "Error rate exceeds 5%"),
    AlertRule("high_response_time", "avg_response_time", 2.0, "warning", "Average response time exceeds 2 seconds"),
]
# --- end of fixed values


def windowed_rates(
    df: DataFrame, is_error: Column, duration: Column, ts: str = "ts", every: str = "1 hour"
) -> DataFrame:
    """(window_start, requests, error_rate, avg_response_time); also for streams with a watermark."""
    return (
        df.groupBy(F.window(ts, every).alias("window"))
        .agg(
            F.count("*").alias("requests"),
            (F.count_if(is_error) / F.count("*")).alias("error_rate"),
            F.avg(duration).alias("avg_response_time"),
        )
        .select(F.col("window.start").alias("window_start"), "requests", "error_rate", "avg_response_time")
    )


def rule_states(rates: DataFrame, rules: list[AlertRule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per window and enabled rule: is it triggered? ``keep`` names columns to keep."""
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.description).alias("description"),
            F.col(r.measure).alias("value"),
            F.coalesce(F.col(r.measure) > F.lit(r.threshold), F.lit(False)).alias("triggered"),
        )
        for r in (DEFAULT_RULES if rules is None else rules)
        if r.enabled
    ]
    return rates.select("window_start", *(keep or []), F.inline(F.array(*rows)))


def alert_transitions(rates: DataFrame, rules: list[AlertRule] | None = None) -> DataFrame:
    """Windows in which a rule starts to hold (active) or stops to (resolved).

    The windows of one rule are compared in order; there are as many as time slots, not rows.
    """
    before = F.lag("triggered").over(Window.partitionBy("rule").orderBy("window_start"))
    was = F.coalesce(before, F.lit(False))
    changed = rule_states(rates, rules).withColumn("was", was).filter(F.col("was") != F.col("triggered"))
    return changed.select(
        "rule", "severity", "window_start", "value",
        F.when(F.col("triggered"), F.lit("active")).otherwise(F.lit("resolved")).alias("status"),
    )


def blocked_alerts(
    df: DataFrame,
    is_blocked: Column,
    threshold: int = BLOCKED_ALERT_THRESHOLD,
    every: str = "1 hour",
    ts: str = "ts",
) -> DataFrame:
    """Time windows with more blocked requests than the threshold."""
    return (
        df.filter(is_blocked)
        .groupBy(F.window(ts, every).alias("window"))
        .agg(F.count("*").alias("blocked"))
        .filter(F.col("blocked") > threshold)
        .select(F.col("window.start").alias("window_start"), "blocked")
    )
