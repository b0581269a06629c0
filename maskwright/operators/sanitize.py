"""Table operators that rewrite text: mask, sanitize, prepare outbound text, scan output."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import masking, policy as policies, scoring, spans
from maskwright.functions.messages import BLOCKED_TEXT, WARNING, fill
from maskwright.functions.policy import Policy
from maskwright.functions.regex import SPACE
from maskwright.functions.reuse import built_once
from maskwright.operators.detect import detect

# --- Fixed values: limits and tones.
OUTBOUND_MAX_LENGTH = 10000
OUTBOUND_TONES = ["clear", "professional", "friendly"]
# --- end of fixed values


def _as_config(config: Column | Mapping[str, Mapping[str, Any]]) -> Column:
    return config if isinstance(config, Column) else masking.config_map(config)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~F.rlike(text, F.lit(f"[^{SPACE}]"))


def reject_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.filter(~is_blank(F.col(text_col)))


def outbound_valid(text: Column, tone: Column | str = "clear", max_length: int = OUTBOUND_MAX_LENGTH) -> Column:
    tone = tone if isinstance(tone, Column) else F.lit(tone)
    return (
        F.coalesce(tone.isin(OUTBOUND_TONES), F.lit(False))
        & ~is_blank(text)
        & F.coalesce(F.length(text) <= max_length, F.lit(False))
    )


def outbound_status(text: Column, tone: Column | str = "clear", max_length: int = OUTBOUND_MAX_LENGTH) -> Column:
    """``ok``, or why the text cannot be sent."""
    tone_col = tone if isinstance(tone, Column) else F.lit(tone)
    return (
        F.when(~F.coalesce(tone_col.isin(OUTBOUND_TONES), F.lit(False)), F.lit("unsupported_tone"))
        .when(~outbound_valid(text, tone_col, max_length), F.lit("invalid_length"))
        .otherwise(F.lit("ok"))
    )


def _with_masked(
    df: DataFrame, text_col: str, config: Column | Mapping[str, Mapping[str, Any]], seed: int, disjoint: bool
) -> DataFrame:
    """Add masked_text, entities_masked and masking_methods to a table with entities."""
    text, entities = F.col(text_col), F.col("entities")
    key = None if isinstance(config, Column) else (text_col, json.dumps(config), seed, disjoint)

    def build() -> Column:
        settings = _as_config(config)
        return F.struct(
            masking.mask_text(text, entities, settings, seed, disjoint).alias("masked_text"),
            masking.entities_masked(entities).alias("entities_masked"),
            masking.masking_methods(entities, settings).alias("masking_methods"),
        )

    masked = built_once(key and ("masked", *key), build)
    return df.select("*", F.inline(F.array(masked)))


def mask(
    df: DataFrame,
    config: Column | Mapping[str, Mapping[str, Any]] | None = None,
    text_col: str = "text",
    policy: Policy | None = None,
    seed: int = 0,
    external_col: str | None = None,
) -> DataFrame:
    """Detect, then mask with the given settings or those of the policy."""
    if config is None:
        config = (policy or Policy()).default_masking_config()
    found = detect(df, text_col, external_col=external_col)
    return _with_masked(found, text_col, config, seed, disjoint=True)


def mask_uniform(
    df: DataFrame, mask_type: str = "partial", text_col: str = "text", seed: int = 0, external_col: str | None = None
) -> DataFrame:
    """Detect, then mask every type with one strategy."""
    return mask(df, {"DEFAULT": {"mask_type": mask_type}}, text_col, seed=seed, external_col=external_col)


def mask_provided(
    df: DataFrame,
    config: Column | Mapping[str, Mapping[str, Any]] | None = None,
    text_col: str = "text",
    spans_col: str = "provided_entities",
    policy: Policy | None = None,
    seed: int = 0,
) -> DataFrame:
    """Mask caller-given spans, without detection.

    Rows without spans get status ``no_entities`` and no masked text.
    """
    if config is None:
        config = (policy or Policy()).default_masking_config()
    given = F.coalesce(F.size(F.col(spans_col)) > 0, F.lit(False))
    ready = df.select(
        "*",
        F.when(given, F.col(spans_col)).alias("entities"),
        F.when(given, F.lit(0.0)).alias("risk_score"),
        F.when(given, F.lit(False)).alias("has_high_risk_pii"),
        F.when(given, F.lit("ok")).otherwise(F.lit("no_entities")).alias("status"),
    )
    return _with_masked(ready, text_col, config, seed, disjoint=False)


def sanitized(text: Column, entities: Column, risk: Column, decision: Column) -> Column:
    """Struct of what a policy decision makes of a text."""
    action = decision["action"]
    return F.struct(
        F.when(action == "block", F.lit(BLOCKED_TEXT))
        .when(action == "mask", masking.mask_text(text, entities, decision["masking_config"]))
        .otherwise(text)
        .alias("sanitized_text"),
        F.when(
            action == "warn",
            F.transform(entities, lambda e: fill(WARNING, entity_type=e["entity_type"])),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("warnings"),
        F.when(action == "block", scoring.block_message(entities, risk)).alias("blocked_reason"),
    )


def evaluate_policy(
    df: DataFrame,
    policy: Policy | Column | None = None,
    role: Column | str = "user",
    bypass: Column | bool = False,
) -> DataFrame:
    """Add the decision struct to a table that has entities. ``policy`` may be a column with the rules
    that hold for each row."""
    policy = Policy() if policy is None else policy
    fixed = isinstance(policy, Policy) and isinstance(role, str) and isinstance(bypass, bool)
    decision = built_once(
        ("decide", policy.key, role, bypass) if fixed else None,
        lambda: policies.decide(F.col("entities"), policy, role, bypass),
    )
    return df.withColumn("decision", decision)


def sanitize(
    df: DataFrame,
    policy: Policy | Column | None = None,
    role: Column | str = "user",
    bypass: Column | bool = False,
    text_col: str = "text",
    external_col: str | None = None,
) -> DataFrame:
    """Detect, decide and rewrite: block, mask, warn or allow every row."""
    decided = evaluate_policy(detect(df, text_col, external_col), policy, role, bypass)
    outcome = built_once(
        ("sanitized", text_col),
        lambda: F.inline(
            F.array(sanitized(F.col(text_col), F.col("entities"), F.col("risk_score"), F.col("decision")))
        ),
    )
    return decided.select("*", F.col("decision.action").alias("action_taken"), outcome)


def prepare_outbound(
    df: DataFrame,
    policy: Policy | None = None,
    text_col: str = "text",
    tone: Column | str = "clear",
    max_length: int = OUTBOUND_MAX_LENGTH,
) -> DataFrame:
    """Text that may leave: every span redacted, nothing at all for blocked or invalid rows.

    ``status`` is ok, blocked, unsupported_tone or invalid_length.
    """
    text, entities = F.col(text_col), F.col("entities")
    checked = df.withColumn("status", outbound_status(text, tone, max_length))
    decided = evaluate_policy(detect(checked, text_col), policy)
    status = F.when(
        (F.col("status") == "ok") & (F.col("decision.action") == "block"), F.lit("blocked")
    ).otherwise(F.col("status"))
    return (
        decided.withColumn("status", status)
        .withColumn("sent_text", F.when(F.col("status") == "ok", masking.redact_text(text, entities)))
        .withColumn("detected_entity_types", scoring.entity_types(entities))
        .withColumn("detected_entity_count", F.size(entities))
    )


def scan_output(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Redact every span of generated text."""
    return detect(df, text_col).withColumn(
        "redacted_text", masking.redact_text(F.col(text_col), F.col("entities"))
    )
