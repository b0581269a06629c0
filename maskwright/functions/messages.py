"""Texts that detection, policy and masking produce."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: message and token formats.
BLOCKED_TEXT = "[CONTENT BLOCKED DUE TO PII DETECTION]"
BLOCK_MESSAGE = (
    "Content blocked due to sensitive information detection. Detected PII types: {types}. Risk Score: {risk}"
)
WARNING = "PII detected: {entity_type}"
REASON_NONE = "No PII detected"
REASON_TOO_MANY = "Too many PII entities detected: {count} > {limit}"
REASON_HIGH_CONFIDENCE = "High confidence PII detected: {confidence} >= {limit}"
REASON_ENTITY = "{entity_type}: {action} (confidence: {confidence})"
REASON_HIGH_RISK = "High-risk PII detected: {types}"
REDACTED_TOKEN = "[REDACTED_{entity_type}]"
HASH_TOKEN = "[HASH_{digest}]"
SYNTHETIC_TOKEN = "[SYNTHETIC_{entity_type}]"
ERROR_DEFAULT_ACTION_MISSING = "default_policy missing 'action' field"
ERROR_DEFAULT_ACTION_INVALID = "Invalid action in default_policy: {action}"
ERROR_ACTION_MISSING = "Entity policy '{name}' missing 'action' field"
ERROR_ACTION_INVALID = "Invalid action for '{name}': {action}"
ERROR_MASK_TYPE = "Invalid mask_type for '{name}': {mask_type}"
ERROR_THRESHOLD = "Invalid confidence_threshold for '{name}': {threshold}"
# --- end of fixed values


def fill(template: str, **values: Column | str) -> Column:
    """The template with columns in place of its names; null if one of them is null."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            value = values[name]
            parts.append(value if isinstance(value, Column) else F.lit(value))
    return F.concat(*parts)
