"""Redaction of log records: by field name and by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.regex import jvm_regex, replacing
from maskwright.functions.spans import let

# --- Fixed values: order matters, each pattern sees the result of those before it.
LOG_PATTERNS = [
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "[CREDIT_CARD]"),
]
SENSITIVE_FIELDS = [
    "password", "token", "key", "secret", "ssn", "social_security",
    "credit_card", "card_number", "email", "phone", "address",
]
REDACTED = "[REDACTED]"
LOG_LEVELS = ["debug", "info", "warning", "error"]
# --- end of fixed values


# Work savers, one per pattern: a test its matches imply, and the class their first character is in.
_GATES = [("@", ""), (r"\d{4}", r"\d"), (r"-\d{4}", r"\d"), (r"\d{4}", r"\d")]


def _replaced(text: Column, pattern: str, label: str, gate: str, lead: str) -> Column:
    regex, before, _ = replacing(pattern, lead=lead)
    return let(
        text,
        lambda t: F.when(
            F.rlike(t, F.lit(jvm_regex(gate))), F.regexp_replace(t, F.lit(regex), F.lit(before + label))
        ).otherwise(t),
    )


def redact_string(text: Column) -> Column:
    for (pattern, label), (gate, lead) in zip(LOG_PATTERNS, _GATES, strict=True):
        text = _replaced(text, pattern, label, gate, lead)
    return text


def is_sensitive(name: str) -> bool:
    return name.lower() in SENSITIVE_FIELDS


def _redact_value(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return redact_string(value)
    if isinstance(kind, T.StructType):
        fields = [
            (F.lit(REDACTED) if is_sensitive(f.name) else _redact_value(value[f.name], f.dataType)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        text = isinstance(kind.valueType, T.StringType)
        hidden = F.lit(REDACTED if text else None).cast(_redacted_type(kind.valueType))

        def of(k: Column, v: Column) -> Column:
            return F.when(F.lower(k).isin(SENSITIVE_FIELDS), hidden).otherwise(_redact_value(v, kind.valueType))

        return F.transform_values(value, of)
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _redact_value(v, kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _redact_value(v, kind.elementType))
    return value


def _redacted_type(kind: T.DataType) -> T.DataType:
    """The type a value has after redaction: sensitive fields of records become strings."""
    if isinstance(kind, T.StructType):
        fields = [
            T.StructField(f.name, T.StringType() if is_sensitive(f.name) else _redacted_type(f.dataType)) for f in kind.fields
        ]
        return T.StructType(fields)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _redacted_type(kind.valueType))
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_redacted_type(kind.elementType))
    return kind


def redact_fields(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Redact every column of a table of log records; nested records are walked by schema.

    A field with a sensitive name becomes ``[REDACTED]`` whatever its type. Lists and maps are
    walked; a sensitive key of a map becomes ``[REDACTED]`` where the map holds strings and null
    where it holds anything else.
    """
    columns = [
        F.col(f"`{f.name}`")
        if f.name in keep
        else (F.lit(REDACTED) if is_sensitive(f.name) else _redact_value(F.col(f"`{f.name}`"), f.dataType)).alias(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


def known_level(level: Column) -> Column:
    """Log levels that are written; records of other levels are dropped."""
    return F.lower(level).isin(LOG_LEVELS)


def redacted_log(df: DataFrame, level_col: str = "level", message_col: str = "message") -> DataFrame:
    """Log records of known levels with all fields but level and message redacted."""
    return redact_fields(df.filter(known_level(F.col(level_col))), keep=(level_col, message_col))
