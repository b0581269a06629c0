"""Encryption of the parts of findings that quote the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypt_value(value: Column, key: Column) -> Column:
    """AES-GCM with a fresh initialization vector, as base64 text."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def decrypt_value(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def _protected(df: DataFrame, text_col: str | None, entities_col: str | None, change: Callable[[Column], Column]) -> DataFrame:
    def entity(e: Column) -> Column:
        return e.withField("text", change(e["text"])).withField("context", change(e["context"]))

    missing = [c for c in (text_col, entities_col) if c and c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}; name the columns to protect, or None for none")
    if entities_col:
        df = df.withColumn(entities_col, F.transform(entities_col, entity))
    if text_col:
        df = df.withColumn(text_col, change(F.col(text_col)))
    return df


def encrypt_findings(
    df: DataFrame, key: Column, text_col: str | None = "text", entities_col: str | None = "entities"
) -> DataFrame:
    """Encrypt the text and each span's text and context, by default the columns that ``detect`` gives.

    ``key`` is 16, 24 or 32 bytes. A named column that is absent is an error.
    """
    return _protected(df, text_col, entities_col, lambda c: encrypt_value(c, key))


def decrypt_findings(
    df: DataFrame, key: Column, text_col: str | None = "text", entities_col: str | None = "entities"
) -> DataFrame:
    return _protected(df, text_col, entities_col, lambda c: decrypt_value(c, key))
