"""Spans found by another model, given as a table, as input to detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import registry
from maskwright.functions.spans import RAW_SPAN, slice_text

# Lower than any recognizer's number, so external spans win ties; one text has fewer spans.
_FIRST_SEQ = -1_000_000_000


def _renamed(entity_type: Column) -> Column:
    for old, new in registry.EXTERNAL_LABEL_RENAMES.items():
        entity_type = F.when(entity_type == old, F.lit(new)).otherwise(entity_type)
    return entity_type


def model_predictions(spans: DataFrame) -> DataFrame:
    """Model output with the default confidence where the model gave none."""
    return spans.withColumn(
        "confidence", F.coalesce("confidence", F.lit(registry.EXTERNAL_DEFAULT_CONFIDENCE))
    )


def external_spans(texts: DataFrame, spans: DataFrame, key: str, text_col: str = "text", order: Sequence[str] = ()) -> DataFrame:
    """Add ``external_spans`` to every text; texts without any get an empty array.

    ``spans`` is (key, entity_type, start, end, confidence, *order). Of spans at the same place the one
    that comes first by ``order`` (the model's own order) wins ties; without it, by type. Spans of one
    text are grouped before the join, so a text's row is shuffled once. The array holds the spans of
    one text only.
    """
    place = [F.col("start").cast("int"), F.col("end").cast("int")]
    first = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)] or [p.alias(f"o{i}") for i, p in enumerate(place)]
    per_text = (
        model_predictions(spans)
        .groupBy(key)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        *first,
                        F.col("start").cast("int").alias("start"),
                        F.col("end").cast("int").alias("end"),
                        _renamed(F.col("entity_type")).alias("entity_type"),
                        F.col("confidence").cast("double").alias("confidence"),
                    )
                )
            ).alias("__spans")
        )
    )
    text = F.col(text_col)
    full = F.transform(
        F.coalesce("__spans", F.array()),
        lambda s, i: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            (i + F.lit(_FIRST_SEQ)).alias("seq"),
            s["entity_type"].alias("entity_type"),
            s["confidence"].alias("confidence"),
            F.lit(registry.EXTERNAL).alias("source"),
            slice_text(text, s["start"], s["end"]).alias("text"),
        ),
    ).cast(f"array<{RAW_SPAN}>")
    return texts.join(per_text, key, "left").withColumn("external_spans", full).drop("__spans")
