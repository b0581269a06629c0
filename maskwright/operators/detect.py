"""Detection over tables: text column in, spans and scores out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import registry, scoring, spans
from maskwright.functions.registry import Recognizer
from maskwright.functions.reuse import built_once

DETECTION_COLUMNS = ["entities", "risk_score", "has_high_risk_pii", "detection_metadata"]


def detection(
    text: Column,
    external: Column | None = None,
    custom: bool = True,
    rows: list[Recognizer] | None = None,
) -> Column:
    """Struct of entities, risk, high-risk flag and metadata for one text.

    ``external`` is an array of raw spans from another model; they come first in tie-breaks.
    """
    found = spans.recognize(text, custom=custom, rows=rows)
    raw = found if external is None else F.concat(external, found)

    def count(r: Column, source: str) -> Column:
        return F.size(F.filter(r, lambda s: s["source"] == source))

    def scored(r: Column, entities: Column) -> Column:
        risk = scoring.risk_score(entities)
        return spans.let(
            risk,
            lambda risk: F.struct(
                entities.alias("entities"),
                risk.alias("risk_score"),
                scoring.has_high_risk(entities).alias("has_high_risk_pii"),
                F.struct(
                    count(r, registry.EXTERNAL).alias("external_entities"),
                    count(r, registry.CUSTOM).alias("pattern_entities"),
                    count(r, registry.BUSINESS).alias("business_entities"),
                    F.size(entities).alias("total_entities"),
                    risk.alias("risk_score"),
                    F.struct(
                        F.lit(external is not None).alias("external"),
                        F.lit(custom).alias("custom_patterns"),
                        F.lit(True).alias("business_patterns"),
                    ).alias("detection_methods_used"),
                ).alias("detection_metadata"),
            ),
        )

    def resolved(r: Column) -> Column:
        return spans.let(spans.resolve_overlaps(r), lambda kept: spans.with_context(text, kept))

    return spans.let(raw, lambda r: spans.let(resolved(r), lambda e: scored(r, e)))


def detect(
    df: DataFrame,
    text_col: str = "text",
    external_col: str | None = None,
    custom: bool = True,
    rows: list[Recognizer] | None = None,
) -> DataFrame:
    """Add entities, risk_score, has_high_risk_pii and detection_metadata to every row.

    The struct is unpacked by a generator, not by projection: a filter on a result column stays
    above it, so detection never runs a second time inside a pushed-down filter, while filters on
    other columns still reach the scan. Results of an earlier detection are replaced.
    """
    def build() -> Column:
        external = None if external_col is None else F.col(external_col)
        return F.inline(F.array(detection(F.col(text_col), external, custom, rows)))

    key = ("detect", text_col, external_col, custom, None if rows is None else tuple(rows))
    return df.drop(*DETECTION_COLUMNS).select("*", built_once(key, build))
