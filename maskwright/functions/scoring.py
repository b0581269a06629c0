"""Risk, confidence and messages over an array of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import registry
from maskwright.functions.messages import BLOCK_MESSAGE, fill
from maskwright.functions.spans import let


def risk_weight(entity_type: Column) -> Column:
    return (
        F.when(entity_type.isin(registry.HIGH_RISK_TYPES), F.lit(3.0))
        .when(entity_type.isin(registry.MEDIUM_RISK_TYPES), F.lit(2.0))
        .when(F.startswith(entity_type, F.lit("BUSINESS_")), F.lit(2.5))
        .otherwise(F.lit(1.0))
    )


def risk_score(entities: Column) -> Column:
    """Weighted mean confidence on a 0..1 scale, summed in span order; 0 for no spans."""
    total = F.aggregate(
        entities, F.lit(0.0), lambda acc, e: acc + e["confidence"] * risk_weight(e["entity_type"])
    )
    count = F.size(entities)
    return F.when(count == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total / (count * F.lit(3.0))))


def has_high_risk(entities: Column) -> Column:
    return F.exists(entities, lambda e: e["entity_type"].isin(registry.HIGH_RISK_TYPES))


def risk_indicator(entity_type: Column) -> Column:
    return entity_type.isin(registry.RISK_INDICATOR_TYPES)


def confidence_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.9, F.lit("high"))
        .when(confidence >= 0.7, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def filter_confidence(entities: Column, minimum: float = 0.8) -> Column:
    """Keep confident spans; scores computed before are left as they are."""
    return F.filter(entities, lambda e: e["confidence"] >= F.lit(minimum))


def entity_types(entities: Column) -> Column:
    """Sorted distinct labels."""
    return F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["entity_type"])))


def high_risk_types(entities: Column) -> Column:
    return F.filter(entity_types(entities), lambda t: t.isin(registry.HIGH_RISK_TYPES))


def should_block(entities: Column, risk: Column, threshold: float = 0.8) -> Column:
    return has_high_risk(entities) | (risk >= F.lit(threshold)) | (F.size(entities) > 5)


def two_decimals(value: Column) -> Column:
    """``value`` (0 <= value < 1e7) with two decimals, rounded as its exact binary value.

    ``0.825`` is stored slightly below 825/1000 and prints as 0.82. The rounding error of
    ``value * 100`` is recovered by splitting the factor, so ties are told from near-ties.
    """

    def render(p: Column) -> Column:
        whole = F.floor(p["scaled"])
        rest = p["scaled"] - whole
        up = (rest > 0.5) | (
            (rest == 0.5) & ((p["error"] > 0) | ((p["error"] == 0) & (F.pmod(whole, F.lit(2)) == 1)))
        )
        cents = whole + F.when(up, F.lit(1)).otherwise(F.lit(0))
        return F.concat(
            F.floor(cents / 100).cast("string"),
            F.lit("."),
            F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"),
        )

    def split(v: Column) -> Column:
        high = v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)
        scaled = v * F.lit(100.0)
        error = (high * F.lit(100.0) - scaled) + (v - high) * F.lit(100.0)
        return F.struct(scaled.alias("scaled"), error.alias("error"))

    return let(value.cast("double"), lambda v: let(split(v), render))


def block_message(entities: Column, risk: Column) -> Column:
    return fill(
        BLOCK_MESSAGE, types=F.array_join(entity_types(entities), ", "), risk=two_decimals(risk)
    )
