"""Confidence from context: semantic adjustment and calibration, over one span."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.regex import SPACE
from maskwright.functions.spans import let

# --- Fixed values: indicator words, weights and bounds.
RELEVANCE_WORDS = ["personal", "private", "confidential", "sensitive", "contact", "information", "details", "data"]
CALIBRATION_WORDS = ["personal", "private", "contact", "information"]
SUSPICIOUS_WORDS = ["example", "test", "sample", "fake", "dummy"]
FEATURE_WEIGHTS = {
    "pattern_match_score": 0.3,
    "context_score": 0.25,
    "position_score": 0.15,
    "length_score": 0.1,
    "surrounding_text_score": 0.2,
}
SEMANTIC_WINDOW = 100
MIN_CALIBRATION_SAMPLES = 10
# --- end of fixed values


def _share_of(words: list[str], text: Column) -> Column:
    def share(lowered: Column) -> Column:
        total = F.lit(0)
        for word in words:
            total = total + F.contains(lowered, F.lit(word)).cast("int")
        return total / F.lit(len(words))

    return let(F.lower(text), share)


def context_relevance(context: Column) -> Column:
    return _share_of(RELEVANCE_WORDS, context)


def adjust_confidence(confidence: Column, pattern: Column, context: Column, relevance: Column) -> Column:
    """Raise or lower a confidence by how well the span and its context fit the type."""

    def adjusted(boost: Column) -> Column:
        value = (
            F.when(boost > 0.6, confidence + (F.lit(1.0) - confidence) * 0.2)
            .when(boost < 0.3, confidence * 0.8)
            .otherwise(confidence)
        )
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))

    return let(F.lit(0.4) * pattern + F.lit(0.3) * context + F.lit(0.3) * relevance, adjusted)


def calibration_features(span: Column, text_length: Column) -> Column:
    """The five calibration scores of a span as a struct."""
    ratio = F.when(text_length > 0, span["start"] / text_length)
    size = F.length(span["text"])
    words = F.filter(F.split(span["context"], f"[{SPACE}]+", -1), lambda w: w != "")
    clean = let(
        words,
        lambda w: F.lit(1.0)
        - F.size(F.filter(w, lambda x: F.lower(x).isin(SUSPICIOUS_WORDS))) / F.greatest(F.lit(1), F.size(w)),
    )
    return F.struct(
        span["confidence"].alias("pattern_match_score"),
        _share_of(CALIBRATION_WORDS, span["context"]).alias("context_score"),
        F.when(ratio < 0.1, F.lit(0.8)).when(ratio > 0.9, F.lit(0.6)).otherwise(F.lit(1.0)).alias("position_score"),
        F.when(size < 3, F.lit(0.3)).when(size > 50, F.lit(0.7)).otherwise(F.lit(1.0)).alias("length_score"),
        clean.alias("surrounding_text_score"),
    )


def calibrated(features: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Weighted sum of the scores through a logistic curve."""
    weights = weights or FEATURE_WEIGHTS
    total = F.lit(0.0)
    for name in FEATURE_WEIGHTS:
        total = total + features[name] * F.lit(float(weights[name]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-5.0) * (total - F.lit(0.5))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def unit(vector: Column) -> Column:
    """The vector at length one (a zero vector stays as it is)."""
    return let(
        F.sqrt(dot(vector, vector)),
        lambda n: F.transform(vector, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))),
    )
