"""Cheap tests before patterns: every pattern has one, and none loses a span."""

from dataclasses import replace

from pyspark.sql import functions as F

from maskwright.functions import registry, spans

_WORDS = ["CONFIDENTIAL", "restricted", "Proprietary", "internal only", "CONFİDENTİAL", "confıdentıal", "reſtricted", "ınternal only"]
_ADDRESSES = ["2001:db8:0:0:0:0:0:1", "a:b:c:d:e:f:1:2", "ABCD:1:22:333:4444:0:0:9", "1:2:3:4:5:6:7", "12:30 and 13:45", "::1"]


def test_gates_lose_no_span(spark):
    assert all(r.gate for r in registry.RECOGNIZERS)
    texts = [t for w in [*_WORDS, *_ADDRESSES] for t in (w, f"x {w} y", f"({w})\n{w}.", f"x{w}", f"{w}\U00010400")] + ["", "plain words"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ungated = [replace(r, gate=()) for r in registry.RECOGNIZERS]
    found = df.select("text", spans.recognize(F.col("text")).alias("a"), spans.recognize(F.col("text"), rows=ungated).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in found)
    held = {r["text"]: {s["entity_type"] for s in r["a"]} for r in found}
    assert all("BUSINESS_CONFIDENTIAL_MARKERS" in held[w] for w in _WORDS)
    assert all("IP_ADDRESS" in held[a] for a in _ADDRESSES[:3])
