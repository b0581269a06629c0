"""Nearest prototypes in blocks and slices against plain loops."""

import math
import random

from maskwright.operators import semantic


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_many_prototypes_and_a_hot_type(spark, monkeypatch):
    monkeypatch.setattr(semantic, "VECTORS_PER_BLOCK", 7)
    monkeypatch.setattr(semantic, "COMPARISONS_PER_SLICE", 1200)
    rng = random.Random(4)
    draw = lambda: [rng.gauss(0, 1) for _ in range(5)]
    protos = [("pattern", t, draw()) for t in ("EMAIL", "URL") for _ in range(60)] + [("context", "any", draw()) for _ in range(50)]
    protos += protos[:10]  # repeats
    spans = [(i, rng.choice(["EMAIL", "EMAIL", "URL", "PERSON", None]), draw(), draw(), "r", 1) for i in range(300)]
    spans += [(300, "EMAIL", None, None, "r", 1), (301, "EMAIL", draw(), None, "r", 1), (301, "EMAIL", None, draw(), "r", 1)]
    schema = "id int, entity_type string, embedding array<double>, context_embedding array<double>, row string, slice int"
    found = semantic.semantic_scores(
        spark.createDataFrame(spans, schema).repartition(4), spark.createDataFrame(protos, "kind string, label string, embedding array<double>")
    )
    assert found.columns == ["id", "entity_type", "embedding", "context_embedding", "row", "slice", "pattern_similarity", "context_similarity"]
    want = []
    for i, t, own, around, *_ in spans:
        near = [cosine(own, v) for k, label, v in protos if own and k == "pattern" and label == t]
        wide = [cosine(around, v) for k, _, v in protos if around and k == "context"]
        want.append((i, round(max(near, default=0.5), 9), round(max([0.0, *wide]), 9)))
    got = [(r["id"], round(r["pattern_similarity"], 9), round(r["context_similarity"], 9)) for r in found.collect()]
    assert sorted(got) == sorted(want)
    none = spark.createDataFrame([], "kind string, label string, embedding array<double>")
    alone = semantic.semantic_scores(spark.createDataFrame(spans, schema), none).collect()
    assert len(alone) == len(spans) and {(r["pattern_similarity"], r["context_similarity"]) for r in alone} == {(0.5, 0.0)}


def test_enhanced_entities_come_back_in_order(spark):
    span = "struct<entity_type:string,start:int,end:int,confidence:double,text:string,context:string>"
    text = "contact personal private details " + "x" * 300 + " mail a@b.co or c@d.co"
    ents = [("EMAIL", 339, 345, 0.9, "a@b.co", "old"), ("EMAIL", 349, 355, 0.4, "c@d.co", "old")]
    detected = spark.createDataFrame([(1, text, ents), (2, "none", []), (3, text, ents)], f"k int, text string, entities array<{span}>")
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0], [0.0, 1.0])], "k int, ord int, embedding array<double>, context_embedding array<double>")
    protos = spark.createDataFrame([("pattern", "EMAIL", [1.0, 0.0]), ("context", "c", [0.0, 1.0])], "kind string, label string, embedding array<double>")
    out = {r["k"]: r["entities"] for r in semantic.enhance_texts(detected, vectors, protos, "k").collect()}
    assert out[2] == [] and [e["text"] for e in out[1]] == ["a@b.co", "c@d.co"]
    assert out[1][1]["confidence"] > 0.4 and out[3][1]["confidence"] < 0.4  # with a vector that fits, and with none
    assert out[1][0]["context"] == text[239:445]
