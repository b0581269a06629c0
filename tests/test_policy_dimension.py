"""Policies as rows: equal to the literal ones, with the defaults of documents that lack sections."""

import json
import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import policy as policies, spans
from maskwright.functions.policy import Policy, fallback_document, load_policy
from maskwright.operators import policies as tables, sanitize

DOCUMENTS = {
    "whole": Policy(),
    "fallback": Policy(fallback_document()),
    "empty": Policy({}),
    "odd": Policy({
        "default_policy": {"action": "allow"},
        "entity_policies": {"EMAIL": {"action": "mask", "mask_type": "hash", "mask_char": "#"}, "URL": {"action": "block", "confidence_threshold": 1}},
        "role_overrides": {"auditor": {"can_override": True, "bypass_entities": ["URL"]}, "guest": {}},
        "business_rules": {"max_pii_entities_per_request": 2},
        "extra": ["kept", {"as": "it is"}],
    }),
}


def rows_of(spark):
    rng = random.Random(3)
    types = ["EMAIL", "URL", "US_SSN", "PERSON", "LOCATION", "OTHER"]
    rows = []
    for i in range(300):
        ents = [(rng.choice(types), j * 10, j * 10 + 5, rng.choice([0.7, 0.8, 0.9, 0.95, 1.0]), "x", "") for j in range(rng.choice([0, 1, 1, 2, 3, 6]))]
        rows.append((i, ents, rng.choice(["user", "admin", "analyst", "auditor", None]), rng.random() < 0.5, rng.choice([*DOCUMENTS, "none", None])))
    return spark.createDataFrame(rows, f"id int, entities array<{spans.SPAN}>, role string, bypass boolean, policy string")


def test_rules_of_rows_equal_literal_policies(spark):
    df = rows_of(spark)
    compiled = tables.compile_policies(tables.policy_documents(spark, DOCUMENTS))
    chosen = tables.with_policy(df, F.col("policy"), compiled)
    assert chosen.columns == [*df.columns, "rules"]
    mixed = {r["id"]: r["decision"] for r in sanitize.evaluate_policy(chosen, F.col("rules"), F.col("role"), F.col("bypass")).collect()}
    assert len(mixed) == 300
    for name, policy in [*DOCUMENTS.items(), (None, Policy()), ("none", Policy())]:
        part = df.filter(F.col("policy").eqNullSafe(F.lit(name)))
        for r in sanitize.evaluate_policy(part, policy, F.col("role"), F.col("bypass")).collect():
            assert r["decision"] == mixed[r["id"]], (name, r["id"])


def test_sections_replace_whole_sections(spark):
    base = tables.policy_documents(spark, {"a": Policy(), "b": Policy()})
    merged = tables.merge_documents(base, tables.policy_documents(spark, {"a": Policy({"role_overrides": {"x": {}}, "new": 1})}))
    found = {(r["policy"], r["section"]): json.loads(r["j"]) for r in merged.select("policy", "section", F.to_json("body").alias("j")).collect()}
    assert {s: b for (p, s), b in found.items() if p == "a"} == {**Policy().document, "role_overrides": {"x": {}}, "new": 1}
    assert {s: b for (p, s), b in found.items() if p == "b"} == Policy().document


def test_load_policy_says_why_it_fell_back(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("default_policy: {action: warn}\n")
    (tmp_path / "bad.yaml").write_text("a: [1\n")
    (tmp_path / "list.json").write_text("[1]")
    for reader in (None, spark):
        good = load_policy(str(tmp_path / "p.yaml"), reader)
        assert good.document == {"default_policy": {"action": "warn"}} and good.problem is None
        for name in ("bad.yaml", "list.json", "absent.yaml"):
            bad = load_policy(str(tmp_path / name), reader)
            assert bad.document == fallback_document() and bad.problem
    assert load_policy().problem is None


def test_thresholds_must_be_numbers(spark):
    document = {
        "default_policy": {"confidence_threshold": "x"},
        "entity_policies": {"A": {"action": "mask", "confidence_threshold": "0.5"}, "B": {"action": "mask", "confidence_threshold": 1},
                            "C": {"action": "warn", "confidence_threshold": -0.1}, "D": {"action": "mask", "mask_type": "full"}},
        "role_overrides": {"A": {"action": "deny"}},
    }
    rows = tables.validate_documents(tables.policy_documents(spark, {"p": Policy(document)})).collect()
    assert sorted((r["name"], r["error"]) for r in rows) == [
        ("A", "Invalid confidence_threshold for 'A': 0.5"),
        ("C", "Invalid confidence_threshold for 'C': -0.1"),
        ("default", "default_policy missing 'action' field"),
    ]


def test_masking_settings_carry_their_threshold(spark):
    df = rows_of(spark).filter("size(entities) between 1 and 5")
    for r in sanitize.evaluate_policy(df, DOCUMENTS["odd"]).collect():
        for m in r["decision"]["masking_config"].values():
            assert m["confidence_threshold"] == pytest.approx(0.8) and (m["mask_type"], m["mask_char"]) == ("hash", "#")
    assert Policy().default_masking_config()["EMAIL"]["confidence_threshold"] == 0.9
    assert policies.rules_of(Policy()) is not None
