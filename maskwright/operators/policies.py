"""Policy documents as tables: one row per policy (section, name, action, ...).

Columns: ``section`` (default_policy, entity_policies, ...), ``name``, ``action``, ``mask_type``,
``confidence_threshold`` (text, as written in the document).
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import messages
from maskwright.functions.masking import MASK_TYPES
from maskwright.functions.messages import fill
from maskwright.functions.policy import ACTION_PRIORITY, DEFAULT_CONFIDENCE_THRESHOLD, ENTITY_ROW, RULES, Policy, rules_of

POLICY_SCHEMA = "section string, name string, action string, mask_type string, confidence_threshold string"


def policy_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """Rows of a loaded policy's default and entity sections."""
    named = [("default_policy", "default", policy.default)]
    named += [("entity_policies", name, row) for name, row in policy.entities.items()]
    rows = [
        (section, name, row.get("action"), row.get("mask_type"),
         None if row.get("confidence_threshold") is None else str(row["confidence_threshold"]))
        for section, name, row in named
    ]
    return spark.createDataFrame(rows, POLICY_SCHEMA)


def merge_policies(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Sections present in ``updates`` replace the whole section in ``base``."""
    replaced = updates.select("section").distinct()
    return base.join(replaced, "section", "left_anti").unionByName(updates)


def policy_errors(
    section: Column, name: Column, action: Column, mask_type: Column, threshold: Column, is_number: Column | None = None
) -> Column:
    """Messages for one policy row; an empty array when it is valid.

    Thresholds come as texts; ``is_number`` says whether the document has a number there.
    """
    is_default = section == "default_policy"
    is_entity = section == "entity_policies"
    in_range = F.coalesce(threshold.try_cast("double").between(0, 1), F.lit(False))
    if is_number is not None:
        in_range = in_range & is_number
    invalid_action = ~action.isin(list(ACTION_PRIORITY))
    return F.array_compact(
        F.array(
            F.when(is_default & action.isNull(), fill(messages.ERROR_DEFAULT_ACTION_MISSING))
            .when(is_default & invalid_action, fill(messages.ERROR_DEFAULT_ACTION_INVALID, action=action))
            .when(is_entity & action.isNull(), fill(messages.ERROR_ACTION_MISSING, name=name))
            .when(is_entity & invalid_action, fill(messages.ERROR_ACTION_INVALID, name=name, action=action)),
            F.when(
                is_entity & (action == "mask") & ~mask_type.isin(MASK_TYPES),
                fill(messages.ERROR_MASK_TYPE, name=name, mask_type=mask_type),
            ),
            F.when(
                is_entity & threshold.isNotNull() & ~in_range,
                fill(messages.ERROR_THRESHOLD, name=name, threshold=threshold),
            ),
        )
    )


def validate_policies(rows: DataFrame) -> DataFrame:
    """One row per error of a policy table; no rows when it is valid."""
    errors = policy_errors(
        *[F.col(c) for c in ("section", "name", "action", "mask_type", "confidence_threshold")]
    )
    return rows.select("section", "name", F.explode(errors).alias("error"))


def default_masking_config(rows: DataFrame) -> DataFrame:
    """Masking settings of all masked types, and the DEFAULT row."""
    spark = rows.sparkSession
    schema = "entity_type string, mask_type string, mask_char string, confidence_threshold double"
    masked = rows.filter((F.col("section") == "entity_policies") & (F.col("action") == "mask")).select(
        F.col("name").alias("entity_type"),
        F.coalesce("mask_type", F.lit("full")).alias("mask_type"),
        F.lit("*").alias("mask_char"),
        F.coalesce(
            F.expr("try_cast(confidence_threshold as double)"), F.lit(DEFAULT_CONFIDENCE_THRESHOLD)
        ).alias("confidence_threshold"),
    )
    rest = spark.createDataFrame([("DEFAULT", "full", "*", DEFAULT_CONFIDENCE_THRESHOLD)], schema)
    return masked.unionByName(rest)


# --- whole documents as rows

_ROW = "struct<action:string,confidence_threshold:double,mask_type:string,mask_char:string>"


def policy_documents(spark: SparkSession, policies: Mapping[str, Policy]) -> DataFrame:
    """(policy, section, body): every section of the named documents, its body as a VARIANT. A document
    without sections is one row with an empty section name."""
    rows = [(name, section, json.dumps(body)) for name, p in policies.items() for section, body in (p.document or {"": None}).items()]
    return spark.createDataFrame(rows, "policy string, section string, body string").withColumn("body", F.parse_json("body"))


def merge_documents(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Documents in which sections of ``updates`` replace the whole section of the same policy."""
    return base.join(updates.select("policy", "section"), ["policy", "section"], "left_anti").unionByName(updates)


def compile_policies(documents: DataFrame) -> DataFrame:
    """(policy, rules): each document as one value of type ``RULES``, for ``with_policy``.

    Absent sections and fields get the defaults of a document that lacks them; an unknown strategy
    masks in full. Grouping is per policy: a document has a handful of sections.
    """

    def section(name: str, kind: str) -> Column:
        return F.first(F.when(F.col("section") == name, F.try_variant_get("body", "$", kind)), ignorenulls=True).alias(name)

    known = documents.groupBy("policy").agg(
        section("default_policy", _ROW),
        section("entity_policies", f"map<string,{_ROW}>"),
        section("role_overrides", "map<string,struct<can_override:boolean,bypass_entities:array<string>>>"),
        section("business_rules", "struct<max_pii_entities_per_request:int,max_confidence_score_threshold:double>"),
    )

    def row(r: Column) -> Column:
        threshold = F.coalesce(r["confidence_threshold"], F.lit(DEFAULT_CONFIDENCE_THRESHOLD))
        mask_type = F.when(r["mask_type"].isin(MASK_TYPES), r["mask_type"]).otherwise(F.lit("full"))
        none = {"mask_length": "int", "hash_algorithm": "string", "salt": "string", "hash_length": "int"}
        mask = F.struct(
            mask_type.alias("mask_type"), F.coalesce(r["mask_char"], F.lit("*")).alias("mask_char"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()], threshold.alias("confidence_threshold"),
        )
        return F.struct(F.coalesce(r["action"], F.lit("mask")).alias("action"), threshold.alias("threshold"), mask.alias("mask"))

    roles, limits = F.col("role_overrides"), F.col("business_rules")
    empty = F.lit(None).cast(_ROW)
    rules = F.struct(
        row(F.coalesce("default_policy", empty)).alias("default"),
        F.coalesce(F.transform_values("entity_policies", lambda _, r: row(r)), F.create_map().cast(f"map<string,{ENTITY_ROW}>")).alias("entities"),
        F.coalesce(F.map_keys(F.map_filter(roles, lambda _, r: r["can_override"])), F.array().cast("array<string>")).alias("able"),
        F.coalesce(
            F.transform_values(F.map_filter(roles, lambda _, r: F.size(r["bypass_entities"]) > 0), lambda _, r: r["bypass_entities"]),
            F.create_map().cast("map<string,array<string>>"),
        ).alias("bypasses"),
        F.coalesce(limits["max_pii_entities_per_request"], F.lit(5)).alias("max_entities"),
        F.coalesce(limits["max_confidence_score_threshold"], F.lit(0.95)).alias("max_confidence"),
    )
    return known.select("policy", rules.cast(RULES).alias("rules"))


def with_policy(df: DataFrame, name: Column, compiled: DataFrame, otherwise: Policy | None = None, column: str = "rules") -> DataFrame:
    """``df`` with the rules of the policy that ``name`` names, row by row; rows that name none, or an
    unknown one, get those of ``otherwise`` (the built-in document)."""
    chosen = compiled.select(F.col("policy").alias("__policy"), F.col("rules").alias("__rules"))
    joined = df.withColumn("__named", name).join(chosen, F.col("__named") == F.col("__policy"), "left")
    rules = F.coalesce("__rules", rules_of(Policy() if otherwise is None else otherwise))
    return joined.withColumn(column, rules).drop("__named", "__policy", "__rules")


def validate_documents(documents: DataFrame) -> DataFrame:
    """(policy, section, name, error): one row per error; a threshold must be a number, not a text."""
    named = documents.select(
        "policy", "section",
        F.explode(
            F.when(F.col("section") == "default_policy", F.create_map(F.lit("default"), F.col("body")))
            .when(F.col("section") == "entity_policies", F.try_variant_get("body", "$", "map<string,variant>"))
        ).alias("name", "row"),
    )
    text = {f: F.try_variant_get("row", f"$.{f}", "string") for f in ("action", "mask_type", "confidence_threshold")}
    kind = F.schema_of_variant(F.try_variant_get("row", "$.confidence_threshold", "variant"))
    is_number = F.coalesce(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    errors = policy_errors(F.col("section"), F.col("name"), text["action"], text["mask_type"], text["confidence_threshold"], is_number)
    return named.select("policy", "section", "name", F.explode(errors).alias("error"))
