"""Policy document and its evaluation as a column expression.

A policy is a small configuration document. It is read on the driver and becomes literal maps in
the plan, so evaluating it needs neither a join nor a broadcast. Where rows differ in their policy, it is
a column: see ``RULES`` here and ``compile_policies`` among the operators.
"""

from __future__ import annotations

import copy
import json
import logging
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import masking, messages, scoring
from maskwright.functions.spans import let

# --- Fixed values: the default policy document, actions by priority.
DEFAULT_DOCUMENT: dict[str, Any] = {
    "default_policy": {"action": "mask", "confidence_threshold": 0.8},
    "entity_policies": {
        "EMAIL": {"action": "mask", "confidence_threshold": 0.9, "mask_type": "partial"},
        "PHONE_NUMBER": {"action": "mask", "confidence_threshold": 0.8, "mask_type": "partial"},
        "US_SSN": {"action": "block", "confidence_threshold": 0.7},
        "CREDIT_CARD": {"action": "block", "confidence_threshold": 0.8},
        "PERSON": {"action": "warn", "confidence_threshold": 0.8},
        "LOCATION": {"action": "warn", "confidence_threshold": 0.7},
        "IP_ADDRESS": {"action": "mask", "confidence_threshold": 0.9, "mask_type": "full"},
        "URL": {"action": "warn", "confidence_threshold": 0.8},
        "AWS_ACCESS_KEY": {"action": "block", "confidence_threshold": 0.9},
        "API_KEY": {"action": "block", "confidence_threshold": 0.9},
        "PASSWORD": {"action": "block", "confidence_threshold": 0.8},
    },
    "role_overrides": {
        "admin": {"can_override": True, "bypass_entities": ["PERSON", "LOCATION"]},
        "developer": {"can_override": False, "bypass_entities": []},
        "analyst": {"can_override": True, "bypass_entities": ["LOCATION"]},
    },
    "business_rules": {
        "max_pii_entities_per_request": 5,
        "max_confidence_score_threshold": 0.95,
        "require_approval_for_high_risk": True,
        "log_all_detections": True,
    },
    "alert_settings": {
        "enable_real_time_alerts": True,
        "alert_on_blocked_requests": True,
        "alert_threshold": 10,
        "notification_channels": ["email", "slack"],
    },
}
# The document used when no file exists or it cannot be read has no URL row and no alerts.
FALLBACK_OMITS = {"entity_policies": ["URL"], "": ["alert_settings"]}
ACTION_PRIORITY = {"block": 4, "mask": 3, "warn": 2, "allow": 1}
UNKNOWN_ACTION_PRIORITY = 1
DEFAULT_CONFIDENCE_THRESHOLD = 0.8
# --- end of fixed values

_DECISION_MASKS = masking.MASK_CONFIG_MAP


def fallback_document() -> dict[str, Any]:
    document = copy.deepcopy(DEFAULT_DOCUMENT)
    for section, names in FALLBACK_OMITS.items():
        for name in names:
            (document[section] if section else document).pop(name)
    return document


@dataclass(frozen=True)
class Policy:
    """Policy document with typed access; never changed in place."""

    document: dict[str, Any] = field(default_factory=lambda: copy.deepcopy(DEFAULT_DOCUMENT))
    problem: str | None = None

    @property
    def key(self) -> str:
        """Text that is equal for equal documents."""
        return json.dumps(self.document, sort_keys=True)

    @property
    def default(self) -> dict[str, Any]:
        return self.document.get(
            "default_policy", {"action": "mask", "confidence_threshold": DEFAULT_CONFIDENCE_THRESHOLD}
        )

    @property
    def entities(self) -> dict[str, dict[str, Any]]:
        return self.document.get("entity_policies") or {}

    @property
    def roles(self) -> dict[str, dict[str, Any]]:
        return self.document.get("role_overrides") or {}

    @property
    def max_entities(self) -> int:
        return (self.document.get("business_rules") or {}).get("max_pii_entities_per_request", 5)

    @property
    def max_confidence(self) -> float:
        return (self.document.get("business_rules") or {}).get("max_confidence_score_threshold", 0.95)

    def merged(self, updates: Mapping[str, Any]) -> Policy:
        """Whole top-level sections of ``updates`` replace those here."""
        return Policy({**self.document, **updates})

    def for_entity(self, entity_type: str) -> dict[str, Any]:
        return self.entities.get(entity_type, self.document.get("default_policy", {}))

    def default_masking_config(self) -> dict[str, dict[str, Any]]:
        """Settings of every masked type, and full masking for the rest."""
        config = {
            name: {
                "mask_type": row.get("mask_type", "full"),
                "mask_char": row.get("mask_char", "*"),
                "confidence_threshold": float(row.get("confidence_threshold", DEFAULT_CONFIDENCE_THRESHOLD)),
            }
            for name, row in self.entities.items()
            if row.get("action") == "mask"
        }
        config["DEFAULT"] = {"mask_type": "full", "mask_char": "*", "confidence_threshold": DEFAULT_CONFIDENCE_THRESHOLD}
        return config


def load_policy(path: str | None = None, spark: SparkSession | None = None) -> Policy:
    """Policy from a YAML or JSON file; the fallback document if it is missing or unreadable.

    With ``spark`` the file is read through Spark, from any store that Spark reads. ``problem`` of the
    policy says why a file was not taken.
    """
    if path is None:
        return Policy()
    try:
        if spark is None:
            with open(path, encoding="utf-8") as handle:
                content = handle.read()
        else:
            content = spark.read.text(path, wholetext=True).first()[0]
        return parse_policy(content, as_json=path.endswith(".json"))
    except Exception as error:  # an unreadable policy must not switch protection off
        logging.getLogger(__name__).warning("policy %s not loaded, using the fallback: %s", path, error)
        return Policy(fallback_document(), problem=f"{type(error).__name__}: {error}")


def parse_policy(content: str, as_json: bool = False) -> Policy:
    """Policy from the text of a document, which must be a mapping of sections."""
    if as_json:
        document = json.loads(content)
    else:
        import yaml

        document = yaml.safe_load(content)
    if not isinstance(document, dict):
        raise ValueError("a policy document is a mapping of sections")
    return Policy(document)


ENTITY_ROW = "struct<action:string,threshold:double,mask:" + masking.MASK_CONFIG + ">"


def _policy_row(row: Mapping[str, Any]) -> dict[str, Any]:
    """One policy with its defaults; an unknown strategy fails here, not in the middle of a job."""
    if row.get("mask_type", "full") not in masking.MASK_TYPES:
        raise ValueError(f"unknown mask_type {row['mask_type']!r}")
    return {
        "action": row.get("action", "mask"),
        "threshold": float(row.get("confidence_threshold", DEFAULT_CONFIDENCE_THRESHOLD)),
        "mask": {
            "mask_type": row.get("mask_type", "full"),
            "mask_char": row.get("mask_char", "*"),
            "confidence_threshold": float(row.get("confidence_threshold", DEFAULT_CONFIDENCE_THRESHOLD)),
        },
    }


def _literal(value: Any, ddl: str) -> Column:
    """A constant of a nested type: the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def policy_rows(policy: Policy) -> Column:
    return _literal({k: _policy_row(v) for k, v in policy.entities.items()}, f"map<string,{ENTITY_ROW}>")


#: A policy as one value, to be chosen per row. Roles without overrides or bypasses are left out.
RULES = (
    f"struct<default:{ENTITY_ROW},entities:map<string,{ENTITY_ROW}>,able:array<string>,"
    "bypasses:map<string,array<string>>,max_entities:int,max_confidence:double>"
)


def rules_of(policy: Policy) -> Column:
    """A loaded policy as a constant of type ``RULES``."""
    return _literal(
        {
            "default": _policy_row(policy.default),
            "entities": {k: _policy_row(v) for k, v in policy.entities.items()},
            "able": [name for name, row in policy.roles.items() if row.get("can_override", False)],
            "bypasses": {name: row["bypass_entities"] for name, row in policy.roles.items() if row.get("bypass_entities")},
            "max_entities": policy.max_entities,
            "max_confidence": policy.max_confidence,
        },
        RULES,
    )


def policy_for_entity(policy: Policy | Column, entity_type: Column) -> Column:
    """The type's row, else the default row. Here and below a policy is a document, or a column of
    type ``RULES`` that has the policy of each row."""
    if isinstance(policy, Column):
        return F.coalesce(F.try_element_at(policy["entities"], entity_type), policy["default"])
    return F.coalesce(
        F.try_element_at(policy_rows(policy), entity_type), _literal(_policy_row(policy.default), ENTITY_ROW)
    )


def can_override(policy: Policy | Column, role: Column) -> Column:
    if isinstance(policy, Column):
        return F.coalesce(F.array_contains(policy["able"], role), F.lit(False))
    able = [name for name, row in policy.roles.items() if row.get("can_override", False)]
    return F.coalesce(role.isin(able), F.lit(False)) if able else F.lit(False)


def can_bypass(policy: Policy | Column, role: Column, entity_type: Column) -> Column:
    if isinstance(policy, Column):
        return F.coalesce(F.array_contains(F.try_element_at(policy["bypasses"], role), entity_type), F.lit(False))
    answer = F.lit(False)
    for name, row in policy.roles.items():
        types = row.get("bypass_entities") or []
        if types:
            answer = answer | ((role == name) & entity_type.isin(types))
    return F.coalesce(answer, F.lit(False))


def _limits(policy: Policy | Column) -> tuple[Column, Column, Column, Column]:
    """Most entities, confidence worth a note, and both as texts."""
    if isinstance(policy, Column):
        most, note = policy["max_entities"], policy["max_confidence"]
        return most, note, most.cast("string"), note.cast("string")
    return F.lit(policy.max_entities), F.lit(policy.max_confidence), F.lit(str(policy.max_entities)), F.lit(str(policy.max_confidence))


def action_priority(action: Column) -> Column:
    result = None
    for name, priority in ACTION_PRIORITY.items():
        result = (
            F.when(action == name, priority) if result is None else result.when(action == name, priority)
        )
    return result.otherwise(UNKNOWN_ACTION_PRIORITY)


def _decision(
    action: Column, threshold: Column, masks: Column, bypass_allowed: Column, reasons: Column
) -> Column:
    return F.struct(
        action.alias("action"),
        threshold.cast("double").alias("confidence_threshold"),
        masks.alias("masking_config"),
        bypass_allowed.alias("bypass_allowed"),
        reasons.alias("reasons"),
    )


def decide(
    entities: Column,
    policy: Policy | Column,
    role: Column | str = "user",
    bypass: Column | bool = False,
) -> Column:
    """Decision struct for one text's entities.

    Too many entities block at once. Otherwise the strongest action among the types that reach
    their threshold wins (types the role may bypass are skipped when ``bypass`` is set), and
    high-risk types turn allow or warn into block unless ``bypass`` is set. High-risk types count
    even below their threshold, but do not turn a mask into a block.
    """
    role = role if isinstance(role, Column) else F.lit(role)
    bypass = F.coalesce(bypass, F.lit(False)) if isinstance(bypass, Column) else F.lit(bypass)
    override = can_override(policy, role)
    most_entities, worth_a_note, most_text, note_text = _limits(policy)
    no_masks = F.create_map().cast(_DECISION_MASKS)
    count = F.size(entities)

    def considered(found: Column) -> Column:
        judged = F.transform(
            found,
            lambda e: F.struct(
                e["entity_type"].alias("entity_type"),
                e["confidence"].alias("confidence"),
                policy_for_entity(policy, e["entity_type"]).alias("row"),
            ),
        )
        return F.filter(
            judged,
            lambda j: (j["confidence"] >= j["row"]["threshold"])
            & ~(bypass & can_bypass(policy, role, j["entity_type"])),
        )

    def judge(taken: Column) -> Column:
        top = F.array_max(F.transform(taken, lambda j: action_priority(j["row"]["action"])))
        first = let(
            top, lambda t: F.get(F.filter(taken, lambda j: action_priority(j["row"]["action"]) == t), F.lit(0))
        )
        strongest = F.coalesce(first["row"]["action"], F.lit("allow"))
        masks = F.map_from_entries(
            F.array_distinct(
                F.transform(
                    F.filter(taken, lambda j: j["row"]["action"] == "mask"),
                    lambda j: F.struct(j["entity_type"].alias("key"), j["row"]["mask"].alias("value")),
                )
            )
        ).cast(_DECISION_MASKS)
        highest = F.array_max(F.transform(entities, lambda e: e["confidence"]))
        risky = scoring.has_high_risk(entities) & ~bypass

        def finish(v: Column) -> Column:
            escalate = risky & v["strongest"].isin("allow", "warn")
            reasons = F.concat(
                F.when(
                    v["highest"] >= worth_a_note,
                    F.array(
                        messages.fill(
                            messages.REASON_HIGH_CONFIDENCE,
                            confidence=scoring.two_decimals(v["highest"]),
                            limit=note_text,
                        )
                    ),
                ).otherwise(F.array().cast("array<string>")),
                F.transform(
                    taken,
                    lambda j: messages.fill(
                        messages.REASON_ENTITY,
                        entity_type=j["entity_type"],
                        action=j["row"]["action"],
                        confidence=scoring.two_decimals(j["confidence"]),
                    ),
                ),
                F.when(
                    risky,
                    F.array(
                        messages.fill(
                            messages.REASON_HIGH_RISK,
                            types=F.array_join(scoring.high_risk_types(entities), ", "),
                        )
                    ),
                ).otherwise(F.array().cast("array<string>")),
            )
            return _decision(
                F.when(escalate, F.lit("block")).otherwise(v["strongest"]),
                v["highest"],
                masks,
                F.when((F.size(taken) > 0) | escalate, override).otherwise(F.lit(True)),
                reasons,
            )

        return let(F.struct(strongest.alias("strongest"), highest.alias("highest")), finish)

    return (
        F.when(
            count == 0,
            _decision(
                F.lit("allow"), F.lit(0.0), no_masks, F.lit(True), F.array(F.lit(messages.REASON_NONE))
            ),
        )
        .when(
            count > most_entities,
            _decision(
                F.lit("block"),
                F.lit(1.0),
                no_masks,
                override,
                F.array(
                    messages.fill(
                        messages.REASON_TOO_MANY, count=count.cast("string"), limit=most_text
                    )
                ),
            ),
        )
        .otherwise(let(considered(entities), judge))
    )
