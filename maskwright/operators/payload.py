"""JSON request and response bodies: find their texts, sanitize them, write them back.

A body is handled inside its own row, so sanitizing a table of bodies needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import masking
from maskwright.functions.policy import Policy, decide
from maskwright.functions.reuse import built_once
from maskwright.functions.spans import let
from maskwright.operators.detect import detection
from maskwright.operators.sanitize import sanitize
from maskwright.operators.skew import join_unique
from maskwright.sources.folders import use_checkpoint_dir

# --- Fixed values: text services, their addresses and the keys that hold text.
SERVICES = {
    "openai": {
        "base_url": "https://api.openai.com",
        "content_paths": ["messages", "prompt", "input"],
        "response_paths": ["choices", "message", "content"],
    },
    "anthropic": {
        "base_url": "https://api.anthropic.com",
        "content_paths": ["messages", "content"],
        "response_paths": ["content", "text"],
    },
    "google": {
        "base_url": "https://generativelanguage.googleapis.com",
        "content_paths": ["contents", "parts", "text"],
        "response_paths": ["candidates", "content", "parts", "text"],
    },
}
# --- end of fixed values

_STRINGS = "array<string>"


def service_of_url(url: Column) -> Column:
    """First service whose address is part of the URL, else null."""
    result = F.lit(None).cast("string")
    for name in reversed(list(SERVICES)):
        result = F.when(F.contains(url, F.lit(SERVICES[name]["base_url"])), F.lit(name)).otherwise(result)
    return result


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _as(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def _no_strings() -> Column:
    return F.array().cast(_STRINGS)


def _texts_under(value: Column) -> Column:
    """The value if it is a string, or the strings directly inside it if it is a list."""
    return let(
        F.struct(value.alias("v"), _kind(value).alias("kind")),
        lambda x: F.when(x["kind"] == "STRING", F.array(_as(x["v"], "string")))
        .when(
            F.startswith(x["kind"], F.lit("ARRAY")),
            F.transform(
                F.filter(_as(x["v"], "array<variant>"), lambda i: _kind(i) == "STRING"),
                lambda i: _as(i, "string"),
            ),
        )
        .otherwise(_no_strings()),
    )


def _no_keys() -> Column:
    return F.array().cast(_STRINGS)


def service_keys(service: Column, paths: str) -> Column:
    """The keys that hold text in bodies of the service (``paths``: content_paths or
    response_paths); none for an unknown service."""
    pairs: list[Column] = []
    for name, facts in SERVICES.items():
        pairs += [F.lit(name), F.array(*[F.lit(k) for k in facts[paths]])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), service), _no_keys())


def _is_list(body: Column) -> Column:
    return F.startswith(_kind(body), F.lit("ARRAY"))


def _objects(body: Column) -> Column:
    """A body's fields as maps: one map for an object, one per item for a list of objects."""
    return F.when(
        _is_list(body),
        F.filter(
            F.transform(_as(body, "array<variant>"), lambda item: _as(item, "map<string,variant>")),
            lambda m: m.isNotNull(),
        ),
    ).otherwise(F.array_compact(F.array(_as(body, "map<string,variant>"))))


def payload_texts(payload: Column, keys: Column) -> Column:
    """Texts under the given top-level keys, key by key; a list of objects is taken item by item."""

    def under(objects: Column) -> Column:
        return F.flatten(
            F.transform(
                keys,
                lambda key: F.flatten(
                    F.transform(
                        objects,
                        lambda fields: F.coalesce(_texts_under(F.try_element_at(fields, key)), _no_strings()),
                    )
                ),
            )
        )

    return F.coalesce(let(_objects(F.try_parse_json(payload)), under), _no_strings())


def _json_string(text: Column) -> Column:
    return let(F.to_json(F.array(text)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def _replaced_object(raw: Column, body: Column, keys: Column, replace: Callable[[Column], Column]) -> Column:
    """JSON text of one object with its texts replaced.

    Values without a replaced text keep their field order; objects inside a list with one come out
    with sorted fields, which is the same JSON value.
    """

    def item_json(item: Column) -> Column:
        return F.when(_kind(item) == "STRING", _json_string(replace(_as(item, "string")))).otherwise(
            F.to_json(item)
        )

    def value_json(key: Column, text: Column, value: Column) -> Column:
        wanted = F.array_contains(keys, key)
        kind = _kind(value)
        listed = F.concat(
            F.lit("["), F.array_join(F.transform(_as(value, "array<variant>"), item_json), ","), F.lit("]")
        )
        changed = F.exists(
            F.filter(_as(value, "array<variant>"), lambda i: _kind(i) == "STRING"),
            lambda i: replace(_as(i, "string")) != _as(i, "string"),
        )
        return (
            F.when(kind == "STRING", _json_string(F.when(wanted, replace(text)).otherwise(text)))
            .when(wanted & F.startswith(kind, F.lit("ARRAY")) & changed, listed)
            .when(text.isNull(), F.lit("null"))
            .otherwise(text)
        )

    fields = F.map_entries(F.from_json(raw, "map<string,string>"))
    typed = _as(body, "map<string,variant>")
    pairs = F.transform(
        fields,
        lambda f: F.concat(
            _json_string(f["key"]),
            F.lit(":"),
            value_json(f["key"], f["value"], F.try_element_at(typed, f["key"])),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def replace_payload_texts(payload: Column, keys: Column, replacements: Column) -> Column:
    """Body with the texts under ``keys`` looked up in the map ``replacements``."""

    def replace(text: Column) -> Column:
        return F.coalesce(F.try_element_at(replacements, text), text)

    def rebuilt(body: Column) -> Column:
        items = F.transform(
            _as(body, "array<variant>"),
            lambda item: F.when(
                F.startswith(_kind(item), F.lit("OBJECT")),
                _replaced_object(F.to_json(item), item, keys, replace),
            ).otherwise(F.to_json(item)),
        )
        return (
            F.when(_is_list(body), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))
            .when(
                F.startswith(_kind(body), F.lit("OBJECT")), _replaced_object(payload, body, keys, replace)
            )
            .otherwise(payload)
        )

    return let(F.try_parse_json(payload), rebuilt)


def _outcome(text: Column, policy: Policy, role: str, masked_actions: list[str]) -> Column:
    """What the policy makes of one text of a body."""

    def decided(found: Column) -> Column:
        return let(
            decide(found["entities"], policy, role),
            lambda d: F.struct(
                text.alias("text"),
                found["entities"].alias("entities"),
                d["action"].alias("action"),
                F.when(
                    d["action"].isin(masked_actions),
                    masking.mask_text(text, found["entities"], d["masking_config"]),
                )
                .otherwise(text)
                .alias("replacement"),
            ),
        )

    return let(detection(text), decided)


def _with_outcomes(
    df: DataFrame, payload_col: str, service_col: str, paths: str, policy: Policy, masked: list[str]
) -> DataFrame:
    keyed = df.withColumn("__keys", service_keys(F.col(service_col), paths))
    texts = payload_texts(F.col(payload_col), F.col("__keys"))
    outcomes = built_once(
        ("outcomes", policy.key, tuple(masked)),
        lambda: F.transform(F.array_distinct("__texts"), lambda t: _outcome(t, policy, "user", masked)),
    )
    return keyed.withColumn("__texts", texts).select(
        "*", F.inline(F.array(F.struct(outcomes.alias("__outcomes"))))
    )


def _rebuilt(payload_col: str) -> Column:
    payload = F.col(payload_col)
    replacements = F.map_from_entries(
        F.transform("__outcomes", lambda o: F.struct(o["text"].alias("key"), o["replacement"].alias("value")))
    )
    changed = F.exists("__outcomes", lambda o: o["replacement"] != o["text"])
    return F.when(
        changed, let(replacements, lambda r: replace_payload_texts(payload, F.col("__keys"), r))
    ).otherwise(payload)


def _status(payload_col: str, blocked: Column) -> Column:
    parsed = F.try_parse_json(F.col(payload_col))
    return F.when(parsed.isNull(), F.lit("invalid")).when(blocked, F.lit("blocked")).otherwise(F.lit("ok"))


def sanitize_payload(
    df: DataFrame, payload_col: str = "payload", service_col: str = "service", policy: Policy | None = None
) -> DataFrame:
    """Sanitize request bodies: one blocked text rejects the whole body.

    Adds ``status`` (ok, blocked, invalid), ``sanitized_payload`` (null unless ok),
    ``detected_entities`` (text by text; those of the first blocked text when blocked) and
    ``sanitization_applied``. A body that is no JSON value (null, broken, with a repeated key, or too
    large to parse) is invalid: nothing of it was searched, so nothing of it leaves.
    """
    found = _with_outcomes(df, payload_col, service_col, "content_paths", policy or Policy(), ["mask"])
    blocked = F.filter("__outcomes", lambda o: o["action"] == "block")
    per_text = F.transform(
        "__texts", lambda t: F.get(F.filter("__outcomes", lambda o: o["text"] == t), F.lit(0))["entities"]
    )
    entities = F.when(F.size(blocked) > 0, F.get(blocked, F.lit(0))["entities"]).otherwise(F.flatten(per_text))
    return (
        found.withColumn("status", _status(payload_col, F.size(blocked) > 0))
        .withColumn("detected_entities", entities)
        .withColumn(
            "sanitized_payload",
            F.when(F.col("status") == "ok", _rebuilt(payload_col)),
        )
        .withColumn(
            "sanitization_applied", (F.col("status") == "ok") & (F.size("detected_entities") > 0)
        )
        .drop("__keys", "__texts", "__outcomes")
    )


def sanitize_response(
    df: DataFrame, payload_col: str = "payload", service_col: str = "service", policy: Policy | None = None
) -> DataFrame:
    """Sanitize response bodies: texts that would be blocked are masked as well.

    Adds ``status`` (ok, invalid) and ``sanitized_payload`` (null when invalid, as in ``sanitize_payload``).
    """
    found = _with_outcomes(
        df, payload_col, service_col, "response_paths", policy or Policy(), ["block", "mask"]
    )
    return (
        found.withColumn("status", _status(payload_col, F.lit(False)))
        .withColumn("sanitized_payload", F.when(F.col("status") == "ok", _rebuilt(payload_col)))
        .drop("__keys", "__texts", "__outcomes")
    )


def conversation_summary(
    df: DataFrame, key: str = "conv_id", text_col: str = "text", policy: Policy | None = None
) -> DataFrame:
    """One row per conversation; a conversation with a blocked turn is rejected.

    Only counts are shuffled, after a partial count per task.
    """
    turns = sanitize(df, policy, text_col=text_col)
    return turns.groupBy(key).agg(
        F.count("*").alias("turns"),
        F.sum(F.size("entities")).alias("total_entities"),
        F.count_if(F.col("action_taken") == "mask").alias("masked_turns"),
        F.count_if(F.col("action_taken") == "block").alias("blocked_turns"),
        F.bool_or(F.col("action_taken") == "block").alias("rejected"),
    )


def sanitize_conversations(
    df: DataFrame,
    key: str = "conv_id",
    text_col: str = "text",
    turn_id: list[str] | None = None,
    policy: Policy | None = None,
) -> DataFrame:
    """Every turn sanitized, without its original text; the turns of a rejected conversation carry none.

    Turns are written once, with what may leave in place of the text, while the blocked ones are
    looked up.
    """
    use_checkpoint_dir(df.sparkSession)
    others = [c for c in df.columns if c != text_col]
    turns = (
        sanitize(df, policy, text_col=text_col)
        .select(*[F.col(c) for c in others], "action_taken", "sanitized_text")
        .checkpoint()
    )
    rejected = (
        turns.filter(F.col("action_taken") == "block")
        .select(key)
        .distinct()
        .withColumn("__rejected", F.lit(True))
    )
    flagged = join_unique(turns, rejected, key, [F.col(c) for c in (turn_id or [key, "turn"])])
    refused = F.coalesce("__rejected", F.lit(False))
    return flagged.select(
        *[F.col(c) for c in others],
        "action_taken",
        refused.alias("rejected"),
        F.when(~refused, F.col("sanitized_text")).alias("sanitized_text"),
    )
