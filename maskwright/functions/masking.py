"""Masking strategies as expressions over one span, and whole-text masking."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import spans
from maskwright.functions.messages import HASH_TOKEN, REDACTED_TOKEN, SYNTHETIC_TOKEN, fill
from maskwright.functions.spans import let

# --- Fixed values: strategy names, defaults and synthetic data.
MASK_TYPES = ["full", "partial", "synthetic", "hash", "redact"]
DEFAULT_MASK_CHAR = "*"
DEFAULT_HASH_ALGORITHM = "sha256"
DEFAULT_HASH_LENGTH = 8
SYNTHETIC_EMAIL_DOMAINS = ["example.com", "test.org", "sample.net", "demo.co"]
SYNTHETIC_FIRST_NAMES = ["John", "Jane", "Alex", "Sam", "Chris", "Jordan"]
SYNTHETIC_LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia"]
SYNTHETIC_CREDIT_CARD = "4000-1234-5678-9012"
SYNTHETIC_SSN = "000-12-3456"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# --- end of fixed values

# Tokens can be joined only with tokens made with the same salt: pass the salt in use.
DEFAULT_SALT = "pii"

MASK_CONFIG = (
    "struct<mask_type:string,mask_char:string,mask_length:int,hash_algorithm:string,"
    "salt:string,hash_length:int,confidence_threshold:double>"
)
MASK_CONFIG_MAP = f"map<string,{MASK_CONFIG}>"
_FIELDS = [
    ("mask_type", "string"),
    ("mask_char", "string"),
    ("mask_length", "int"),
    ("hash_algorithm", "string"),
    ("salt", "string"),
    ("hash_length", "int"),
    ("confidence_threshold", "double"),
]


def config_struct(config: Mapping[str, Any]) -> Column:
    """One entity type's masking settings as a literal; an unknown strategy is an error."""
    mask_type = config.get("mask_type", "full")
    if mask_type not in MASK_TYPES:
        raise ValueError(f"unknown mask_type {mask_type!r}")
    values = {**config, "mask_type": mask_type}
    return F.struct(*[F.lit(values.get(name)).cast(kind).alias(name) for name, kind in _FIELDS])


def config_map(config: Mapping[str, Mapping[str, Any]]) -> Column:
    """Masking settings per entity type (``DEFAULT`` for the others) as a literal map."""
    pairs: list[Column] = []
    for entity_type, settings in config.items():
        pairs += [F.lit(entity_type), config_struct(settings)]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast(MASK_CONFIG_MAP)


def _stars(char: Column, count: Column) -> Column:
    return F.repeat(char, F.greatest(count, F.lit(0)))


def _full(span: Column, config: Column, char: Column) -> Column:
    return _stars(char, F.coalesce(config["mask_length"], F.length(span["text"])))


def _partial(span: Column, char: Column) -> Column:
    text, kind = span["text"], span["entity_type"]
    size = F.length(text)
    at = F.instr(text, "@")
    tail4 = F.concat(_stars(char, size - 4), F.right(text, F.lit(4)))
    return (
        F.when(
            (kind == "EMAIL") & (at > 0),
            F.concat(
                F.left(text, F.least(at - 1, F.lit(1))),
                _stars(char, at - 2),
                F.substring(text, at, size),
            ),
        )
        .when(
            (kind == "PHONE_NUMBER") & (size >= 7),
            F.concat(F.left(text, F.lit(3)), _stars(char, size - 6), F.right(text, F.lit(3))),
        )
        .when(kind.isin("CREDIT_CARD", "US_SSN") & (size >= 4), tail4)
        .when(
            size > 2,
            F.concat(F.left(text, F.lit(1)), _stars(char, size - 2), F.right(text, F.lit(1))),
        )
        .otherwise(_stars(char, size))
    )


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _pick(choices: list[str], number: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(c) for c in choices]), (F.pmod(number, _long(len(choices))) + _long(1)).cast("int")
    )


def _synthetic(span: Column, seed: int) -> Column:
    """Stand-in values drawn from an md5 of the original: equal inputs get equal stand-ins, so
    a re-run or a retried task writes the same text."""
    text, kind = span["text"], span["entity_type"]

    def draw(n: int) -> Column:
        # Types are spelled out: in deeply nested expressions each implicit cast is analyzer work.
        digest = F.md5(F.concat(text, F.lit(f":{seed}:{n}")).cast("binary"))
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")

    def between(n: int, low: int, high: int) -> Column:
        return (F.pmod(draw(n), _long(high - low + 1)) + _long(low)).cast("string")

    letters = F.concat(*[_pick(list(LETTERS), draw(n)) for n in range(11, 19)])
    return (
        F.when(kind == "EMAIL", F.concat(letters, F.lit("@"), _pick(SYNTHETIC_EMAIL_DOMAINS, draw(0))))
        .when(
            kind == "PHONE_NUMBER",
            F.concat(F.lit("555-"), between(1, 100, 999), F.lit("-"), between(2, 1000, 9999)),
        )
        .when(
            kind == "PERSON",
            F.concat(
                _pick(SYNTHETIC_FIRST_NAMES, draw(1)), F.lit(" "), _pick(SYNTHETIC_LAST_NAMES, draw(2))
            ),
        )
        .when(kind == "CREDIT_CARD", F.lit(SYNTHETIC_CREDIT_CARD))
        .when(kind == "US_SSN", F.lit(SYNTHETIC_SSN))
        .when(
            kind == "IP_ADDRESS",
            F.concat(F.lit("192.168."), between(1, 1, 255), F.lit("."), between(2, 1, 255)),
        )
        .otherwise(fill(SYNTHETIC_TOKEN, entity_type=kind))
    )


def _hash(span: Column, config: Column) -> Column:
    salted = F.concat(span["text"], F.coalesce(config["salt"], F.lit(DEFAULT_SALT))).cast("binary")
    algorithm = F.coalesce(config["hash_algorithm"], F.lit(DEFAULT_HASH_ALGORITHM))
    digest = F.when(algorithm == "sha256", F.sha2(salted, 256)).otherwise(F.md5(salted))
    length = F.coalesce(config["hash_length"], F.lit(DEFAULT_HASH_LENGTH))
    return fill(HASH_TOKEN, digest=F.upper(F.substring(digest, F.lit(1), length)))


def redacted(span: Column) -> Column:
    return fill(REDACTED_TOKEN, entity_type=span["entity_type"])


def mask_value(span: Column, config: Column, seed: int = 0) -> Column:
    """Replacement of one span under one settings struct (null settings mean full masking)."""
    char = F.coalesce(config["mask_char"], F.lit(DEFAULT_MASK_CHAR))
    kind = F.coalesce(config["mask_type"], F.lit("full"))
    return (
        F.when(kind == "full", _full(span, config, char))
        .when(kind == "partial", _partial(span, char))
        .when(kind == "synthetic", _synthetic(span, seed))
        .when(kind == "hash", _hash(span, config))
        .when(kind == "redact", redacted(span))
        .otherwise(F.raise_error(F.concat(F.lit("unknown mask_type "), kind)))
    )


def config_of(config: Column, entity_type: Column) -> Column:
    return F.coalesce(F.try_element_at(config, entity_type), F.try_element_at(config, F.lit("DEFAULT")))


def mask_text(
    text: Column, entities: Column, config: Column, seed: int = 0, disjoint: bool = True
) -> Column:
    """``text`` with every span replaced by its type's strategy.

    ``disjoint`` holds for detected spans; caller-given spans need the general splice.
    """
    splice = spans.splice_disjoint if disjoint else spans.splice_any
    return splice(
        text,
        entities,
        lambda e: let(config_of(config, e["entity_type"]), lambda c: mask_value(e, c, seed)),
    )


def redact_text(text: Column, entities: Column) -> Column:
    return spans.splice_disjoint(text, entities, redacted)


def masking_methods(entities: Column, config: Column) -> Column:
    """Strategy used per entity type; null when nothing was masked."""
    entries = F.transform(
        entities,
        lambda e: F.struct(
            e["entity_type"].alias("key"),
            F.coalesce(config_of(config, e["entity_type"])["mask_type"], F.lit("full")).alias("value"),
        ),
    )
    return F.when(F.size(entities) > 0, F.map_from_entries(F.array_distinct(entries)))


def entities_masked(entities: Column) -> Column:
    """Spans in the order they are replaced: last start first, given order for ties."""
    ordered = F.array_sort(
        F.transform(
            entities, lambda s, i: F.struct((-s["start"]).alias("back"), i.alias("i"), s.alias("span"))
        )
    )
    return F.transform(ordered, lambda o: o["span"])
