"""Chat formatting: a finite-state machine over roles checks the order of turns, and a declarative
template turns each into text segments with loss flags.

A turn's text depends on the turn alone, so formatting is map-only; only the order check looks at
the turn before. Control strings inside texts are escaped, so the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm.tables import type_of

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Markers around the texts of each role, which roles are learned from, and which role may
    follow which (None: the start). ``other`` marks turns of roles the template does not know: the
    role's name stands between its first two strings."""

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    learned: tuple[str, ...]
    follows: dict[str | None, tuple[str, ...]] = field(default_factory=dict)

    @property
    def controls(self) -> list[str]:
        return sorted({s for pair in self.marks.values() for s in pair} | set(self.other))

    @property
    def risky(self) -> str:
        """Matches (with no width) where a control string begins, or may begin with what follows the text."""
        heads = sorted({c[:n] for c in self.controls for n in range(1, len(c))})
        return f"(?={'|'.join(map(_quoted, self.controls))}|(?:{'|'.join(map(_quoted, heads))})\\z)"


DEFAULT = Template(
    marks={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    other=("[ROLE]", "[TEXT]", "[/TEXT]"),
    learned=("assistant",),
    follows={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escaped(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, template.risky, ESCAPE * 2)


def format_turns(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, turn, role, segments, formatted, in_order) of every row of ``conversations``.

    ``segments`` are (text, loss) in order, and ``formatted`` is their texts together; concatenated
    by turn they are the conversation. Null texts and roles are empty. ``in_order`` says whether the
    role may follow that of the turn before (rows of equal turn: by role, then text). Repeated rows
    are turns of their own; rows without conv_id form one conversation; an empty table gives no
    rows. Extra columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    start = end = None
    for name, (a, b) in template.marks.items():
        start = F.when(role == name, F.lit(a)) if start is None else start.when(role == name, F.lit(a))
        end = F.when(role == name, F.lit(b)) if end is None else end.when(role == name, F.lit(b))
    first, middle, last = template.other
    start = start.otherwise(F.concat(F.lit(first), escaped(role, template), F.lit(middle)))
    turns = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), start.alias("start"), end.otherwise(F.lit(last)).alias("end")
    )
    segment = lambda part, loss: F.struct(part.alias("text"), loss.alias("loss"))
    loss = F.col("role").isin(*template.learned)
    parts = [(F.col("start"), F.lit(False)), (escaped(F.col("text"), template), loss), (F.col("end"), F.lit(False))]
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    pairs = [(before.isNull() if a is None else before == a) & (F.col("role") == b) for a, bs in template.follows.items() for b in bs]
    allowed = pairs[0]
    for pair in pairs[1:]:
        allowed = allowed | pair
    out = turns.withColumn("in_order", F.coalesce(allowed, F.lit(False)))
    out = out.withColumn("segments", F.array(*[segment(a, b) for a, b in parts]))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", "turn", "role", "text", "segments", joined.alias("formatted"), "in_order")


class Reader:
    """Reads formatted text back into (role, text) pairs."""

    def __init__(self, template: Template):
        self.role_of = {a: (role, b) for role, (a, b) in template.marks.items()}
        self.other = template.other
        controls = "|".join(re.escape(c) for c in sorted(template.controls, key=len, reverse=True))
        self.token = re.compile(rf"\\(.)|({controls})", re.DOTALL)

    def plain(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        out, place, opened, role = [], 0, None, ""
        for match in self.token.finditer(formatted):
            control = match.group(2)
            if control is None:
                continue
            if opened is None:
                if match.start() != place:
                    raise ValueError("text outside a turn")
                opened = control
            elif opened == self.other[0] and control == self.other[1]:
                role, opened = self.plain(formatted[place : match.start()]), control
            else:
                known, end = self.role_of.get(opened, (role, self.other[2]))
                if control != end:
                    raise ValueError(f"{control} after {opened}")
                out.append((known, self.plain(formatted[place : match.start()])))
                opened = None
            place = match.end()
        if opened is not None or place != len(formatted):
            raise ValueError("a turn does not end")
        return out


def read_back(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of conversations as read from ``format_turns``' output: one row per conversation.

    Rows stream through in order of conversation and turn, so a conversation of any length takes
    the memory of a batch; a digest of a whole conversation is one task's work by its nature.
    """
    reader = Reader(template)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]
    kind = type_of(turns, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None
        id_type = None

        def done() -> pa.RecordBatch:
            conv, n, turn_hash, chars, loss_hash, length, good = current
            row = [conv, n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), length, good]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], id_type)] + [pa.array([v]) for v in row[1:]], names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if current is None or current[0] != row["conv_id"]:
                    if current is not None:
                        yield done()
                    current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                for role, text in reader.turns(row["formatted"]):
                    current[1] += 1
                    current[2].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                for part in row["segments"]:
                    if part["loss"]:
                        plain = reader.plain(part["text"])
                        current[3] += len(plain)
                        current[4].update(plain.encode("utf-8", "replace"))
                current[5] += len(row["formatted"])
                current[6] = current[6] and row["in_order"]
        if current is not None:
            yield done()

    ordered = turns.select("conv_id", "turn", "role", "text", "segments", "formatted", "in_order").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn", "role", "text")
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, in_order boolean"
    return ordered.mapInArrow(run, schema)
