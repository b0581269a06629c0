"""Span algebra as column expressions: find, resolve, cut and replace parts of a text.

Everything here is a ``Column -> Column`` function made of Spark built-ins, so a whole
detection is one projection: no shuffle, no Python worker. Offsets are half-open code points.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import registry
from maskwright.functions.regex import SPACE, jvm_regex, replacing
from maskwright.functions.registry import Recognizer

RAW_SPAN = (
    "struct<start:int,end:int,seq:int,entity_type:string,confidence:double,"
    "source:string,text:string>"
)
SPAN = "struct<entity_type:string,start:int,end:int,confidence:double,text:string,context:string>"
CONTEXT_WINDOW = 50

# A private-use character is not a word, digit or space character, so it can stand around a
# match without changing what matches. Should a text hold it, another one takes its place.
MARK = "\ue000"
MARK_SUBSTITUTE = "\ue001"

BLOCK = 64
PAGE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.transform(F.array(value), body)[0]


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + F.lit(1), F.greatest(end - start, F.lit(0)))


def _scan(values: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    start = F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(
        values,
        start,
        lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each number of an array, ``op`` (associative) over all numbers before it.

    Extending an array copies it, so long arrays are taken in blocks: each step copies at most a
    block, or one number per block.
    """
    last = F.floor((F.size(values) - 1) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(values, b * F.lit(BLOCK) + 1, F.lit(BLOCK))
    )

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, op))
        return let(
            _scan(totals, zero, op, kind),
            lambda before: F.flatten(
                F.transform(
                    parts,
                    lambda part, b: F.transform(_scan(part, zero, op, kind), lambda x: op(F.get(before, b), x)),
                )
            ),
        )

    return F.when(F.size(values) <= BLOCK, _scan(values, zero, op, kind)).otherwise(let(blocks, joined))


def pages(text: Column, spans: Column) -> Column:
    """The text cut into pages of equal width, if it is long and is to be cut in many places.

    Finding a position in a text means counting characters from its start; with pages, from the
    start of a page.
    """
    worth = (F.length(text) > 2 * PAGE) & (F.size(spans) > 8)
    cut = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)).alias("parts"),
        F.lit(PAGE).alias("width"),
    )
    whole = F.struct(F.array(text).alias("parts"), F.lit(2**31 - 1).alias("width"))
    return F.when(worth, cut).otherwise(whole)


def slice_pages(paged: Column, start: Column, end: Column) -> Column:
    first = F.floor(start / paged["width"]).cast("int")
    last = F.floor(F.greatest(end - 1, start) / paged["width"]).cast("int")
    return let(
        F.struct(first.alias("first"), last.alias("last")),
        lambda at: slice_text(
            F.when(at["first"] == at["last"], F.get(paged["parts"], at["first"])).otherwise(
                F.array_join(F.slice(paged["parts"], at["first"] + 1, at["last"] - at["first"] + 1), "")
            ),
            start - at["first"] * paged["width"],
            end - at["first"] * paged["width"],
        ),
    )


def has_keyword(lowered: Column, keywords: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(lowered, F.lit(word))
    return found


def has_context(text: Column, entity_type: str) -> Column:
    """Any keyword of the type occurs anywhere in the lower-cased text."""
    return let(
        F.lower(text),
        lambda lowered: has_keyword(lowered, registry.CONTEXT_KEYWORDS.get(entity_type, [])),
    )


def _test_passes(text: Column, test: str) -> Column:
    if test.startswith("re:"):
        return F.rlike(text, F.lit(jvm_regex(test[3:])))
    return F.contains(text, F.lit(test))


def _gates(text: Column, gates: list[tuple[str, ...]], body: Callable[[Column], Column]) -> Column:
    """``body`` of the array of gate results; gates with the same first test share it."""
    firsts = list(dict.fromkeys(g[0] for g in gates if g))

    def passed(shared: Column, gate: tuple[str, ...]) -> Column:
        result = shared[firsts.index(gate[0])] if gate else F.lit(True)
        for test in gate[1:]:
            result = result & _test_passes(text, test)
        return result

    def rest(shared: Column) -> Column:
        return let(F.array(*[passed(shared, g) for g in gates]), body)

    return let(F.array(*[_test_passes(text, t) for t in firsts]), rest) if firsts else rest(F.array())


def _marked(text: Column, recognizer: Recognizer, gate: Column) -> Column:
    pattern, before, match = replacing(recognizer.pattern, recognizer.ignore_case, recognizer.lead)
    return F.when(gate, F.regexp_replace(text, F.lit(pattern), F.lit(f"{before}{MARK}{match}{MARK}")))


def _confidence(text: Column, fact: Column) -> Column:
    keyworded = let(
        F.lower(text), lambda low: F.exists(fact["keywords"], lambda word: F.contains(low, word))
    )
    return (
        F.when(fact["source"] == registry.BUSINESS, F.lit(registry.CONFIDENCE_BUSINESS))
        .when(keyworded, F.lit(registry.CONFIDENCE_WITH_KEYWORD))
        .otherwise(F.lit(registry.CONFIDENCE_WITHOUT_KEYWORD))
    )


def _cut(original: Column, text: Column, marked: Column, fact: Column) -> Column:
    """Spans of one marked text: every second piece between marks is a match.

    A piece with the mark's substitute is cut anew from the original, which may hold the mark there.
    """

    def spans(x: Column) -> Column:
        def span(i: Column) -> Column:
            piece, start = F.get(x["pieces"], i), F.get(x["starts"], i)
            return F.struct(
                start.alias("start"),
                (start + F.length(piece)).alias("end"),
                fact["seq"].alias("seq"),
                fact["entity_type"].alias("entity_type"),
                x["confidence"].alias("confidence"),
                fact["source"].alias("source"),
                F.when(F.contains(piece, F.lit(MARK_SUBSTITUTE)), slice_text(original, start, start + F.length(piece)))
                .otherwise(piece)
                .alias("text"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(x["pieces"]) - 2, F.lit(2)), span)

    def placed(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda p: F.length(p))
        starts = let(lengths, lambda n: running(n, F.lit(0), lambda a, b: a + b))
        return F.struct(
            pieces.alias("pieces"), starts.alias("starts"), _confidence(text, fact).alias("confidence")
        )

    return let(F.split(marked, MARK, -1), lambda pieces: let(placed(pieces), spans))


def _without_marks(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit(MARK)), F.translate(text, MARK, MARK_SUBSTITUTE)
    ).otherwise(text)


def recognize(
    text: Column, types: list[str] | None = None, custom: bool = True, rows: list[Recognizer] | None = None
) -> Column:
    """All raw spans (before overlap resolution) that the recognizers find in ``text``."""
    chosen = registry.recognizers(types, custom) if rows is None else rows
    gates = list(dict.fromkeys(r.gate for r in chosen))
    facts = F.from_json(
        F.lit(
            json.dumps(
                [
                    {"seq": seq, "entity_type": r.entity_type, "source": r.source, "keywords": r.keywords}
                    for seq, r in enumerate(chosen)
                ]
            )
        ),
        "array<struct<seq:int,entity_type:string,source:string,keywords:array<string>>>",
    )

    def marks(clean: Column, passed: Column) -> Column:
        return F.array(*[_marked(clean, r, passed[gates.index(r.gate)]) for r in chosen])

    def find(clean: Column) -> Column:
        marked = F.transform(
            _gates(clean, gates, lambda passed: marks(clean, passed)),
            lambda m, i: F.struct(m.alias("marked"), F.get(facts, i).alias("fact")),
        )
        hits = F.filter(marked, lambda row: F.contains(row["marked"], F.lit(MARK)))
        return F.flatten(F.transform(hits, lambda row: _cut(text, clean, row["marked"], row["fact"])))

    return F.when(text.isNull(), F.array().cast(f"array<{RAW_SPAN}>")).otherwise(
        let(_without_marks(text), find)
    )


def _resolve_run(spans: Column) -> Column:
    def step(state: Column, span: Column) -> Column:
        last, kept = state["last"], state["kept"]
        touches = span["start"] <= last["end"]
        return (
            F.when(last.isNull(), F.struct(kept.alias("kept"), span.alias("last")))
            .when(
                touches & (span["confidence"] > last["confidence"]),
                F.struct(kept.alias("kept"), span.alias("last")),
            )
            .when(touches, state)
            .otherwise(F.struct(F.concat(kept, F.array(last)).alias("kept"), span.alias("last")))
        )

    start = F.struct(
        F.array().cast(f"array<{RAW_SPAN}>").alias("kept"), F.lit(None).cast(RAW_SPAN).alias("last")
    )
    return F.aggregate(
        spans, start, step, lambda state: F.concat(state["kept"], F.array(state["last"]))
    )


def resolve_overlaps(spans: Column) -> Column:
    """Keep one span of each run of touching spans.

    Spans are taken by (start, end, seq). A span that starts at or before the end of the kept
    one replaces it only with a strictly higher confidence, and may thereby shorten or extend
    it; otherwise it opens a new run. The result depends on that order.

    A span that starts behind the ends of all spans before it always opens a new run, so the
    spans between two such starts are folded by themselves.
    """

    def folded(x: Column) -> Column:
        count = F.size(x["spans"])
        heads = F.filter(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.get(x["spans"], i)["start"] > F.get(x["reach"], i),
        )

        def runs(first: Column) -> Column:
            return F.transform(
                first,
                lambda h, j: let(
                    F.coalesce(F.get(first, j + 1), count) - h,
                    lambda n: F.when(n == 1, F.slice(x["spans"], h + 1, n)).otherwise(
                        _resolve_run(F.slice(x["spans"], h + 1, n))
                    ),
                ),
            )

        return F.flatten(let(heads, runs))

    def reached(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda s: s["end"])
        reach = let(ends, lambda e: running(e, F.lit(-1), lambda a, b: F.greatest(a, b)))
        return F.struct(ordered.alias("spans"), reach.alias("reach"))

    return F.when(F.size(spans) < 2, spans).otherwise(
        let(
            F.array_sort(spans),
            lambda ordered: F.when(F.size(ordered) <= BLOCK, _resolve_run(ordered)).otherwise(
                let(reached(ordered), folded)
            ),
        )
    )


def span_context(text: Column, start: Column, end: Column, window: int = CONTEXT_WINDOW) -> Column:
    begin = F.greatest(start - F.lit(window), F.lit(0))
    return F.substring(text, begin + F.lit(1), end + F.lit(window) - begin)


def with_context(text: Column, spans: Column, window: int = CONTEXT_WINDOW) -> Column:
    """Public span rows of ``spans`` with the surrounding text added."""

    def context(paged: Column, s: Column) -> Column:
        return slice_pages(paged, F.greatest(s["start"] - F.lit(window), F.lit(0)), s["end"] + F.lit(window))

    return let(
        pages(text, spans),
        lambda paged: F.transform(
            spans,
            lambda s: F.struct(
                s["entity_type"].alias("entity_type"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["confidence"].alias("confidence"),
                s["text"].alias("text"),
                context(paged, s).alias("context"),
            ),
        ),
    )


def splice_disjoint(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replace ascending, disjoint spans: each text part is copied once."""

    def parts(paged: Column) -> Column:
        def part(span: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
            return F.array(slice_pages(paged, before, span["start"]), replacement(span))

        return F.flatten(F.transform(spans, part))

    tail = F.substring(text, F.element_at(spans, -1)["end"] + F.lit(1), F.length(text))
    pieces = F.concat(let(pages(text, spans), parts), F.array(tail))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(pieces, ""))


def splice_any(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replace caller-given spans from the last start to the first.

    Spans may overlap: a later replacement then cuts into text already changed. Spans with the
    same start keep their given order. Starts before the text count as its start. Each text part is
    copied once, by a table of pieces; spans that start behind the text, or end before it, are spliced
    one by one.
    """
    ordered = F.array_sort(
        F.transform(
            spans, lambda s, i: F.struct((-s["start"]).alias("back"), i.alias("i"), s.alias("span"))
        )
    )

    def step(done: Column, item: Column) -> Column:
        span = item["span"]
        return F.concat(
            F.substring(done, F.lit(1), F.greatest(span["start"], F.lit(0))),
            replacement(span),
            F.substring(done, span["end"] + F.lit(1), F.length(done)),
        )

    odd = let(F.length(text), lambda n: F.exists(spans, lambda s: F.coalesce((s["start"] > n) | (s["end"] < 0), F.lit(True))))
    return F.when(F.size(spans) == 0, text).when(odd, F.aggregate(ordered, text, step)).otherwise(
        let(ordered, lambda items: _splice_pieces(text, items, replacement))
    )


def _splice_pieces(text: Column, ordered: Column, replacement: Callable[[Column], Column]) -> Column:
    """``splice_any`` for spans that start in the text, by falling start.

    What stands behind the last start is a stack: a span first takes what its end reaches off the
    top, then lays the untouched text up to the start before it, then its replacement on top.
    ``grown`` is what it lays and ``taken`` what it takes; from their sums follows the ``base`` that
    it finds. Of its piece there stays what is below all later bases.
    """
    long = F.lit(0).cast("bigint")

    def laid(items: Column) -> Column:
        def piece(item: Column, i: Column) -> Column:
            span = item["span"]
            before = F.when(i == 0, F.length(text)).otherwise(F.greatest(F.get(items, i - 1)["span"]["start"], F.lit(0)))
            new = replacement(span)
            return F.struct(
                new.alias("new"), span["end"].alias("end"), before.alias("before"),
                (F.length(new) + F.greatest(before - span["end"], F.lit(0))).cast("bigint").alias("grown"),
                F.greatest(span["end"].cast("bigint") - before, long).alias("taken"),
            )

        return F.transform(items, piece)

    def summed(pieces: Column) -> Column:
        net = F.transform(pieces, lambda p: p["grown"] - p["taken"])
        sums = let(net, lambda n: running(n, long, lambda a, b: a + b, "bigint"))
        return F.struct(pieces.alias("pieces"), sums.alias("sums"))

    def based(x: Column) -> Column:
        # The stack is never below nothing: its height is the sum plus the deepest that sums have missed so far.
        short = F.transform(x["pieces"], lambda p, i: F.greatest(p["taken"] - F.get(x["sums"], i), long))
        missed = let(short, lambda v: F.transform(running(v, long, lambda a, b: F.greatest(a, b), "bigint"), lambda m, i: F.greatest(m, F.get(v, i))))
        bases = let(missed, lambda m: F.transform(x["pieces"], lambda p, i: F.get(x["sums"], i) - p["taken"] + F.get(m, i)))
        most = F.lit(2**62).cast("bigint")

        def cut(b: Column) -> Column:
            later = let(F.reverse(b), lambda r: running(r, most, lambda p, q: F.least(p, q), "bigint"))
            return F.struct(b.alias("bases"), F.reverse(later).alias("cut"))

        return F.struct(x["pieces"].alias("pieces"), let(bases, cut).alias("over"))

    def texts(x: Column) -> Column:
        def shown(paged: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                stays = F.least(F.get(x["over"]["cut"], i) - F.get(x["over"]["bases"], i), p["grown"])
                off = (p["grown"] - F.greatest(stays, long)).cast("int")
                rest = F.least(p["end"] + F.greatest(off - F.length(p["new"]), F.lit(0)), p["before"])
                return F.concat(F.substring(p["new"], off + F.lit(1), F.length(p["new"])), slice_pages(paged, rest, p["before"]))

            return F.array_join(F.reverse(F.transform(x["pieces"], one)), "")

        return shown

    head = F.substring(text, F.lit(1), F.greatest(F.element_at(ordered, -1)["span"]["start"], F.lit(0)))
    tail = let(
        let(let(laid(ordered), summed), based), lambda x: let(pages(text, x["pieces"]), texts(x))
    )
    return F.concat(head, tail)


def sentence_split(text: Column) -> Column:
    parts = F.transform(F.split(text, "[.!?]+", -1), strip)
    return F.filter(parts, lambda s: s != "")


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.regexp_replace(text, F.lit(f"^[{SPACE}]+|[{SPACE}]+$"), F.lit(""))


def sentence_of_span(text: Column, start: Column, end: Column) -> Column:
    """First sentence whose running position reaches ``start``, else the nearby text.

    Positions advance by sentence length + 1, so they drift after trimmed blanks and repeated
    punctuation; callers rely on that rule.
    """

    def step(state: Column, sentence: Column) -> Column:
        stop = state["at"] + F.length(sentence)
        hit = state["found"].isNull() & (state["at"] <= start) & (start <= stop)
        return F.struct(
            (stop + F.lit(1)).alias("at"),
            F.when(hit, sentence).otherwise(state["found"]).alias("found"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("found"))
    found = F.aggregate(sentence_split(text), zero, step, lambda state: state["found"])
    return F.coalesce(found, span_context(text, start, end))


def position_ratio(text: Column, start: Column) -> Column:
    return F.when(F.length(text) > 0, start / F.length(text))
