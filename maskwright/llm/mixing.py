"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to). Words
flow from patterns through sources to the sources' quotas; each further use of a pattern's words
costs more than the one before, so that words are repeated only where a quota needs it. Documents
are then laid along a line in seeded order, pattern by pattern, and the flow says which part of the
line is used how often, and for which source.

Only patterns and sources reach the driver, never documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import saved

WEIGHTS = (5.0, 2.0, 1.0)
SLOTS = 4096  # pieces of a pattern's line that are summed before documents are placed in it
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0))


def targets(sizes: dict, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict:
    """Words wanted of each source: ``share`` of all words, dealt by weight; a source stops at
    ``most`` times its size and the excess is dealt again among the others.

    Weights go to sources by code point, null last, and repeat.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, repeats: int = 2) -> dict[tuple, dict]:
    """Words of each pattern that go to each of its sources, by successive cheapest paths.

    ``patterns``: words by tuple of sources. The k-th use of a pattern's words costs k - 1 a word.
    As much of the quotas as the patterns can give is filled, at the lowest cost; among equal paths
    the first pattern, then the first source wins, so that reruns agree.
    """
    names = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    sources = sorted(quotas, key=lambda s: (s is None, s or ""))
    start, end = 0, 1 + len(names) + len(sources)
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
        return len(to) - 2

    number = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    used: list[tuple[tuple, object, int]] = []
    for i, p in enumerate(names):
        for k in range(repeats):
            edge(start, 1 + i, patterns[p], k)
        used += [(p, s, edge(1 + i, number[s], patterns[p] * repeats, 0)) for s in p if s in number]
    for s in sources:
        edge(number[s], end, quotas[s], 0)
    potential = [0] * (end + 1)
    while True:
        distance, via = [float("inf")] * (end + 1), [-1] * (end + 1)
        distance[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for e in out[a]:
                b = to[e]
                new = d + cost[e] + potential[a] - potential[b]
                if room[e] > 0 and new < distance[b]:
                    distance[b], via[b] = new, e
                    heapq.heappush(heap, (new, b))
        if distance[end] == float("inf"):
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, distance)]
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    flows: dict[tuple, dict] = {p: {} for p in names}
    for p, s, e in used:
        if room[e ^ 1]:
            flows[p][s] = room[e ^ 1]
    return flows


def mix(docs: DataFrame, sources: Column, repeats: int = 2, share: float = 1.5, weights: Sequence[float] = WEIGHTS, seed: int = 17) -> DataFrame:
    """(doc_id, size, sources, source_size, target, taken, uses) of every row of ``docs``.

    ``sources`` is the array of a row's sources (a null entry is a source; repeats count once; a
    null or empty array is the null source). ``size`` counts words (null text: 0), ``taken`` is
    size times the uses the mix makes of the row, and ``uses`` names the source each use counts for.
    ``source_size`` and ``target`` are the size and target of the row's first source. Whole rows are
    taken, in an order set by md5 of seed and doc_id (of rows without one: a hash of the text, so that they
    are spread like others), so a pattern's words come within about one row
    of what the flow asks; rows of size 0 are not taken. Rows with equal doc_id stand together.
    Targets above ``repeats`` times a source's words cannot occur. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = F.array_sort(F.array_distinct(F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name)), 1, 15), 16, 10).cast("bigint")
    rows = docs.select("doc_id", word_count(F.col("text")).alias("size"), own.alias("sources"), draw.alias("draw"))
    rows = saved(rows.withColumn("slot", F.shiftright("draw", 48).cast("int")), "sizes")
    sums = rows.groupBy("sources").agg(F.sum("size").alias("n")).collect()  # one row per pattern
    patterns = {tuple(r["sources"]): int(r["n"]) for r in sums}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes, weights, share, float(repeats)) if len(patterns) else {}
    flows = min_cost_flow(patterns, {s: int(t + 0.5) for s, t in wanted.items()}, repeats)
    plan = []
    for p, n in patterns.items():
        spans, at = [], 0
        for s, amount in flows[p].items():
            spans.append({"begin": at, "end": at + amount, "source": s})
            at += amount
        plan.append((list(p), n, sizes[p[0]], float(wanted[p[0]]), spans))
    spans_type = "array<struct<begin:bigint,end:bigint,source:string>>"
    plan = spark.createDataFrame(plan, f"sources array<string>, words bigint, source_size bigint, target double, spans {spans_type}")
    by_slot = rows.groupBy("sources", "slot").agg(F.sum("size").alias("n"))
    before = "sum(n) over (partition by sources order by slot) - n"  # a pattern has SLOTS rows here
    placed = saved(by_slot.select("sources", "slot", F.expr(before).alias("before")), "slots")
    inside = "sum(size) over (partition by sources, slot order by draw, doc_id, size rows unbounded preceding) - size"
    rows = rows.join(placed, ["sources", "slot"]).withColumn("at", F.expr(f"before + {inside}"))
    rows = rows.join(plan, "sources")

    def use(k: Column) -> Column:
        middle = 2 * (F.col("at") + k * F.col("words")) + F.col("size")
        return F.filter("spans", lambda s: (2 * s["begin"] <= middle) & (middle < 2 * s["end"]))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), use))
    uses = F.when(F.col("size") > 0, F.transform(every, lambda s: s["source"])).otherwise(F.array().cast("array<string>"))
    out = rows.select("doc_id", "size", "sources", "source_size", "target", uses.alias("uses"))
    return out.withColumn("taken", (F.col("size") * F.size("uses")).cast("bigint"))
