"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most r bits exactly when some 64-bit value lies within r/2 bits of
both. So every fingerprint emits all values within r/2 bits of it ("variants"), and fingerprints
that meet on a variant are linked.

The 2,081 variants of a radius of 4 are not shuffled one by one. Variants are dealt out by their
leading bits; a fingerprint is sent once to every leading pattern that any of its variants has (37
of 256), and the task that receives it makes the variants with that pattern. Each variant is still
made exactly once, at a hundredth of the shuffled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.components import components
from maskwright.llm.tables import saved, slices, type_of

SEED = 42
BLOCK_BYTES = 1 << 20
MAX_VARIANTS = 1 << 21  # variants that a task sorts at once
PER_PREFIX = 1024  # fingerprints aimed at per leading pattern


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some thousands at a time."""
    start = 0
    while start < len(text):
        end = start + BLOCK_BYTES
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[start:end].split()
        start = end


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of ``size`` words, in pieces; fewer words make one shingle."""
    carry: list[bytes] = []
    whole = True
    for words in _blocks(text.encode("utf-8", "replace").lower()):
        words = carry + words
        if len(words) >= size:
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[: len(words) - size] + 1).tolist()]
            digest = xxhash.xxh64_intdigest
            spans = zip(starts, ends[size - 1 :].tolist(), strict=True)
            yield np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
            whole = False
            carry = words[len(words) - size + 1 :]
        else:
            carry = words
    if whole and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], dtype=np.uint64)


def _ones(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often each bit is set, by segment."""
    out = np.zeros((len(lengths), 64), dtype=np.int64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = lengths > 0
    if full.any():
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return out


def fingerprint_texts(texts: list[str], size: int) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set where over half the shingle hashes set it."""
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    waiting: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        lengths = np.array([len(h) for _, h in waiting], dtype=np.int64)
        rows = np.array([i for i, _ in waiting])
        np.add.at(ones, rows, _ones(np.concatenate([h for _, h in waiting]), lengths))
        np.add.at(counts, rows, lengths)
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, size):
            waiting.append((i, hashes))
            held += len(hashes)
            if held > 100_000:
                add()
                held = 0
    if waiting:
        add()
    set_bits = 2 * ones > counts[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fingerprint bigint) of every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text with fewer words than
    a shingle is one shingle; null, empty and blank texts have fingerprint 0. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = fingerprint_texts([t or "" for t in part.column(1).to_pylist()], shingle_words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fingerprint"])

    schema = f"doc_id {type_of(docs, 'doc_id')}, fingerprint bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """Per number of flipped bits up to ``most``, all masks over the lowest ``bits`` bits."""
    return [
        np.array([sum(1 << i for i in c) for c in combinations(range(bits), k)], dtype=np.uint64)
        for k in range(most + 1)
    ]


def _collide(group: int, bits: int, found: np.ndarray, half: int, masks: dict) -> Iterator[np.ndarray]:
    """Pairs (smallest, other) of fingerprints that meet on a variant whose leading bits are ``group``."""
    rest = 64 - bits
    lead = found >> np.uint64(rest) if bits else np.zeros_like(found)
    away = np.bitwise_count(lead ^ np.uint64(group))
    found, away = found[away <= half], away[away <= half]
    if len(found) < 2:
        return
    if rest not in masks:
        masks[rest] = _masks(rest, half)
    sets = [np.concatenate(masks[rest][: half - k + 1]) for k in range(half + 1)]
    if bits < 64 and sum(len(sets[k]) for k in away) > MAX_VARIANTS:
        for bit in (0, 1):
            yield from _collide(group << 1 | bit, bits + 1, found, half, masks)
        return
    low = np.uint64((1 << rest) - 1)
    variants, who = [], []
    for k in range(half + 1):
        rows = np.flatnonzero(away == k)
        variants.append(((found[rows] & low)[:, None] ^ sets[k][None, :]).ravel())
        who.append(np.repeat(rows, len(sets[k])))
    variant, row = np.concatenate(variants), np.concatenate(who)
    order = np.argsort(variant)
    variant, row = variant[order], row[order]
    same = variant[1:] == variant[:-1]
    if not same.any():
        return
    first = np.concatenate([[True], ~same])
    run = np.cumsum(first) - 1
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    head = np.minimum.reduceat(row, np.flatnonzero(first))
    pairs = np.unique(head[run[shared]] * len(found) + row[shared])
    a, b = found[pairs // len(found)], found[pairs % len(found)]
    near = (a != b) & (np.bitwise_count(a ^ b) <= 2 * half + 1)
    yield np.stack([a[near], b[near]])


def near_edges(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that join up all of ``distinct`` (one column, distinct bigint fingerprints)
    whose fingerprints differ in at most ``radius`` (even) bits, and no others.

    All that meet on a variant are within ``radius`` of each other, so a link of each to the
    smallest of them says as much as all their pairs.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    half = radius // 2
    n = distinct.count()
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / PER_PREFIX)), 4, 24))
    flips = np.concatenate(_masks(bits, half))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(start, 4096).to_numpy(zero_copy_only=False)
                lead = own.view(np.uint64) >> np.uint64(64 - bits)
                group = (lead[:, None] ^ flips[None, :]).ravel().astype(np.int32)
                arrays = [pa.array(group), pa.array(np.repeat(own, len(flips)))]
                yield pa.RecordBatch.from_arrays(arrays, ["lead", "fingerprint"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict = {}
        held: list[np.ndarray] = []
        current = None

        def links() -> Iterator[pa.RecordBatch]:
            every = np.concatenate(held).view(np.uint64)
            for pairs in _collide(int(current), bits, every, half, masks):
                if pairs.shape[1]:
                    arrays = [pa.array(p.view(np.int64)) for p in pairs]
                    yield pa.RecordBatch.from_arrays(arrays, ["a", "b"])

        for batch in batches:
            lead = batch.column(0).to_numpy()
            own = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(lead)) + 1
            for part_lead, part in zip(lead[np.r_[0, cuts]] if len(lead) else [], np.split(own, cuts)):
                if current is not None and part_lead != current:
                    yield from links()
                    held.clear()
                current = part_lead
                held.append(part)
        if current is not None:
            yield from links()

    dealt = distinct.mapInArrow(deal, "lead int, fingerprint bigint")
    parts = min(1 << bits, max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n >> 12))
    return dealt.repartition(parts, "lead").sortWithinPartitions("lead").mapInArrow(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle_words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: the smallest doc_id reachable over links
    between fingerprints that differ in at most ``radius`` bits.

    Null, empty and blank texts share fingerprint 0 and are linked like others. A component of rows
    without doc_id has a null component_id. Repeated rows stay; an empty table gives no rows. Extra
    columns of ``docs`` are not read.
    """
    marked = saved(fingerprints(docs, shingle_words), "fingerprints")
    distinct = saved(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_edges(distinct.select("fingerprint"), radius))
    known = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    known = saved(known, "roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = saved(known.join(least, "root").select("fingerprint", "component_id"), "classes")
    return marked.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")
