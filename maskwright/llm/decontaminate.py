"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage of
the training texts by block-max WAND, and a check of question and answer overlap.

A passage is a window of words. An item scores the BM25 weight of its words found in the passage, as
a share of the weight of all its words, and every item above a threshold is retrieved: a passage's
words whose highest weights together stay below the threshold cannot make a candidate; blocks of
items in which the highest weights of the passage's words stay below it are skipped; the rest is
scored in full. Candidates are then checked by word shingles of the item's question and answer.

The index is built per shard of a bounded number of items and sent to the executors; passages never
leave the task that reads their text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import opened, shared, slices, type_of

PASSAGE, STRIDE = 256, 192
SEGMENT = PASSAGE - STRIDE  # longer items are indexed in pieces of so many words; a passage holds any piece whole
BLOCK = 16  # index entries per block
K1, B = 1.2, 0.75
SHARD_ITEMS = 20_000
SHARD_BYTES = 16 << 20
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Index:
    """Weights of words in entries (pieces of items), by word and block of entries."""

    def __init__(self, items: list[tuple[object, list[str], list[str]]]):
        self.items = items
        pieces = []
        for number, (_, question, answer) in enumerate(items):
            words = question + answer
            count = max(1, math.ceil(len(words) / SEGMENT))
            step = math.ceil(len(words) / count)
            pieces += [(number, Counter(words[i : i + step])) for i in range(0, len(words), step or 1)]
        spread = Counter(w for _, c in pieces for w in c)
        self.vocabulary = {w: i for i, w in enumerate(sorted(spread))}
        idf = {w: math.log(1 + (len(pieces) - n + 0.5) / (n + 0.5)) for w, n in spread.items()}
        mean = sum(c.total() for _, c in pieces) / max(len(pieces), 1)
        weighed = []
        for number, counts in pieces:
            norm = K1 * (1 - B + B * counts.total() / mean)
            weight = {w: idf[w] * n * (K1 + 1) / (n + norm) for w, n in counts.items()}
            total = sum(weight.values())
            weighed.append((max(weight.values()) / total, number, {w: x / total for w, x in weight.items()}))
        weighed.sort(key=lambda x: (x[0], x[1]))  # alike entries share a block, so that its maxima are tight
        self.item_of = np.array([n for _, n, _ in weighed], dtype=np.int64)
        rows = sorted((self.vocabulary[w], e, x) for e, (_, _, own) in enumerate(weighed) for w, x in own.items())
        term = np.array([r[0] for r in rows], dtype=np.int64)
        self.entry = np.array([r[1] for r in rows], dtype=np.int64)
        self.weight = np.array([r[2] for r in rows])
        self.blocks = len(weighed) // BLOCK + 1
        key = term * self.blocks + self.entry // BLOCK
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.key = key[starts]  # (word, block) with any posting, sorted
        self.starts = np.append(starts, len(key))
        self.block_max = np.maximum.reduceat(self.weight, starts) if len(key) else np.zeros(0)
        self.term_starts = np.searchsorted(self.key, np.arange(len(self.vocabulary) + 1) * self.blocks)
        self.term_max = np.zeros(len(self.vocabulary))
        np.maximum.at(self.term_max, term, self.weight)

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, entry, score) with at least the threshold. ``passage``, ``term``: distinct
        pairs, sorted by passage."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        high = self.term_max[term]
        order = np.lexsort((high, passage))
        passage, term, high = passage[order], term[order], high[order]
        heads = np.flatnonzero(np.diff(passage, prepend=-1))
        sizes = np.diff(np.append(heads, len(passage)))
        so_far = np.cumsum(high)
        so_far -= np.repeat(so_far[heads] - high[heads], sizes) if len(heads) else 0
        essential = so_far >= threshold - 1e-9
        rest = np.add.reduceat(np.where(essential, 0, high), heads) if len(heads) else np.zeros(0)
        own = np.repeat(np.arange(len(heads)), sizes)
        # upper bounds of (passage, block)
        row, at = _expand(np.flatnonzero(essential), self.term_starts[term], self.term_starts[term + 1])
        if not len(row):
            return none
        pair, place = np.unique(own[row] * self.blocks + self.key[at] % self.blocks, return_inverse=True)
        bound = np.bincount(place, weights=self.block_max[at]) + rest[pair // self.blocks]
        pair = pair[bound >= threshold - 1e-9]
        if not len(pair):
            return none
        # full scores of the entries of those blocks
        head, block = pair // self.blocks, pair % self.blocks
        pair_row, at = _expand(np.arange(len(pair)), heads[head], heads[head] + sizes[head])
        wanted = term[at] * self.blocks + block[pair_row]
        found = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        hit = self.key[found] == wanted
        pair_row, found = pair_row[hit], found[hit]
        row, at = _expand(np.arange(len(found)), self.starts[found], self.starts[found + 1])
        code, place = np.unique(head[pair_row[row]] * len(self.item_of) + self.entry[at], return_inverse=True)
        score = np.bincount(place, weights=self.weight[at])
        good = score >= threshold - 1e-9
        code = code[good]
        return passage[heads][code // len(self.item_of)], code % len(self.item_of), score[good]


def _expand(rows: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (row, position) with begin[row] <= position < end[row]."""
    n = end[rows] - begin[rows]
    shift = begin[rows] - (np.cumsum(n) - n)
    return np.repeat(rows, n), np.arange(int(n.sum())) + np.repeat(shift, n)


def passages(numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, word) pairs of all texts, and text and first word of each passage.

    ``numbers``: index numbers of all words, -1 for words that no item has.
    """
    count = np.maximum(1, -(-(lengths - (PASSAGE - STRIDE)) // STRIDE)) * (lengths > 0)
    text = np.repeat(np.arange(len(lengths)), count)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    base = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(numbers)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    known = numbers >= 0
    word, owner, slot = numbers[known], owner[known], place[known] // STRIDE
    last = count[owner] - 1
    own = base[owner] + np.minimum(slot, last)
    start = place[known] - slot * STRIDE
    also = np.flatnonzero((slot > 0) & (slot <= last) & (start < PASSAGE - STRIDE))  # the passage before holds it too
    span = int(numbers.max(initial=0)) + 1
    keys = np.unique(np.concatenate([own * span + word, (own[also] - 1) * span + word[also]]))
    return keys // span, keys % span, text, first


def overlaps(words: list[str], question: list[str], answer: list[str], size: int) -> tuple[float, float, float]:
    """Shares of an item's shingles, its question's and its answer's among those of ``words``."""
    there = shingles(words, size)
    parts = [shingles(question + answer, size), shingles(question, size), shingles(answer, size)]
    if len(answer) < size:
        parts[2] = shingles((question + answer)[-size:], size)
    if len(question) < size:
        parts[1] = shingles((question + answer)[:size], size)
    if len(question) + len(answer) < size:  # a shorter item is looked for as a whole
        there = shingles(words, len(question) + len(answer))
    return tuple(len(p & there) / len(p) if p else 1.0 for p in parts)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    question: str = "text",
    answer: str | None = None,
    threshold: float = 0.5,
    overlap: float = 0.8,
    part_overlap: float = 0.5,
    shingle_words: int = 5,
) -> DataFrame:
    """(doc_id, text_key, item_id, score, question_overlap, answer_overlap): texts that hold items.

    Words are runs of word characters, lower-cased. An item has leaked into a text when a passage
    retrieves it (``threshold`` of its BM25 weight), at least ``overlap`` of the item's shingles
    stand near that passage, and at least ``part_overlap`` of its question's and of its answer's.
    Without an answer column the last quarter of the words counts as the answer. Items without
    words never leak; texts without words hold none. Repeated rows of texts or items give the same
    pair once; null ids are kept. No items or no texts: no rows. ``text_key`` is the xxhash64 key of
    the text, which tells rows without an id apart.
    """
    spark = docs.sparkSession
    answers = F.col(answer) if answer else F.lit(None).cast("string")
    sources = items.select("item_id", F.col(question).alias("q"), answers.alias("a"))
    size = sources.agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0))).alias("b")
    ).first()
    shards = max(1, -(-size["n"] // SHARD_ITEMS), -(-(size["b"] or 0) // SHARD_BYTES))
    id_type = type_of(docs, "doc_id")
    schema = f"doc_id {id_type}, text_key bigint, number int, score double, question_overlap double, answer_overlap double"

    def of_shard(k: int) -> DataFrame:
        own = sources.filter(F.pmod(F.xxhash64("item_id", "q", "a"), F.lit(shards)) == k).distinct()
        rows = own.collect()  # at most about SHARD_ITEMS items and SHARD_BYTES of text
        parts = []
        for row in rows:
            words, last = words_of(row["q"]), words_of(row["a"])
            cut = len(words) - len(words) // 4
            parts.append((row["item_id"], words[:cut], words[cut:]) if answer is None else (row["item_id"], words, last))
        parts = sorted((p for p in parts if p[1] or p[2]), key=lambda p: (p[0] is None, p[0] or 0, p[1:]))
        index = shared(spark, Index(parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = opened(index)
            for batch in batches:
                for part in slices(batch, max_bytes=2_000_000):
                    yield _search(own, part, threshold, overlap, part_overlap, shingle_words)

        texts = docs.select("doc_id", F.xxhash64(F.col("text").isNull(), "text").alias("text_key"), "text")
        found = texts.mapInArrow(run, schema)
        numbers = [(i, p[0]) for i, p in enumerate(parts)]
        ids = spark.createDataFrame(numbers, f"number int, item_id {type_of(items, 'item_id')}")
        return found.join(F.broadcast(ids), "number")

    found = reduce(DataFrame.unionByName, [of_shard(k) for k in range(shards)])
    columns = ["score", "question_overlap", "answer_overlap"]
    best = found.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct(*columns)).alias("best"))
    return best.select("doc_id", "text_key", "item_id", "best.*")


def _search(index: Index, part: pa.RecordBatch, threshold: float, overlap: float, part_overlap: float, size: int) -> pa.RecordBatch:
    rows: list[tuple] = []
    get = index.vocabulary.get
    split = [words_of(t) for t in part.column(2).to_pylist()]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    numbers = np.array([get(w, -1) for words in split for w in words], dtype=np.int64)
    passage, term, text, first = passages(numbers, lengths)
    best: dict[tuple[int, int], list] = {}
    if len(passage):
        for p, entry, score in zip(*(x.tolist() for x in index.search(passage, term, threshold))):
            spot = best.setdefault((int(text[p]), int(index.item_of[entry])), [0.0, int(first[p]), 0])
            spot[0] = max(spot[0], score)
            spot[1], spot[2] = min(spot[1], int(first[p])), max(spot[2], int(first[p]))
    for (row, item), (score, low, high) in sorted(best.items()):
        _, question, answer = index.items[item]
        near = len(question) + len(answer)
        words = split[row][max(0, low - near) : high + PASSAGE + near]
        whole, of_question, of_answer = overlaps(words, question, answer, size)
        if whole >= overlap and min(of_question, of_answer) >= part_overlap:
            rows.append((row, item, score, of_question, of_answer))
    at = pa.array([r[0] for r in rows], pa.int64())
    arrays = [part.column(0).take(at), part.column(1).take(at), pa.array([r[1] for r in rows], pa.int32())]
    arrays += [pa.array([float(r[k]) for r in rows], pa.float64()) for k in (2, 3, 4)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "number", "score", "question_overlap", "answer_overlap"])
