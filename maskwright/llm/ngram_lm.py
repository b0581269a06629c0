"""Stupid-backoff scores of documents from n-gram counts of the whole table.

The count tables of all orders are partitioned by n-gram hash. Documents are read once, into chunks of a
few megabytes, as they come: equal rows are spread like others. A chunk's distinct n-grams with their
counts are exploded to the partitions of the count tables, joined there with the sums over all
chunks, and the joined counts return to the chunk, where they are summed per document.

Because a chunk sends an n-gram once, a very frequent n-gram costs one entry per chunk, not one per
occurrence, and no partition is larger than others. Rows of both shuffles carry sorted hashes and
counts of one (chunk, partition) as packed integers: about 6 bytes per distinct n-gram of a chunk.

N-grams are told apart by 64 bits of hash, whatever the size of the table: of a million million
distinct ones about 30,000 pairs share a hash and count together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.tables import saved_in_buckets, slices, type_of

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20  # bytes of text per partition of the count tables
WORDS_KEPT = 200_000  # word hashes a task remembers


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed byte planes, without the planes that are zero in all."""
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : max(width, 1)].T
    return bytes([max(width, 1)]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros((n, 8), dtype=np.uint8)
    planes = np.frombuffer(pa.decompress(blob[1:], n * blob[0], codec="zstd", asbytes=True), dtype=np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hash keys of the n-grams of some texts: ``keys[n]`` at each word's place, for orders 0 to
    ``order``, and where a text has an n-gram of that order ending there."""

    def __init__(self, texts: list[str | None], order: int, known: dict[bytes, int]):
        hashes: list[int] = []
        lengths = []
        for text in texts:
            words = (text or "").encode("utf-8", "replace").split()
            lengths.append(len(words))
            for word in words:
                h = known.get(word)
                if h is None:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    h = known[word] = xxhash.xxh64_intdigest(word)
                hashes.append(h)
        word = np.array(hashes, dtype=np.uint64)
        self.lengths = np.array(lengths, dtype=np.int64)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        gram = np.zeros(len(word), dtype=np.uint64)
        self.keys = [gram]
        self.there = [np.ones(len(word), dtype=bool)]
        for n in range(1, order + 1):
            before = np.zeros_like(gram)
            before[1:] = gram[:-1]
            gram = _mix(before * np.uint64(0x9E3779B97F4A7C15) + _mix(word + np.uint64(n)))
            self.keys.append(gram)
            self.there.append(place >= n - 1)

    def all_keys(self) -> np.ndarray:
        return np.concatenate([k[t] for k, t in zip(self.keys, self.there)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal values in the first column of sorted batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        values = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and values[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def backoff_scores(docs: DataFrame, order: int = 3, min_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """(doc_id, n_words bigint, log_score double, mean_log_score double) of every row of ``docs``.

    Words are runs of anything but ASCII white space. Counts of n-grams up to ``order`` cover all
    rows. A word after its context scores count(n-gram) / count(context) at the highest order whose
    n-gram has at least ``min_count`` occurrences, times ``backoff`` for each order skipped; a
    single word scores count / all words. ``log_score`` sums natural logarithms. A text without
    words (or null) has 0 words, log_score 0 and a null mean. Repeated rows count and score each.
    An empty table gives no rows; extra columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType
    chunk_type = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("texts", T.ArrayType(T.StringType())),
    ])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            columns = [pa.concat_arrays([h.column(c) for h in held]) for c in ("doc_id", "text")]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([size]), *lists], chunk_type.names)

        for batch in batches:
            for part in slices(batch, max_bytes=CHUNK_BYTES):
                own = part.column("text").nbytes
                if held and size + own > CHUNK_BYTES:
                    yield row()
                    chunk, held, size = chunk + 1, [], 0
                held.append(part)
                size += own
        if held:
            yield row()

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chunks = saved_in_buckets(read.mapInArrow(gather, chunk_type), "chunk", "chunks")
    size = chunks.agg(F.sum("size")).first()[0] or 1
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    lows = np.array([-((-b << 64) // buckets) for b in range(buckets)], dtype=np.uint64)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for chunk, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = Grams(texts.as_py(), order, known).all_keys()
                keys, n = np.unique(keys, return_counts=True)
                cuts = np.append(np.searchsorted(keys, lows), len(keys))
                out: list[tuple] = []
                for bucket in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[bucket], cuts[bucket + 1])
                    steps = np.diff(keys[own], prepend=lows[bucket])
                    out.append((int(bucket), chunk, own.stop - own.start, pack(steps), pack(n[own])))
                for i in range(0, len(out), 64):
                    arrays = [pa.array(c, t) for c, t in zip(zip(*out[i : i + 64]), kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["bucket", "chunk", "n", "grams", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _chunks(batches):
            sizes = rows.column("n").to_pylist()
            keys = [np.cumsum(unpack(g, n), dtype=np.uint64) for g, n in zip(rows.column("grams").to_pylist(), sizes)]  # above the bucket's lowest
            counts = [unpack(c, n) for c, n in zip(rows.column("counts").to_pylist(), sizes)]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate(counts)).astype(np.uint64)
            found = np.split(sums[place], np.cumsum(sizes)[:-1])
            arrays = [rows.column("chunk").combine_chunks(), pa.array([bucket] * len(sizes), pa.int32())]
            arrays += [pa.array(sizes, pa.int32()), pa.array([pack(f) for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["chunk", "bucket", "n", "totals"])

    def of_chunk(ids: pa.Array, texts: list[str | None], totals: list[dict]) -> pa.RecordBatch:
        grams = Grams(texts, order, {})
        _, place = np.unique(grams.all_keys(), return_inverse=True)
        found = [unpack(t["totals"], t["n"]) for t in sorted(totals, key=lambda t: t["bucket"])]
        count = np.concatenate(found or [np.zeros(0)]).astype(np.float64)[place]
        words = int(grams.lengths.sum())
        logs = np.zeros(words)
        done = np.zeros(words, dtype=bool)
        by_order, start = [], 0
        for there in grams.there:
            full = np.zeros(words)
            full[there] = count[start : start + int(there.sum())]
            start += int(there.sum())
            by_order.append(full)
        skipped = np.zeros(words)
        for n in range(order, 0, -1):
            context = by_order[n - 1] if n == 1 else np.concatenate([[1.0], by_order[n - 1][:-1]])
            here = ~done & grams.there[n] & (by_order[n] >= (min_count if n > 1 else 1))
            logs[here] = np.log(by_order[n][here] / context[here]) + skipped[here] * math.log(backoff)
            done |= here
            skipped += grams.there[n] & ~done
        sums = np.array([s.sum() for s in np.split(logs, np.cumsum(grams.lengths)[:-1])])
        means = pa.array(sums / np.maximum(grams.lengths, 1), mask=grams.lengths == 0)
        columns = [ids, pa.array(grams.lengths), pa.array(sums), means]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "log_score", "mean_log_score"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, totals in zip(batch.column("doc_ids"), batch.column("texts"), batch.column("found")):
                yield of_chunk(ids.values, texts.as_py(), totals.as_py() or [])

    exploded = chunks.select("chunk", "texts").mapInArrow(explode, "bucket int, chunk bigint, n int, grams binary, counts binary")
    summed = exploded.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        total, "chunk bigint, bucket int, n int, totals binary"
    )
    found = summed.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "totals")).alias("found"))  # a chunk's n-grams
    schema = f"doc_id {type_of(docs, 'doc_id')}, n_words bigint, log_score double, mean_log_score double"
    return chunks.select("chunk", "doc_ids", "texts").join(found, "chunk", "left").mapInArrow(score, schema)
