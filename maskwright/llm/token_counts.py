"""Token counts by the table of distinct pre-tokens: pieces are counted once per distinct pre-token.

A byte-pair model never merges across pre-tokens, so a text's tokens are the sum over its pre-tokens
of their pieces. Texts are read once, in chunks: each chunk gives its distinct pre-tokens, numbered,
and every text's frequencies over those numbers. The distinct pre-tokens of all chunks are counted
once, joined back to the chunks' lists by the pre-token, and brought together per chunk. No ids are made.

A pre-token has one entry per chunk that holds it, however often the chunk does: the most frequent
word in the corpus is one row in a few hundred thousand, so no key of the join is hot.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from maskwright.llm.tables import opened, saved_in_buckets, shared, slices

#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 32_000_000

# --- Fixed values: the pattern by which byte-level models split a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# --- end of fixed values

#: Blocks in which the classes of that pattern do not depend on the version of Unicode; texts with
#: other characters are split by the tokenizer's own library, at a fifth of the speed.
SETTLED = [(0x0, 0x557), (0x2000, 0x2064), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """The JSON text of a tokenizer file, which executors get by broadcast: its size is that of a
    vocabulary, whatever the size of the table."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return spark.read.text(path, wholetext=True).first()[0]


class Splitter:
    """Pre-tokens of a text, and the pieces of one, as a tokenizer has them.

    Added tokens (special ones too) inside a text count one each, as is the library's default.
    """

    def __init__(self, source: str):
        self.tokenizer = Tokenizer.from_str(source)
        said = json.loads(source)
        added = said.get("added_tokens") or []
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that take in what is around them are not supported")
        if said.get("pre_tokenizer") is None or said["model"]["type"] != "BPE" or said["model"].get("dropout"):
            raise ValueError("a byte-pair model that splits texts before it merges is needed")
        names = sorted((regex.escape(a["content"]) for a in added if a["content"]), key=len, reverse=True)
        self.added = regex.compile("|".join(names)) if names else None
        how = said["pre_tokenizer"]
        self.surface = not said.get("normalizer") and (
            how["type"] == "ByteLevel" and how.get("use_regex", True) and not how["add_prefix_space"]
        )
        self.find = regex.compile(BYTE_LEVEL).findall
        settled = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in SETTLED)
        self.unsettled = regex.compile(f"[^{settled}]").search

    def _of_part(self, part: str) -> list[str]:
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        if not self.surface:
            own = self.tokenizer.normalizer
            return [p for p, _ in split(own.normalize_str(part) if own else part)]
        if self.unsettled(part):
            return [part[a:b] for _, (a, b) in split(part)]
        return self.find(part)

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token stands in a text, and the number of added tokens."""
        parts = self.added.split(text) if self.added else [text]
        found: Counter = Counter()
        for part in parts:
            if part:
                found.update(self._of_part(part))
        return found, len(parts) - 1

    def pieces(self, pre_token: str) -> int:
        merge = self.tokenizer.model.tokenize
        if not self.surface:
            return len(merge(pre_token))
        return sum(len(merge(p)) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(pre_token))


def _chunk(splitter: Splitter, batches: list[pa.RecordBatch]) -> tuple[list[str], dict[str, np.ndarray]]:
    """The distinct pre-tokens of a chunk in order, and its texts' frequencies over their numbers.

    Frequent pre-tokens have small numbers (``number``: of each in order); ``lengths`` has the
    number of entries of each text, ``steps`` the differences of its ascending numbers, ``times``
    how often each stands there, ``extra`` its added tokens.
    """
    first: dict[str, int] = {}
    slots, times, lengths, extra, size = [], [], [], [], []
    for part in (p for b in batches for p in slices(b, max_bytes=1_000_000)):
        for text in part.column("text").to_pylist():
            found, added = splitter.frequencies(text or "")
            slots.append(np.fromiter((first.setdefault(p, len(first)) for p in found), np.int32, len(found)))
            times.append(np.fromiter(found.values(), np.int32, len(found)))
            lengths.append(len(found))
            extra.append(added)
            size.append(len((text or "").encode("utf-8", "surrogatepass")))
    often = np.bincount(np.concatenate(slots), minlength=len(first))
    rank = np.empty(len(first), np.int32)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(first))
    for i, own in enumerate(slots):
        ranked = rank[own]
        order = np.argsort(ranked)
        slots[i] = np.diff(ranked[order], prepend=np.int32(0))
        times[i] = times[i][order]
    names = sorted(first)
    number = rank[np.fromiter((first[n] for n in names), np.int32, len(names))]
    return names, {"number": number, "lengths": lengths, "steps": np.concatenate(slots), "times": np.concatenate(times), "extra": extra, "bytes": size}


def _packed(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values, np.int32).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel().astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row: bytes of its text in UTF-8, tokens of its
    whole text under ``tokenizer`` (the JSON text of a byte-pair tokenizer file), more than ``limit``.

    Tokens are as ``encode(text, add_special_tokens=False)`` gives them: no begin or end tokens;
    added tokens that stand in a text count one each; nothing is truncated or padded. Null and empty
    texts have none. Rows without id, with equal ids and repeated rows each give their own row, in
    no order. A very long text is a chunk of its own; a very long pre-token is one entry. An empty
    table gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    sent = shared(spark, tokenizer)
    id_type = docs.schema["doc_id"].dataType
    packed = ("number", "lengths", "steps", "times", "extra")
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("pre_tokens", T.ArrayType(T.StringType())),
        T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("bytes", T.ArrayType(T.LongType())),
        T.StructField("entries", T.LongType()), *[T.StructField(n, T.BinaryType()) for n in packed],
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, chunk = Splitter(opened(sent)), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        room = chunk_bytes

        def row() -> pa.RecordBatch:
            names, held_by = _chunk(splitter, held)
            ids = pa.concat_arrays([b.column("doc_id") for b in held])
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            own = [pa.array([chunk]), pa.array([names], pa.list_(pa.string())), ids, pa.array([held_by["bytes"]], pa.list_(pa.int64())), pa.array([len(held_by["steps"])])]
            return pa.RecordBatch.from_arrays([*own, *(pa.array([_packed(held_by[n])], pa.binary()) for n in packed)], schema.names)

        for batch in batches:
            for part in slices(batch, max_bytes=chunk_bytes):
                size = part.column("text").nbytes
                if held and size > room:
                    yield row()
                    chunk, held, room = chunk + 1, [], chunk_bytes
                held.append(part)
                room -= size
        if held:
            yield row()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(opened(sent))
        for batch in batches:
            found = [splitter.pieces(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["pre_token", "pieces"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                ids, size, found = row["doc_ids"].values, row["bytes"].values, row["found"].values
                lengths, extra = (_unpacked(row[n].as_py(), len(ids)) for n in ("lengths", "extra"))
                steps, times = (_unpacked(row[n].as_py(), row["entries"].as_py()) for n in ("steps", "times"))
                n_of = np.zeros(0, np.int64)
                if found is not None:
                    n_of = np.empty(len(found), np.int64)
                    in_order = np.empty(len(found), np.int64)
                    in_order[found.field("place").to_numpy()] = found.field("pieces").to_numpy()
                    n_of[_unpacked(row["number"].as_py(), len(found))] = in_order
                ends = np.cumsum(lengths)
                starts = ends - lengths
                climbed = np.concatenate([[0], np.cumsum(steps)])
                total = np.concatenate([[0], np.cumsum(n_of[climbed[1:] - np.repeat(climbed[starts], lengths)] * times)])
                n = total[ends] - total[starts] + extra
                yield pa.RecordBatch.from_arrays([ids, size, pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chunks = saved_in_buckets(read.mapInArrow(split, schema), "chunk", "chunks")
    lists = chunks.select("chunk", F.posexplode("pre_tokens").alias("place", "pre_token"))
    counts = lists.select("pre_token").distinct().mapInArrow(pieces, "pre_token string, pieces int")
    found = lists.join(counts, "pre_token").groupBy("chunk").agg(F.collect_list(F.struct("place", "pieces")).alias("found"))
    kept = chunks.drop("pre_tokens").join(found, "chunk", "left").drop("chunk")
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return kept.mapInArrow(add, out).withColumn("over_limit", F.col("n_tokens") > limit)
