"""Near-duplicate vectors by product quantisation.

Unit vectors are filed in coarse inverted lists (the nearest of some centroids) as residual codes of
a few subspaces. Every vector queries every list that can hold one of its links: a vector within
distance r of the query lies at most r beyond the plane that halves the way to that list's centroid.
In a list, distances come from asymmetric look-up tables (exact query, coded vector); codes farther
away than r plus their own known error are skipped, and the rest are compared by exact cosine. So
codes and lists, fitted on a bounded sample, change the cost but not the links.

Equal vectors are one entry with a count. Lists are stored in blocks of bounded size, and tasks
return link counts and spanning links of a block, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.components import components
from maskwright.llm.tables import opened, saved, shared

SAMPLE = 20_000  # vectors that centroids and codes are fitted on
PER_LIST = 2048  # vectors of the largest label aimed at per list
MAX_LISTS = 4096
BLOCK = 2048  # stored vectors of a list that one task holds at once
QUERIES = 512  # queries compared at once
SUBSPACES, CODES = 8, 256
ROUNDING = 1e-7


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([_squares(part, centres).argmin(1) for part in np.array_split(x, len(x) // 4096 + 1)])
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centroids, and codebooks of the residuals by subspace, for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        dim = sample.shape[1]
        self.cuts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        self.centres, self.books = np.zeros((1, dim)), [np.zeros((1, len(c))) for c in self.cuts]
        if len(sample):
            self.centres = k_means(sample, min(lists, len(sample)), seed)
            rest = sample - self.centres[_squares(sample, self.centres).argmin(1)]
            self.books = [k_means(rest[:, c], min(CODES, len(sample)), seed + 1 + i) for i, c in enumerate(self.cuts)]

    def encode(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, distance to what they stand for, and the lists to query, of each row."""
        d = _squares(x, self.centres)
        own = d.argmin(1)
        rest = x - self.centres[own]
        codes = np.stack([_squares(rest[:, c], b).argmin(1) for c, b in zip(self.cuts, self.books)], axis=1)
        coded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1)
        error = np.sqrt(((rest - coded) ** 2).sum(1))
        apart = np.sqrt(_squares(self.centres[own], self.centres))
        reach = d - d[np.arange(len(x)), own][:, None] <= 2 * radius * apart + ROUNDING
        reach[np.arange(len(x)), own] = True
        return own, codes.astype(np.uint8), error, [np.flatnonzero(r) for r in reach]

    def tables(self, x: np.ndarray, own: int) -> list[np.ndarray]:
        rest = x - self.centres[own]
        return [_squares(rest[:, c], b) for c, b in zip(self.cuts, self.books)]


def unit(rows: list, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, dtype=kind) for r in rows]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected to) for the nodes of links a-b, without the smallest."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = np.split(place, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class _Block:
    """Stored vectors of one block, and the links that queries have to them."""

    def __init__(self, model: dict, kind: str, threshold: float, radius: float):
        self.model, self.kind, self.threshold, self.radius = model, kind, threshold, radius
        self.stored: list[pa.RecordBatch] = []
        self.ready = False

    def _prepare(self) -> None:
        rows = pa.Table.from_batches(self.stored)
        self.ids = rows.column("id").to_numpy()
        self.n = rows.column("n").to_numpy()
        self.vectors = unit(rows.column("vector").to_pylist(), self.kind)
        self.codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in rows.column("code").to_pylist()]).astype(np.int64)
        self.error = rows.column("error").to_numpy()
        self.list = rows.column("list")[0].as_py()
        self.quantiser = self.model.get(self.vectors.shape[1]) or Quantiser(np.zeros((0, self.vectors.shape[1])), 1)
        self.ready = True

    def links(self, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not self.stored:
            return
        if not self.ready:
            self._prepare()
        for start in range(0, queries.num_rows, QUERIES):
            part = queries.slice(start, QUERIES)
            ids = part.column("id").to_numpy()
            x = unit(part.column("vector").to_pylist(), self.kind)
            near = np.zeros((len(x), len(self.ids)))
            for i, look_up in enumerate(self.quantiser.tables(x, self.list)):
                near += look_up[:, self.codes[:, i]]
            q, s = np.nonzero(near <= (self.radius + self.error + ROUNDING) ** 2)
            linked = np.zeros(len(q), dtype=bool)
            for i in range(0, len(q), 1 << 16):
                k = slice(i, i + (1 << 16))
                linked[k] = np.einsum("ij,ij->i", x[q[k]], self.vectors[s[k]]) >= self.threshold
            linked &= ids[q] != self.ids[s]
            q, s = q[linked], s[linked]
            if not len(q):
                continue
            counts = np.bincount(q, weights=self.n[s], minlength=len(x)).astype(np.int64)
            some = np.flatnonzero(counts)
            node, root = _forest(ids[q], self.ids[s])
            a = pa.array(np.concatenate([ids[some], node]))
            b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(root)])
            n = pa.concat_arrays([pa.array(counts[some]), pa.nulls(len(node), pa.int64())])
            yield pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "n"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Rows of equal (key, kind), one after the other."""
    if not batch.num_rows:
        return
    code = pc.binary_join_element_wise(batch.column("key"), pc.cast(batch.column("kind"), pa.string()), "/")
    ends = pc.run_end_encode(code).run_ends.to_pylist()
    start = 0
    for end in ends:
        part = batch.slice(start, end - start)
        yield part.column("key")[0].as_py(), part.column("kind")[0].as_py(), part
        start = end


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null and the cosine of their embeddings
    is at least ``threshold``. Embeddings that are null, empty, all zero, or hold null or non-finite
    components, and rows without label or vec_id, are linked with nothing: n_links is 0 and the
    component is the row's own vec_id. Embeddings of different length are not linked. Equal rows are
    linked with each other like others; if different vectors share a vec_id, their links add up. An
    empty table gives no rows; extra columns are not read. ``kept`` marks the smallest vec_id of a
    component. The quantiser is fitted on about ``sample`` of the vectors, chosen by a hash.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    wide = "double" in vectors.schema["embedding"].dataType.simpleString()
    kind = "<f8" if wide else "<f4"
    big = F.lit(float("inf"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)) & F.exists(
        "embedding", lambda v: v != 0
    )
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    keys = [F.when(usable, F.xxhash64(F.lit(i), "label", "embedding")).alias(f"__key{i}") for i in (0, 1)]
    rows = vectors.select("vec_id", "label", "embedding", *keys)
    grouped = rows.filter("__key0 is not null").groupBy("__key0", "__key1").agg(
        F.min("vec_id").cast("bigint").alias("id"), F.count("*").alias("n"),
        F.first("label").cast("string").alias("label"), F.first("embedding").alias("embedding"),
    )
    groups = saved(grouped, "groups")
    # As many lists as the largest label needs: one label may have most of the vectors.
    total = groups.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    total = [n or 0 for n in total]
    lists = int(np.clip(round(total[1] / PER_LIST), 1, MAX_LISTS))
    share = min(1.0, sample / max(total[0], 1))
    chosen = groups.filter(F.pmod(F.xxhash64("__key0"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding")
    drawn = [np.array(r, dtype=kind) for r in chosen.orderBy(F.xxhash64("embedding")).toArrow().column(0).to_pylist()]
    model = {
        dim: Quantiser(unit([v.tobytes() for v in drawn if len(v) == dim], kind), lists)
        for dim in sorted({len(v) for v in drawn})
    }
    sent = shared(spark, model)  # at most MAX_LISTS centroids and the codebooks

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers = opened(sent)
        for batch in batches:
            size = pc.list_value_length(batch.column("embedding"))
            for dim in sorted(set(size.to_pylist())):
                own = batch.filter(pc.equal(size, dim))
                for start in range(0, own.num_rows, 2048):
                    part = own.slice(start, 2048)
                    flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
                    raw = [v.tobytes() for v in flat]
                    quantiser = quantisers.get(dim) or Quantiser(np.zeros((0, dim)), 1)
                    where, codes, error, probes = quantiser.encode(unit(raw, kind), radius)
                    group = pc.binary_join_element_wise(part.column("label"), pa.array([str(dim)] * len(raw)), "/")
                    arrays = [group, part.column("id"), part.column("n"), pa.array(where.astype(np.int32))]
                    arrays += [pa.array([p.astype(np.int32) for p in probes], pa.list_(pa.int32()))]
                    arrays += [pa.array([c.tobytes() for c in codes]), pa.array(error), pa.array(raw)]
                    yield pa.RecordBatch.from_arrays(arrays, ["grp", "id", "n", "list", "probes", "code", "error", "vector"])

    encoded = saved(
        groups.select("label", "id", "n", "embedding").mapInArrow(
            encode, "grp string, id bigint, n bigint, list int, probes array<int>, code binary, error double, vector binary"
        ),
        "codes",
    )
    blocks = encoded.groupBy("grp", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = saved(blocks, "blocks")
    key = F.concat_ws("/", "grp", "list", "block").alias("key")
    stored = encoded.join(blocks, ["grp", "list"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    asking = encoded.withColumn("list", F.explode("probes")).join(blocks, ["grp", "list"])
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error")]
    both = stored.select(key, F.lit(0).alias("kind"), "list", "id", "n", "vector", "code", "error").unionByName(
        asking.select(key, F.lit(1).alias("kind"), "list", "id", "n", "vector", *none)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers, current, block = opened(sent), None, None
        for batch in batches:
            for name, asks, part in _runs(batch):
                if name != current:
                    current, block = name, _Block(quantisers, kind, threshold, radius)
                if asks:
                    yield from block.links(part)
                else:
                    block.stored.append(part)

    dealt = both.repartition("key").sortWithinPartitions("key", "kind")
    found = saved(dealt.mapInArrow(compare, "a bigint, b bigint, n bigint"), "links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b"))
    known = groups.select("__key0", "__key1", "id", "n").join(counts, F.col("id") == F.col("a"), "left")
    known = known.join(roots, F.col("id") == F.col("node"), "left").select(
        "__key0", "__key1", F.coalesce("root", "id").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    known = saved(known, "classes")
    out = rows.select("vec_id", "__key0", "__key1").join(known, ["__key0", "__key1"], "left")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("root", "vec_id").cast("bigint").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
