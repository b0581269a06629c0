"""A Merkle manifest of a table by time-forward processing: digests go up, proof suffixes come down.

A node's label is (tree, level, index), and a node is worked on when all messages to it are there:
an external priority queue ordered by label holds them. Between bands of levels the queue is a
written table, dealt out by subtree and sorted by Spark; within a band a task takes one subtree
after the other and keeps the queue of the current one (``SUBTREE`` leaves at most) in memory. The
digests of a band's upper nodes are the messages to the next band. A second sweep runs through the
labels backwards: a node hands its children what their proofs have above them, and a leaf proves
itself with it. A tree of ten billion leaves takes three bands.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.tables import saved

#: Leaves of the subtrees that a task takes one after the other.
SUBTREE = 4096

# What a proof has above a node: (digests before it in its run, digests after it, what is above that).
Suffix = tuple | None


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields in turn: ``-`` if null, else bytes in UTF-8, ``:``, value."""
    texts = [c.cast("string") for c in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _height(n: int, arity: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // arity), h + 1
    return h


def _climb(leaves: list[str], first: int, height: int, arity: int) -> tuple[str, list]:
    """The top digest over ``height`` levels, and the nodes in the order of their labels:
    (level, index, first child, digests of the children)."""
    queue = [(1, (first + i) // arity, first + i, d) for i, d in enumerate(leaves)]  # in order, so a heap
    nodes, top = [], leaves[0]
    while height and queue:
        level, index, child, d = heapq.heappop(queue)
        own = [d]
        while queue and queue[0][:2] == (level, index):
            own.append(heapq.heappop(queue)[3])
        nodes.append((level, index, child, own))
        top = digest("".join(own))
        if level < height:
            heapq.heappush(queue, (level + 1, index // arity, index, top))
    return top, nodes


def _descend(nodes: list, above: Suffix, first: int, count: int) -> list[Suffix]:
    """What each leaf's proof has above it, by a sweep through the nodes backwards."""
    if not nodes:
        return [above]
    waiting = {nodes[-1][:2]: above}
    for level, index, child, own in reversed(nodes):
        suffix = waiting.pop((level, index))
        for j in range(len(own)):
            waiting[level - 1, child + j] = ("".join(own[:j]), "".join(own[j + 1 :]), suffix)
    return [waiting[0, first + i] for i in range(count)]


def _written(suffix: Suffix) -> str:
    parts = []
    while suffix is not None:
        parts.append(f"{suffix[0]}*{suffix[1]}")
        suffix = suffix[2]
    return "/".join(parts)


def _read(text: str) -> Suffix:
    suffix = None
    for part in reversed(text.split("/") if text else []):
        before, after = part.split("*")
        suffix = (before, after, suffix)
    return suffix


def proof_text(suffix: Suffix) -> str:
    """The siblings' digests from left to right, level by level."""
    parts = []
    while suffix is not None:
        parts += suffix[:2]
        suffix = suffix[2]
    return "".join(parts)


def fold(leaf: str, suffix: Suffix) -> str:
    """The root that a leaf and its siblings give."""
    while suffix is not None:
        leaf = digest(suffix[0] + leaf + suffix[1])
        suffix = suffix[2]
    return leaf


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column tree) with ``position``, the place within its tree by ``order`` from
    0, and ``n``, the size of the tree. Rows are sorted by ranges, so a tree may span any number of
    tasks, and equal rows too; only the number of rows of each range and tree is gathered."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    by = ["tree", *order, "salt"]
    dealt = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    placed = saved(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "sorted")
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "part", (before - F.col("start")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return placed.join(runs, ["tree", "part"]).withColumn("position", F.col("at") + F.col("shift")).drop("part", "at", "shift")


class _Band:
    """The levels that one sweep of subtrees covers."""

    def __init__(self, arity: int):
        self.arity, self.levels = arity, 1
        while arity ** (self.levels + 1) <= SUBTREE:
            self.levels += 1
        self.width = arity**self.levels

    def dealt(self, rows: DataFrame, order: list[str]) -> DataFrame:
        return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)

    def up(self, nodes: DataFrame) -> DataFrame:
        """(tree, n, position, digest) of the nodes a band higher; a tree's root stays as it is."""
        arity, levels, width = self.arity, self.levels, self.width

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in _batches(_subtrees(batches, ("tree", "block"))):
                rows = []
                for own in found:
                    tree, n, first = own[0]["tree"], own[0]["n"], own[0]["position"]
                    top, _ = _climb([r["digest"] for r in own], first, min(levels, _height(n, arity)), arity)
                    rows.append({"tree": tree, "n": -(-n // width), "position": first // width, "digest": top})
                yield pa.RecordBatch.from_pylist(rows, _arrow(NODE))

        rows = nodes.select("tree", "n", "position", "digest", (F.col("position") - F.col("position") % width).alias("block"))
        return self.dealt(rows, ["position"]).mapInArrow(sweep, NODE)

    def down(self, nodes: DataFrame, tops: DataFrame, out: T.StructType, tell) -> DataFrame:
        """What ``tell(node row, suffix, subroot)`` gives for every node, from the suffixes of the nodes
        a band higher: (tree, position, suffix, subroot)."""
        arity, levels, width = self.arity, self.levels, self.width
        fields = _arrow(out)

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in _batches(_subtrees(batches, ("tree", "block"))):
                rows = []
                for top, *own in found:
                    first = own[0]["position"]
                    height = min(levels, _height(own[0]["n"], arity))
                    _, inner = _climb([r["digest"] for r in own], first, height, arity)
                    suffixes = _descend(inner, _read(top["suffix"]), first, len(own))
                    rows += [tell(r, s, top["subroot"]) for r, s in zip(own, suffixes)]
                yield pa.RecordBatch.from_pylist(rows, fields)

        messages = tops.select("tree", (F.col("position") * width).alias("block"), F.lit(-1).cast("bigint").alias("position"), "suffix", "subroot")
        own = nodes.withColumn("block", F.col("position") - F.col("position") % width)
        return self.dealt(messages.unionByName(own, allowMissingColumns=True), ["position"]).mapInArrow(sweep, out)


NODE = T.StructType([
    T.StructField("tree", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("position", T.LongType()), T.StructField("digest", T.StringType()),
])
SUFFIX = T.StructType([
    T.StructField("tree", T.StringType()), T.StructField("position", T.LongType()),
    T.StructField("suffix", T.StringType()), T.StructField("subroot", T.StringType()),
])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _subtrees(batches: Iterator[pa.RecordBatch], key: tuple[str, str]) -> Iterator[list[dict]]:
    """The rows of each subtree, which follow one another."""
    rows = (r for b in batches for i in range(0, b.num_rows, 2048) for r in b.slice(i, 2048).to_pylist())
    for _, own in groupby(rows, key=lambda r: (r[key[0]], r[key[1]])):
        yield list(own)


def _batches(subtrees: Iterator[list[dict]], most: int = SUBTREE) -> Iterator[list[list[dict]]]:
    """Subtrees in lots of about ``most`` rows."""
    held, size = [], 0
    for own in subtrees:
        held.append(own)
        size += len(own)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _bands(leaves: DataFrame, band: _Band) -> list[DataFrame]:
    """The nodes at the foot of every band, and last the roots."""
    found = [leaves]
    while not found[-1].filter("n > 1").isEmpty():
        found.append(saved(band.up(found[-1]), "nodes"))
    return found


def _delivered(bands: list[DataFrame], band: _Band, roots: DataFrame) -> DataFrame:
    """(tree, position, suffix, subroot) of the nodes at the foot of the second band, from those of the roots."""

    def tell(row: dict, suffix: Suffix, subroot: str) -> dict:
        return {"tree": row["tree"], "position": row["position"], "suffix": _written(suffix), "subroot": subroot or row["digest"]}

    tops = roots
    for nodes in bands[-2:0:-1]:
        tops = saved(band.down(nodes.select(*NODE.names), tops, SUFFIX, tell), "suffixes")
    return tops


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "lang",
    order: str = "doc_id",
    altered: Mapping[str, Column] | None = None,
    arity: int = 2,
) -> DataFrame:
    """(``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A row's leaf is the digest of its ``fields`` (see ``leaf_digest``). The leaves of each value of
    ``tree`` ascend by ``order``, and every ``arity`` consecutive nodes become the digest of theirs
    until one is left, the subroot (a lone leaf itself). Subroots by ascending value of ``tree`` give
    the root likewise. ``proof_sha256`` is the digest of the siblings on the way up to the root.
    ``folded_root`` is what the leaf and its siblings give, the leaf made of ``altered`` columns instead
    where they are named; ``verified`` says whether it is the root.

    Nulls sort first, in ``tree`` and ``order``, and are written ``-``; texts sort by their bytes. Rows
    that tie by ``order`` ascend by leaf; repeated rows are leaves of their own, whose proofs differ.
    Empty and very long texts are values like others. A tree may be one row or nearly all rows. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    own = {f: F.col(f"`{f}`") for f in fields}
    changed = {f: (altered or {}).get(f, c) for f, c in own.items()}
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit(""))
    leaves = saved(docs.select(
        key.alias("tree"), F.col(f"`{order}`").alias("id"), leaf_digest(list(own.values())).alias("digest"),
        leaf_digest(list(changed.values())).alias("changed"),
    ), "leaves")
    id_type = docs.schema[order].dataType
    out = T.StructType([
        T.StructField(order, id_type), *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")],
        T.StructField("verified", T.BooleanType()),
    ])
    band = _Band(arity)
    bands = _bands(saved(positions(leaves, ["id", "digest"]), "placed"), band)
    # The subroots are the leaves of one more tree, whose labels follow all others.
    subroots = bands[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    upper = _bands(saved(positions(subroots, ["of"]), "subroots"), band)
    last = upper[-1].first()
    if last is None:
        return docs.sparkSession.createDataFrame([], out)
    root = last["digest"]
    if len(upper) == 1:  # one tree only
        start = upper[0].select(F.col("of").alias("tree"), F.lit("").alias("suffix"), F.col("digest").alias("subroot"))
    else:
        above = upper[-1].select("tree", "position", F.lit("").alias("suffix"), F.lit("").alias("subroot"))
        named = T.StructType([*SUFFIX.fields, T.StructField("of", T.StringType())])

        def tell_root(row: dict, suffix: Suffix, _: str) -> dict:
            return {"tree": "", "position": row["position"], "suffix": _written(suffix), "subroot": row["digest"], "of": row["of"]}

        start = band.down(upper[0], _delivered(upper, band, above), named, tell_root)
        start = saved(start.select(F.col("of").alias("tree"), "suffix", "subroot"), "subroot-suffixes")
    tops = start.withColumn("position", F.lit(0).cast("bigint"))

    def tell(row: dict, suffix: Suffix, subroot: str) -> dict:
        folded = fold(row["changed"], suffix)
        return {
            order: row["id"], "leaf": row["digest"], "subroot": subroot, "root": root,
            "proof_sha256": digest(proof_text(suffix)), "folded_root": folded, "verified": folded == root,
        }

    return band.down(bands[0], _delivered(bands, band, tops), out, tell)
