"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest known neighbour, so no node's edges are ever
gathered in one place: minima are partial aggregates, and the joins behind them read written
tables, whose large partitions Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.tables import saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): every larger neighbour u of a node, joined to the smallest node v around it."""
    both = saved(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "stars")
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = saved(large, "large")
    least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have an edge to another node, other than the roots.

    ``edges`` has two columns of one orderable type, in any direction, with repeats and loops
    allowed; rows with a null end are ignored. The root is the smallest node of a component. No
    edges: no rows.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    edges = edges.filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = saved(edges.filter("u > v").distinct(), "edges")
    before, after = None, _state(edges)
    while before != after:
        edges = _stars(edges)
        before, after = after, _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
